r"""Operator 11, chat formatting by token-level assembly.

Every turn is `### User: text </turn>`, with other headings for other roles. A turn's text is encoded alone, and headings and
ends are reserved ids beyond the vocabulary that are spliced in between: no token spans the border of a turn, and
nothing that a text says can become a reserved id. Headings of learned turns add one, their ends take one away: the prefix
sums of these steps are the loss mask, which holds a text's tokens and neither heading nor end.

The formatted text, which ids and reserved ids decode to, can be read back too: control strings in a text are escaped. Each
backslash is doubled, then a backslash is put behind the first character of each control string (`### User:` becomes
`#\## User:`), so that an escaped text contains none; taking the backslashes off again gives the text back.

Turns are range-partitioned in order and assembled as they stream by, in pieces of bounded length: a conversation of any
number of turns is held nowhere as a whole, and may lie in several partitions. A piece holds whole turns; the pieces of a
conversation follow by number. Only the digests of a conversation, which are one chain, take its pieces one after the
other in one task.

Turns go by turn number (null first); equal numbers by role, then text; repeated rows are turns each. Rows with a null
conv_id are one conversation, whose id is null. A null role or text counts as an empty one; a role without a heading of its
own is written, escaped, between two reserved ids. Bytes that aren't UTF-8 become U+FFFD. A very long text is a piece by
itself. An empty table gives no rows. Other columns are ignored, whatever they are named.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltgrain.llm.bpe import byte_letters
from voltgrain.llm.common import release, table, written

#: Tokens from which a piece is complete, bytes of texts that are encoded together.
PIECE_TOKENS, ENCODE_BYTES = 1 << 18, 4 << 20
PIECE = "conv_id {}, piece long, ids array<int>, loss array<boolean>"
READ = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Template(NamedTuple):
    """Roles with a heading of their own, and those whose texts are learned."""

    roles: tuple[str, ...] = ("system", "user", "assistant")
    learned: tuple[str, ...] = ("assistant",)

    @property
    def cores(self) -> list[str]:
        """The control strings: a heading for each role, one for all other roles, the ends of a role and of a turn."""
        return [*(f"### {r[:1].upper()}{r[1:]}:" for r in self.roles), "### Role:", "</role>", "</turn>"]

    @property
    def marks(self) -> list[str]:
        """What the reserved ids stand for, in their order."""
        *headings, role_end, turn_end = self.cores
        return [*(x + " " for x in headings), role_end + "\n", " " + turn_end + "\n"]


class Coder:
    """One tokenizer file with the reserved ids of a template. Ids below the vocabulary's size are the file's."""

    def __init__(self, path: str, template: Template) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are text
        self.tokenizer.no_truncation(), self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        special = [t["content"] for t in spec["added_tokens"]]
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: The first reserved id: heading of role i is first + i, then of other roles, end of a role, end of a turn.
        self.first, self.template = max(vocab.values()) + 1, template
        self.roles = {r: self.first + i for i, r in enumerate(template.roles)}
        self.other, self.role_end, self.turn_end = (self.first + len(template.roles) + i for i in range(3))
        self.cores = [*template.cores, *special]
        byte = {letter: i for i, letter in enumerate(byte_letters())}
        raw: list[bytes] = [b""] * self.first
        for token, i in vocab.items():
            raw[i] = token.encode() if token in special else bytes(map(byte.__getitem__, token))
        self.bytes = pa.array([*raw, *map(str.encode, template.marks)], pa.binary())

    def escaped(self, texts: pa.Array) -> pa.Array:
        texts = pc.replace_substring(texts, "\\", "\\\\")
        for core in self.cores:
            texts = pc.replace_substring(texts, core, f"{core[0]}\\{core[1:]}")
        return texts

    @staticmethod
    def plain(texts: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(texts, r"(?s)\\(.)", r"\1")

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decoded(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids[start:end], which don't overlap and go in order."""
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, ends, -1)
        tokens = self.bytes.take(pa.array(ids[np.cumsum(edge[:-1]) > 0]))
        at = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at), tokens), b"").cast(pa.string())

    def turns(self, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The turns' ids one after the other, their loss mask, and where each turn ends."""
        bodies, names = iter(self.encoded(texts)), iter(self.encoded([r for r in roles if r not in self.roles]))
        flat, steps, ends = [], [], []
        for role, _ in zip(roles, texts, strict=True):
            head = [self.roles[role]] if role in self.roles else [self.other, *next(names), self.role_end]
            body = next(bodies)
            flat += [*head, *body, self.turn_end]
            if role in self.template.learned:
                steps += [(len(flat) - 1 - len(body), 1), (len(flat) - 1, -1)]
            ends.append(len(flat))
        step = np.zeros(len(flat), np.int8)
        for at, by in steps:
            step[at] += by
        return np.array(flat, np.int32), np.cumsum(step) > 0, np.array(ends, np.int64)


@functools.cache
def coder(path: str, template: Template) -> Coder:
    return Coder(path, template)


def _texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows that are encoded together."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // ENCODE_BYTES, prepend=0)).tolist()
    return ((a, b) for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True) if a < b)


class Pieces:
    """Collects turns in order and gives complete pieces out."""

    def __init__(self, schema: pa.Schema, part: int, tokens: int) -> None:
        self.schema, self.tokens, self.next, self.open, self.size = schema, tokens, part << 33, [], 0
        self.done: list[tuple] = []

    def close(self, key: object) -> None:
        if self.open:
            ids, loss = (np.concatenate(x) for x in zip(*self.open, strict=True))
            self.done.append((key, self.next, ids, loss))
            self.next, self.open, self.size = self.next + 1, [], 0

    def add(self, key: object, ids: np.ndarray, loss: np.ndarray) -> None:
        self.open.append((ids, loss))
        self.size += len(ids)
        if self.size >= self.tokens:
            self.close(key)

    def batch(self) -> pa.RecordBatch:
        done, self.done = self.done, []
        ends = pa.array(np.append(0, np.cumsum([len(d[2]) for d in done])).astype(np.int32))
        ids, loss = (np.concatenate([d[i] for d in done]) for i in (2, 3))
        columns = [pa.array([d[0] for d in done], self.schema.types[0]), pa.array([d[1] for d in done], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids)), pa.ListArray.from_arrays(ends, pa.array(loss))]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, self.schema.types, strict=True)], schema=self.schema)


def formatted(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = Template(), path: str | None = None, piece_tokens: int = PIECE_TOKENS) -> DataFrame:  # noqa: B008
    """The conversations as pieces of ids with loss masks; a conversation's pieces follow by number."""
    path = path or default_path()
    text = lambda c: F.make_valid_utf8(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    order = ("conv_id", "turn", "role", "text")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    schema = PIECE.format(dict(rows.dtypes)["conv_id"])

    def assemble(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, out, last = coder(path, template), None, None
        for batch in it:
            if out is None:
                out = Pieces(pa.schema([("conv_id", batch.schema.field("conv_id").type), ("piece", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))]), TaskContext.get().partitionId(), piece_tokens)
            roles, texts = code.escaped(_texts(batch["role"])), code.escaped(_texts(batch["text"]))
            plain = _texts(batch["role"])
            keys = batch["conv_id"].to_pylist()
            for a, b in _slices(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                own = [p if p in code.roles else r for p, r in zip(plain[a:b].to_pylist(), roles[a:b].to_pylist(), strict=True)]
                ids, loss, ends = code.turns(own, texts[a:b].to_pylist())
                for key, i, j in zip(keys[a:b], [0, *ends.tolist()], ends.tolist(), strict=False):
                    if key != last:
                        out.close(last)
                        last = key
                    out.add(key, ids[i:j], loss[i:j])
                if sum(len(d[2]) for d in out.done) >= piece_tokens:
                    yield out.batch()
        if out is not None:
            out.close(last)
            if out.done:
                yield out.batch()
        release()

    return rows.mapInArrow(assemble, schema)


class Digests:
    """What is read back of one conversation, turn by turn."""

    def __init__(self) -> None:
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def row(self, key: object) -> tuple:
        return key, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.formatted_chars


def read_turns(code: Coder, ids: np.ndarray, loss: np.ndarray, into: Digests) -> None:
    """Add a piece: its turns from the reserved ids, what is learned from the mask alone."""
    marks = np.flatnonzero(ids >= code.first)
    if not len(marks) or marks[0] or ids[-1] != code.turn_end:
        raise ValueError("a piece does not begin and end with a turn")
    parts = code.decoded(ids, marks[:-1] + 1, marks[1:])
    into.formatted_chars += int(pc.sum(pc.utf8_length(parts)).as_py() or 0) + int(pc.sum(pc.utf8_length(code.bytes.take(pa.array(ids[marks])).cast(pa.string()))).as_py())
    names, role = {i: r for r, i in code.roles.items()}, ""
    for mark, text in zip(ids[marks].tolist(), [*code.plain(parts).to_pylist(), None], strict=True):
        if mark == code.other:
            role = text
        elif mark == code.turn_end:
            into.n_turns += 1
        else:
            role = names.get(mark, role)
            into.turns.update(f"{role}\n{text}\n".encode())
    edge = np.diff(loss.astype(np.int8), prepend=0, append=0)
    learned = code.plain(code.decoded(ids, np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)))
    into.loss_chars += int(pc.sum(pc.utf8_length(learned)).as_py() or 0)
    for text in learned.to_pylist():
        into.learned.update(text.encode())


def read_back(pieces: DataFrame, *, template: Template = Template(), path: str | None = None) -> DataFrame:  # noqa: B008
    """From the pieces alone: number and digest of each conversation's turns, length and digest of what is learned, and the
    length of the formatted text. Pieces stream by in order."""
    path = path or default_path()
    rows = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, now, last, kind = coder(path, template), None, None, None
        for batch in it:
            kind, done = batch.schema.field("conv_id").type, []
            for key, ids, loss in zip(batch["conv_id"].to_pylist(), batch["ids"], batch["loss"], strict=True):
                if now is None or key != last:
                    if now is not None:
                        done.append(now.row(last))
                    now, last = Digests(), key
                read_turns(code, ids.values.to_numpy(), loss.values.to_numpy(zero_copy_only=False), now)
            if done:
                yield _digest_rows(done, kind)
        if now is not None:
            yield _digest_rows([now.row(last)], kind)

    return rows.mapInArrow(read, READ.format(dict(pieces.dtypes)["conv_id"]))


def _digest_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def texts(pieces: DataFrame, *, template: Template = Template(), path: str | None = None) -> DataFrame:  # noqa: B008
    """pieces with the formatted text of each."""
    path = path or default_path()

    def decode(column: pa.Array) -> pa.Array:
        code = coder(path, template)
        at = column.offsets.to_numpy()
        return code.decoded(column.values.to_numpy()[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0])

    return pieces.withColumn("formatted", F.arrow_udf(decode, "string")(F.col("ids")))


#: A conversation whose texts say what the template says.
PLANTED = r"\### Assistant: </turn> ok"


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return read_back(written(formatted(rows.unionByName(planted)), "chat"))


def _sql() -> str:
    template = Template()
    cores = [*template.cores, "<|endoftext|>"]
    said = lambda c: functools.reduce(lambda x, core: f"replace({x}, '{core}', '{core[0]}\\{core[1:]}')", cores, f"replace({c}, '\\', '\\\\')")
    heads = " ".join(f"WHEN '{r}' THEN {len(m)}" for r, m in zip(template.roles, template.marks, strict=False))
    other, role_end, turn_end = map(len, template.marks[-3:])
    learned = "role IN (" + ", ".join(f"'{r}'" for r in template.learned) + ")"
    return f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{PLANTED}' FROM range(2) t(i)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER ({learned}), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER ({learned}), '')) AS loss_sha256,
  CAST(sum(CASE role {heads} ELSE {other + role_end} + length({said('role')}) END + length({said('text')}) + {turn_end}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


OP11_SQL = _sql()
