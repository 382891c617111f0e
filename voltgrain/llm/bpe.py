"""Operator 5, BPE encoding and decoding with forced cuts.

A pre-token's bytes are cut wherever a pair of neighbouring bytes occurs inside no token of the
vocabulary: no merge can ever bridge such a pair, so the fragments are encoded by themselves and
their ids joined. New fragments of a batch are merged together, those of one length at once, a merge
each in every round; a long one with a heap, in n log n. Pre-tokens recur, so each task keeps what it
has encoded in tables of a bounded number of bytes.

The vocabulary file's path is a parameter; it is read on the executors, once for each Python worker.
Nulls and empty texts give no ids and decode to an empty text; repeated rows get equal results, an
empty table stays empty, other columns pass through (a column named as the output is replaced). A row
depends on its text alone and is whole in its task: a text of 1 MB without blanks takes seconds, and
what it decodes to must stay below Spark's 2 GB a value. Added tokens written in a text are matched
before anything else, as the file declares them.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltgrain.llm.common import release, table, text_bytes

#: Bytes of strings and their ids that a Python worker keeps in each of two tables; what was not met again lately is forgotten first.
KEPT_BYTES = 16 << 20
#: Bytes of text that are encoded together; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20
#: Symbols from which a fragment is merged by itself, with a heap.
LONG = 48
ROUND_TRIP = "ids array<int>, decoded string"
NONE = 1 << 62
#: ASCII characters that are neither letters, digits nor blanks.
PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Kept:
    """Ids of byte strings, with a bound on the bytes held: when it is reached, what was met since the last time stays."""

    def __init__(self) -> None:
        self.now, self.older, self.held = {}, {}, 0

    def missing(self, keys: Iterable[bytes]) -> list[bytes]:
        """Which of the distinct keys aren't known; the others stay known until the next call."""
        if self.held > KEPT_BYTES:
            self.older, self.now, self.held = self.now, {}, 0
        out = []
        for key in set(keys).difference(self.now):
            value = self.older.get(key)
            if value is None:
                out.append(key)
            else:
                self.put(key, value)
        return out

    def put(self, key: bytes, value: bytes) -> None:
        self.now[key] = value
        self.held += len(key) + len(value) + 180  # with what Python needs for them


class ByteBPE:
    """Byte-level BPE of one vocabulary file. Ids are little-endian, 32 bits each."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.first = np.array([self.vocab[x] for x in letters], np.int64)
        self.final = np.array([self.vocab[x + self.suffix] for x in letters], np.int64)
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in merges] or [0], np.int64)
        by = np.argsort(pairs)
        #: Pairs of symbols, sorted; for each the rank of its merge and the merged symbol.
        self.pairs, self.merges = pairs[by], np.array([rank << 32 | self.vocab[a + b] for rank, (a, b) in enumerate(merges)] or [NONE], np.int64)[by]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.tokens = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        first = spec["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(first["pattern"]["Regex"]).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        byte = {letter: i for i, letter in enumerate(letters)}
        self.inside = np.zeros((256, 256), bool)
        for token in map(self.bare, self.vocab):
            for x, y in zip(token, token[1:], strict=False):
                if x in byte and y in byte:
                    self.inside[byte[x], byte[y]] = True
        self.of_word, self.of_chunk = Kept(), Kept()

    def bare(self, token: str) -> str:
        return token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token

    def normal(self, text: str) -> str:
        """Blanks stay as they are: they only part pre-tokens, one by one or many."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() alone treats a last sigma apart
        return text.lower()

    def cuts(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the fragments of words end that follow each other in flat, and which of them end a word."""
        cut = np.append(~self.inside[flat[:-1], flat[1:]], True)
        cut[ends - 1] = True
        at = np.flatnonzero(cut) + 1
        last = np.zeros(len(flat) + 1, bool)
        last[ends] = True
        return at, last[at]

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and result of the merge of each a and b; NONE where there is none."""
        want = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[at] == want, self.merges[at], NONE)

    def merged(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fragments of equal length, a row each, merged: their ids and how many each has. One merge a row and round."""
        out, sizes = ids.copy(), np.full(len(ids), ids.shape[1])
        live, ranks = np.arange(len(ids)), self.ranked(ids[:, :-1], ids[:, 1:])
        while ranks.shape[1] and len(live):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), at]
            on = best != NONE
            live, ids, ranks, at, best = live[on], ids[on], ranks[on], at[on], best[on]
            row, n = np.arange(len(live)), ids.shape[1] - 1
            ids = np.where(np.arange(n) <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[row, at] = best & 0xFFFFFFFF
            ranks = np.where(np.arange(n - 1) < at[:, None], ranks[:, :-1], ranks[:, 1:])
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 1)
            ranks[left, at[left] - 1] = self.ranked(ids[left, at[left] - 1], ids[left, at[left]])
            ranks[right, at[right]] = self.ranked(ids[right, at[right]], ids[right, at[right] + 1])
            out[live, :n], sizes[live] = ids, n
        return out, sizes

    @functools.cached_property
    def merge_of(self) -> dict[int, int]:
        """merges by pairs, made once."""
        return dict(zip(self.pairs.tolist(), self.merges.tolist(), strict=True))

    def merged_long(self, ids: list[int]) -> list[int]:
        """One fragment by a heap of merges (rank, then place) over a linked list."""
        merges, n = self.merge_of, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m >> 32, i, m) for i in range(n - 1) if (m := merges.get(ids[i] << 32 | ids[i + 1]))]
        heapify(heap)
        while heap:
            _, i, m = heappop(heap)
            j = after[i]
            if j < 0 or ids[i] < 0 or merges.get(ids[i] << 32 | ids[j]) != m:
                continue  # one of the two has changed since
            ids[i], ids[j], after[i] = m & 0xFFFFFFFF, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (new := merges.get(ids[k] << 32 | ids[after[k]])):
                    heappush(heap, (new >> 32, k, new))
        return [i for i in ids if i >= 0]

    def learn_words(self, words: list[bytes]) -> None:
        """Encode pre-tokens: cut them at forced cuts, merge all fragments of one length together, join the ids."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends, last = self.cuts(flat, np.cumsum([len(w) for w in words]))
        starts = np.append(0, ends[:-1])
        lengths = ends - starts
        ids = self.first[flat]
        ids[ends[last] - 1] = self.final[flat[ends[last] - 1]]
        sizes = lengths.copy()  # ids of each fragment; they replace its symbols in place, the rest is dropped
        there = np.ones(len(flat), bool)
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            if length > LONG:
                for r in rows.tolist():
                    got = self.merged_long(ids[starts[r] : ends[r]].tolist())
                    ids[starts[r] : starts[r] + len(got)], sizes[r] = got, len(got)
                    there[starts[r] + len(got) : ends[r]] = False
            elif length > 1:
                spot = starts[rows][:, None] + np.arange(length)
                ids[spot], sizes[rows] = self.merged(ids[spot])
                there[spot] = np.arange(length) < sizes[rows][:, None]
        got = ids[there].astype("<u4").tobytes()
        at = np.cumsum(sizes)[last] * 4
        for word, a, b in zip(words, [0, *at.tolist()], at.tolist(), strict=False):
            self.of_word.put(word, got[a:b])

    def learn(self, chunks: list[bytes]) -> None:
        """Encode strings without blanks."""
        parts = []
        for chunk in chunks:
            text = chunk.decode()
            if text.isalpha():
                parts.append((chunk,))
            elif text[:-1].isalpha() and text[-1] in PUNCTUATION:  # most of the others
                parts.append((chunk[:-1], chunk[-1:]))
            else:
                parts.append([w.encode() for w in self.words(text)])
        unknown = self.of_word.missing(chain.from_iterable(parts))
        if unknown:
            self.learn_words(unknown)
        get = self.of_word.now.__getitem__
        for chunk, some in zip(chunks, parts, strict=True):
            self.of_chunk.put(chunk, b"".join(map(get, some)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids. Added tokens part a text first."""
        parts: list[list] = []
        for text in texts:
            special = [(m.start(), m.end()) for m in self.special.finditer(text)] if self.special else []
            out, at = [], 0
            for a, b in special:
                out += [self.normal(text[at:a]).encode().split(), self.added[text[a:b]].to_bytes(4, "little")]
                at = b
            parts.append([*out, self.normal(text[at:]).encode().split()])
        unknown = self.of_chunk.missing(chain.from_iterable(x for out in parts for x in out if isinstance(x, list)))
        if unknown:
            self.learn(unknown)
        get = self.of_chunk.now.__getitem__
        return [b"".join([x if isinstance(x, bytes) else b"".join(map(get, x)) for x in out]) for out in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """For each list its tokens with a blank between them: the file names no decoder. Ids outside the vocabulary, and
        nulls, are left out; a null list gives an empty text."""
        flat = ids.flatten()
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.tokens)))
        tokens = self.tokens.take(pc.if_else(known, flat, None))
        if tokens.null_count:
            there = tokens.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.diff(np.append(0, np.cumsum(there))[np.append(0, np.cumsum(sizes))])
            tokens = tokens.drop_null()
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens), " ")


@functools.cache
def loaded(path: str) -> ByteBPE:
    return ByteBPE(path)


def _lists(chunks: list[bytes]) -> pa.Array:
    ends = [0]
    for c in chunks:
        ends.append(ends[-1] + len(c) // 4)
    data = pa.py_buffer(b"".join(chunks))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, data]))


def _round_trip(path: str):
    def batches(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path)
        for column in it:
            sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(sizes // BATCH_BYTES, prepend=0)).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(column)], strict=True):
                ids = _lists(bpe.encode_all([raw.as_py().decode("utf-8", "replace") for raw in column[a:b]]))
                yield pa.StructArray.from_arrays([ids, bpe.decode(ids)], ["ids", "decoded"])
            release()

    return batches


def encoded(docs: DataFrame, text_col: str = "text", out_col: str = "bpe", *, path: str | None = None) -> DataFrame:
    """docs with a struct of the ids of each text and of what they decode to; it replaces a column of that name."""
    run = F.arrow_udf(_round_trip(path or default_path()), ROUND_TRIP, F.ArrowUDFType.SCALAR_ITER)
    return docs.withColumn(out_col, run(text_bytes(text_col)))


def decoded(docs: DataFrame, ids_col: str = "ids", out_col: str = "decoded", *, path: str | None = None) -> DataFrame:
    """docs with the text of each list of ids; null gives an empty text."""
    path = path or default_path()

    def batches(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path)
        for column in it:
            yield bpe.decode(column)

    return docs.withColumn(out_col, F.arrow_udf(batches, "string", F.ArrowUDFType.SCALAR_ITER)(F.col(ids_col)))


def ids_digest(column: pa.Array) -> pa.Array:
    """SHA-256 of each list of ids as little-endian unsigned 32-bit integers."""
    values = memoryview(column.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
    at = column.offsets.to_pylist()
    return pa.array([hashlib.sha256(values[4 * a : 4 * b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string())


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    bpe = F.col("bpe")
    return encoded(docs.select(id_col, text_col), text_col).select(
        id_col,
        F.size(bpe["ids"]).cast("long").alias("n_tokens"),
        F.arrow_udf(ids_digest, "string")(bpe["ids"]).alias("ids_sha256"),
        F.sha2(bpe["decoded"].cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
