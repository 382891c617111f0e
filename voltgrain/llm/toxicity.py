"""Operator 4, toxicity by compression distance.

zstandard dictionaries are trained in pairs, on what toxic and what ordinary labelled texts say far more often than the
other kind: of each text the words that a share of the texts of its label have, and at most a MORE-th of that share of the
other's, so a few wrong labels strike no word out. Both of a pair begin with a dictionary
trained on the words that both kinds of text use, so that windows of everyday words stay near 0; what the trainer chose
is used as it is, without its entropy tables. A text is cut into windows of about WINDOW bytes, at blanks, and each
window is compressed with either dictionary: the difference of the two lengths says which kind of text the window is
nearer to. There is a pair for each of a few sizes; since their errors differ, a window's differences are also added up.
From a text's differences (the largest, how many reach each of a few thresholds, how many windows) a logistic function
makes the score; its weights are fitted on a quarter of the labelled texts, which the dictionaries have not seen.

Fitting uses a bounded sample of rows: for each label the SAMPLE documents whose ids have the smallest hashes, and of
these the whole texts. Tasks count their words, cut the pieces to train on and make features. What reaches the driver is
the words that enough texts have, PIECES pieces of PIECE bytes for each dictionary (those of the smallest hashes, from
anywhere in the texts) and the features; the dictionaries (some kilobytes) go out with the code. Scoring covers every
whole text, in its own task.

Null and empty texts have no window and get the score that goes with that. A row's score depends on its text alone, so
repeated rows get equal scores; an empty table gives no rows. Labels that are null, or whose id is null, teach nothing;
without labels of both kinds every score is the share of label 1 (0 without any). Other columns pass through; out_col
replaces a column of that name. A very long text takes a few bytes for each of its windows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrain.llm.common import table, text_bytes, written

SAMPLE = 4000
WINDOW, LEVEL = 32, 3
#: Windows that are compressed together; a text's windows always are.
BATCH = 20_000
#: Longer words are in no dictionary.
WORD_BYTES = 40
#: Of each pair of dictionaries: bytes of the shared beginning and of the rest, and the trainer's k and d.
SIZES = [(3 << 10, 600, 16, 6), (8 << 10, 2 << 10, 20, 6), (4 << 10, 1 << 10, 16, 8)]
#: Words that both kinds of text have, for the shared beginning; pieces of text that a dictionary is trained on, and their bytes.
SHARED, PIECES, PIECE = 4000, 20_000, 512
#: The share of a label's texts that a word must be in to be trained on.
COMMON = 0.015
#: By how many times that share must exceed the other label's.
MORE = 5
THRESHOLDS, SUM_THRESHOLDS = (3, 4, 5, 6, 7, 8), (6, 8, 10, 12, 14)


class Model(NamedTuple):
    pairs: list[tuple[bytes, bytes]]  # toxic, ordinary
    weights: list[float]  # of features(), then the intercept
    prior: float  # the score if nothing could be fitted


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False)


def windows(text: bytes) -> Iterator[bytes]:
    """text in pieces of up to WINDOW bytes that end after a blank where there is one; each begins with a blank."""
    i, n = 0, len(text)
    while i < n:
        j = n if i + WINDOW >= n else text.rfind(b" ", i, i + WINDOW) + 1
        if j <= i:
            j = i + WINDOW
        yield b" " + text[i:j]
        i = j


def lengths(packer: zstandard.ZstdCompressor, some: list[bytes]) -> np.ndarray:
    """The compressed length of each window."""
    return np.fromiter(map(len, packer.multi_compress_to_buffer([w or b" " for w in some])), np.int64, len(some))


def features(texts: list[bytes], pairs: list[tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]]) -> np.ndarray:
    """A row for each text. pairs: compressors with the toxic and the ordinary dictionary of each pair."""
    out, held, n = [np.zeros((0, 2 + len(pairs) * (1 + len(THRESHOLDS)) + len(SUM_THRESHOLDS)))], [], 0
    for text in texts:
        held.append(list(windows(text.lower())))
        n += len(held[-1])
        if n >= BATCH:
            out.append(_features(held, pairs))
            held, n = [], 0
    return np.concatenate([*out, _features(held, pairs)] if held else out)


def _features(held: list[list[bytes]], pairs: list[tuple]) -> np.ndarray:
    n = np.array([len(some) for some in held])
    some = [w for windows_ in held for w in windows_ or [b""]]  # a text without windows has one that says nothing
    starts = np.cumsum(np.maximum(n, 1)) - np.maximum(n, 1)
    there = np.repeat(n > 0, np.maximum(n, 1))
    each = [np.where(there, lengths(ordinary, some) - lengths(toxic, some), 0) for toxic, ordinary in pairs]
    out = []
    for d, steps in [*((d, THRESHOLDS) for d in each), (sum(each), SUM_THRESHOLDS)]:
        out += [np.minimum(np.maximum.reduceat(d, starts), 30.0), *(np.log1p(np.add.reduceat((d >= t).astype(np.int64), starts)) for t in steps)]
    return np.stack([*out, np.log1p(n)], axis=1)


class Vocabulary(NamedTuple):
    both: frozenset[bytes]
    toxic: frozenset[bytes]
    ordinary: frozenset[bytes]


def vocabulary(seen: dict[int, Counter], n: dict[int, int]) -> Vocabulary:
    """seen: in how many texts of a label each word is; n: how many texts of a label there are."""
    both = sorted((w for w in seen[0] if seen[0][w] >= 2 and seen[1][w] >= 2), key=lambda w: (-seen[0][w] - seen[1][w], w))
    own = lambda y: frozenset(w for w, c in seen[y].items() if c >= least(n[y]) and c * n[1 - y] >= MORE * seen[1 - y][w] * n[y])
    return Vocabulary(frozenset(both[:SHARED]), own(1), own(0))


def least(n: int) -> int:
    """How many of n texts a word must be in."""
    return max(min(3, n), math.ceil(COMMON * n))


def pieces(text: bytes, y: int, v: Vocabulary) -> Iterator[tuple[int, bytes]]:
    """What to train on, in pieces: kind (-1: for the shared beginning, else the label) and words of it, in the text's order."""
    words = text.lower().split()
    for kind, known in ((-1, v.both), (y, v.toxic if y else v.ordinary)):
        held, size = [], 0
        for w in words:
            if w in known:
                held.append(w)
                size += len(w) + 1
                if size >= PIECE:
                    yield kind, b" " + b" ".join(held) + b" "
                    held, size = [], 0
        if held:
            yield kind, b" " + b" ".join(held) + b" "


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """What zstandard's trainer chooses from the samples, without the tables before it; the samples' end where they are too few to train on."""
    samples = sorted(samples)
    try:
        return zstandard.train_dictionary(size + 400, [s for s in samples if len(s) >= 8], k=k, d=d, level=LEVEL).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(samples: dict[int, list[bytes]]) -> list[tuple[bytes, bytes]]:
    out = []
    for head, tail, k, d in SIZES:
        shared = trained(samples.get(-1, []), head, 16, 6)
        out.append(tuple(shared + trained(samples.get(y, []), tail, k, d) for y in (1, 0)))
    return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of x's columns, then the intercept, by Newton's method with a small penalty."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w, pull = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], 1.0), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def words_of(text: bytes) -> set[bytes]:
    return {w for w in text.lower().split() if len(w) < WORD_BYTES}


def compressors(pairs: list[tuple[bytes, bytes]]) -> list[tuple]:
    return [(compressor(t), compressor(o)) for t, o in pairs]


def calibrated(pairs: list[tuple[bytes, bytes]], rows: list[tuple[int, list[float]]], prior: float) -> Model:
    """rows: labels and features of texts that the dictionaries have not seen."""
    rows = sorted(rows)  # sums of floats depend on the order
    y = np.array([label for label, _ in rows], float)
    w = logistic(np.array([x for _, x in rows]), y)
    share = y.mean()
    w[-1] += math.log(prior / (1 - prior)) - math.log(share / (1 - share))  # the sample holds label 1 more often
    return Model(pairs, w.tolist(), prior)


def fitted(rows: list[tuple[bytes, int]], prior: float) -> Model:
    """What fit makes, of rows at hand: texts and labels (0, 1). prior: the share of label 1 among all labels."""
    rows = sorted(dict(rows).items())
    learn, check = [r for i, r in enumerate(rows) if i % 4], [r for i, r in enumerate(rows) if not i % 4]
    if min(sum(y == k for _, y in part) for part in (learn, check) for k in (0, 1)) < 1:
        return Model([], [], prior)
    seen = {0: Counter(), 1: Counter()}
    for text, y in learn:
        seen[y].update(words_of(text))
    v = vocabulary(seen, Counter(y for _, y in learn))
    samples: dict[int, list[bytes]] = {}
    for text, y in learn:
        for kind, piece in pieces(text, y, v):
            samples.setdefault(kind, []).append(piece)
    pairs = dictionaries(samples)
    run = compressors(pairs)
    return calibrated(pairs, list(zip([y for _, y in check], features([text for text, _ in check], run).tolist(), strict=True)), prior)


def sampled(docs: DataFrame, known: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """t (a whole text in UTF-8), y and check (calibrates; the others make the dictionaries), each text once."""
    some = [known.filter(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # 2 * sample rows at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(chosen, "id").groupBy("id", "y").agg(F.min("t").alias("t")).filter(F.col("t").isNotNull())
    texts = texts.groupBy("t").agg(F.max("y").alias("y"))
    return written(texts.select(text_bytes("t").alias("t"), "y", (F.pmod(F.xxhash64("t"), F.lit(4)) == 0).alias("check")), "toxicity-sample")


def word_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = {0: Counter(), 1: Counter()}
    for batch in it:
        for text, y in zip(batch["t"], batch["y"], strict=True):
            seen[y.as_py()].update(words_of(text.as_py()))
    some = list(seen[0].keys() | seen[1].keys())
    for i in range(0, len(some), 10_000):
        part = some[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), *(pa.array([seen[k][w] for w in part], pa.int64()) for k in (0, 1))], names=["word", "n0", "n1"])


def fit(docs: DataFrame, labels: DataFrame, use: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """use: which labels may be learned from."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & use).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    if not 0 < prior < 1:
        return Model([], [], prior)
    rows = sampled(docs, known, sample, id_col, text_col)
    n = {(r["check"], r["y"]): r["n"] for r in rows.groupBy("check", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 4:
        return Model([], [], prior)
    n = {k: n[False, k] for k in (0, 1)}
    words = rows.filter("not check").select("t", "y").mapInArrow(word_counts, "word binary, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # rarer words are in no dictionary
    words = words.filter((F.col("n0") >= least(n[0])) | (F.col("n1") >= least(n[1])) | ((F.col("n0") >= 2) & (F.col("n1") >= 2))).toArrow()
    seen = {k: Counter({w: c for w, c in zip(words["word"].to_pylist(), words[f"n{k}"].to_pylist(), strict=True) if c}) for k in (0, 1)}
    v = vocabulary(seen, n)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            some = [x for text, y in zip(batch["t"], batch["y"], strict=True) for x in pieces(text.as_py(), y.as_py(), v)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], names=["kind", "piece"])

    cuts = rows.filter("not check").select("t", "y").mapInArrow(cut, "kind int, piece binary")
    samples = {kind: [r["piece"] for r in cuts.filter(F.col("kind") == kind).orderBy(F.xxhash64("piece"), "piece").limit(PIECES).collect()] for kind in (-1, 0, 1)}
    pairs = dictionaries({kind: list(map(bytes, some)) for kind, some in samples.items()})

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compressors(pairs)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch["y"], pa.array(features(batch["t"].to_pylist(), run).tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    found = rows.filter("check").select("t", "y").mapInArrow(made, "y int, x array<double>").collect()
    return calibrated(pairs, [(r["y"], list(r["x"])) for r in found], prior)


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with the score, 0 to 1."""
    if not model.weights:
        return docs.withColumn(out_col, F.lit(float(model.prior)))

    def batches(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = compressors(model.pairs)
        w = np.array(model.weights)
        for column in it:
            x = features(column.to_pylist(), run)
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))), pa.float64())

    return docs.withColumn(out_col, F.arrow_udf(batches, "double", F.ArrowUDFType.SCALAR_ITER)(text_bytes(text_col)))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    rows = scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
