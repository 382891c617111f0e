"""Corpus-wide counts of hashed items, gathered and given back a block of documents at a time.

Documents are dealt to blocks by hash. Each block counts its own distinct items and sends each 64-bit hash once, in
order, to the bucket that its leading bits name; buckets add the counts up and answer each block with the totals of its
items in the order in which it sent them, so that answers hold no hashes. What is shuffled is packed: a row for a block
and a bucket holds the differences of sorted hashes, in as few bytes as the largest one needs, and counts. A very common
item costs each block one entry, so no item is hot; a bucket holds a bounded share of the hashes; there are never more
rows than hashes, so everything grows in proportion to the corpus.

Items come in levels (words, pairs, ...). Whole hashes are compared at every size. Texts are compressed before they are
dealt. Blocks and buckets name the partitions they go to, so that none gets several by chance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrain.llm.common import mixed, release

#: Bytes of text of a block, and bytes of text whose items a bucket of one level adds up.
BLOCK_BYTES, BUCKET_BYTES = 10 << 20, 8 << 20
#: Most partitions; beyond, one takes several blocks or buckets, one after the other.
PARTS = 20_000
SENT = "block int, level int, bucket int, hashes binary, counts binary"
TOLD = "block int, level int, bucket int, counts binary"
#: What blocks and buckets are grouped by.
BLOCK, BUCKET = ("part", "block"), ("part", "bucket")


def block_of(n: int, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def dealt(rows: DataFrame, name: str, n: int) -> DataFrame:
    """rows in the partitions that name, of n values, says; part holds the partition."""
    n = min(n, PARTS)
    return rows.withColumn("part", F.pmod(name, F.lit(n))).repartitionById(n, F.col("part"))


def blocks_of(docs: DataFrame, n_bytes: int, block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """docs (doc_id, text in UTF-8, and others) with block, each row in its block's partition, and the number of blocks.
    Texts are compressed: texts_of() gives them back."""
    n = max(1, -(-n_bytes // (block_bytes or BLOCK_BYTES)))
    docs = docs.withColumn("block", block_of(n, "doc_id", "text"))

    def small(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in it:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array([packer.compress(x.as_py()) for x in batch["text"]], pa.binary()))

    return dealt(docs.mapInArrow(small, docs.schema), "block", n), n


def texts_of(rows: pa.Table) -> Iterator[bytes]:
    unpacker = zstandard.ZstdDecompressor()
    return (unpacker.decompress(x.as_py()) for x in rows["text"])


def bucket_bits(n_bytes: int) -> int:
    """Leading bits that name a bucket, for a corpus of n_bytes of text."""
    return max(1, (n_bytes // BUCKET_BYTES).bit_length())


class WordHashes(dict):
    """A word's 64-bit hash; a bounded table keeps those met before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: The bytes of a word's last piece of eight that are its own.
OWN = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a word that are hashed by pieces of eight, all words side by side; a longer word is hashed as a whole.
LONG_WORD = 64
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\x0b\x0c\r")] = True


class Words(NamedTuple):
    """The words of texts: the bytes they lie in, where each begins and ends, their 64-bit hashes; where each text begins."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    texts: np.ndarray

    @classmethod
    def of(cls, texts: Iterable[bytes], fold=bytes.lower) -> Words:
        """fold: what is done to all bytes first; it keeps their number. Texts are parted by line feeds."""
        parts = list(texts)
        sizes = np.array([len(x) + 1 for x in parts], np.int64)
        raw = fold(b"\n".join([*parts, b" " * 8]))
        flags = np.append(True, BLANK[np.frombuffer(raw, np.uint8)])
        edges = np.flatnonzero(flags[1:] != flags[:-1])
        starts, ends = edges[::2], edges[1::2]
        return cls(raw, starts, ends, hashes_of(raw, starts, ends), np.cumsum(sizes) - sizes)

    def per_text(self) -> np.ndarray:
        """How many words each text has."""
        return np.diff(np.append(np.searchsorted(self.starts, self.texts), len(self.starts)))


def hashes_of(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of one byte or more in raw, which goes on for eight bytes after the last."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    eight = np.ndarray(len(raw) - 7, np.dtype("<u8"), raw, strides=(1,))
    sizes = ends - starts
    with np.errstate(over="ignore"):
        out = mixed(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (eight[starts] & OWN[np.minimum(sizes, 8)]))
        who = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD))
        for at in range(8, LONG_WORD, 8):
            who = who[sizes[who] > at]
            piece = eight[starts[who] + at] & OWN[np.minimum(sizes[who] - at, 8)]
            out[who] = mixed(out[who] * np.uint64(0x9E3779B97F4A7C15) + piece)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return out


def joined(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of equally long columns, by the order of the columns."""
    out = hashes[0]
    with np.errstate(over="ignore"):
        for h in hashes[1:]:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h)
    return out


def sent(block: int, level: int, hashes: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple]:
    """Rows of SENT for distinct, sorted hashes: one for each bucket that has any."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield block, level, int(bucket[i]), packed(hashes[i:j]), packed_counts(counts[i:j])


def packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes: the bytes of a difference, the first hash, the differences byte by byte, the highest bytes, which are
    mostly small, compressed."""
    steps = np.diff(hashes)
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(steps.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(steps).to_bytes(4, "little") + hashes[:1].astype("<u8").tobytes() + planes[:-1].tobytes() + zstandard.compress(planes[-1].tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:5], "little")
    high = 13 + (width - 1) * n
    steps = np.zeros((n + 1, 8), np.uint8)
    steps[0] = np.frombuffer(raw, np.uint8, 8, 5)
    steps[1:, : width - 1] = np.frombuffer(raw, np.uint8, (width - 1) * n, 13).reshape(width - 1, n).T
    steps[1:, width - 1] = np.frombuffer(zstandard.decompress(raw[high:]), np.uint8)
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts in one byte each if they allow, else in eight; the first byte says which. Most are small and equal: compressed."""
    small = bool(counts.max(initial=0) < 256)
    return bytes([small]) + zstandard.compress(counts.astype(np.uint8 if small else np.int64).tobytes(), 3)


def unpacked_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw[1:]), np.uint8 if raw[0] else np.int64).astype(np.int64)


def rows_of(rows: list[tuple], schema: str) -> pa.Table:
    """An Arrow table of rows of ints and bytes, as SENT and TOLD have them."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else ((),) * len(names)
    return pa.Table.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, names, strict=True)], names=[name for name, _ in names])


def totals(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the sums of their counts."""
    if not len(hashes):
        return hashes, counts.astype(np.int64)
    by = np.argsort(hashes)
    hashes, counts = hashes[by], counts[by]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[first], np.add.reduceat(counts, first, dtype=np.int64)


def told_apart(hashes: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and how often each is on. Two plain sorts are faster than an order of all."""
    flat = np.sort(hashes)
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])[: len(flat)])
    counts, flat = np.diff(np.append(first, len(flat))), flat[first]
    off, times = np.unique(hashes[~on], return_counts=True)
    counts[np.searchsorted(flat, off)] -= times
    return flat, counts


def ranked(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct hash, in the order of hashes, and the number of each place's hash in that order."""
    by = np.argsort(hashes)
    flat = hashes[by]
    new = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
    number = np.empty(len(by), np.int32)
    number[by] = np.cumsum(new, dtype=np.int32) - 1
    return by[new], number


def _added(rows: pa.Table, level: int) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket and level: the blocks, how many hashes each has sent, an order of all of them, where another hash begins
    in it, and its total."""
    some = [i for i, at in enumerate(rows["level"].to_pylist()) if at == level]
    hashes = [unpacked(rows["hashes"][i].as_py()) for i in some]
    counts = np.concatenate([np.zeros(0, np.int64), *(unpacked_counts(rows["counts"][i].as_py()) for i in some)])
    flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
    by = np.argsort(flat)
    flat = flat[by]
    new = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
    return [rows["block"][i].as_py() for i in some], [len(h) for h in hashes], by, new, np.add.reduceat(counts[by], np.flatnonzero(new)) if len(flat) else counts


def spread(counted: DataFrame, bits: int) -> DataFrame:
    """Rows of SENT in their buckets' partitions."""
    return dealt(counted, "bucket", 1 << bits)


def added_up(sent: DataFrame, n: int) -> DataFrame:
    """From rows of SENT, spread, rows of TOLD in the partitions of n blocks: the totals of what each block has sent."""

    def add(rows: pa.Table) -> pa.Table:
        bucket, out = rows["bucket"][0].as_py(), []
        for level in sorted(set(rows["level"].to_pylist())):
            of, sizes, by, new, sums = _added(rows, level)
            total = np.empty(len(by), np.int64)
            total[by] = sums[np.cumsum(new) - 1]
            out += [(block, level, bucket, packed_counts(x)) for block, x in zip(of, np.split(total, np.cumsum(sizes)[:-1]), strict=True)]
            del by, new, sums, total
        release()
        return rows_of(out, TOLD)

    return dealt(sent.groupBy(*BUCKET).applyInArrow(add, TOLD), "block", n)


def sums_of(sent: DataFrame, level: int = 0) -> DataFrame:
    """One row: n, the sum of all counts of a level, and v, how many of its items have any. Spark shuffles the rows once for
    this and for added_up."""

    def add(rows: pa.Table) -> pa.Table:
        sums = _added(rows, level)[-1]
        return rows_of([(int(sums.sum()), int((sums > 0).sum()))], "n long, v long")

    found = sent.groupBy(*BUCKET).applyInArrow(add, "n long, v long")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))


def told(rows: pa.Table, level: int, n: int) -> np.ndarray:
    """The totals of a block's n items of a level, in the order of their hashes."""
    some = sorted((bucket, i) for i, (at, bucket) in enumerate(zip(rows["level"].to_pylist(), rows["bucket"].to_pylist(), strict=True)) if at == level)
    out = np.concatenate([np.zeros(0, np.int64), *(unpacked_counts(rows["counts"][i].as_py()) for _, i in some)])
    if len(out) != n:
        raise ValueError(f"a block asked for {n} items and was told {len(out)}")
    return out
