"""Operator 8, quality rules: repetition within a document from a suffix array over its words.

A word is one symbol, however long: a link written twice repeats one word. Each batch of texts becomes one symbol sequence in
which a word of another document is another symbol, so that a repeat never crosses documents. Prefix doubling sorts the suffixes (only groups that are
still tied are sorted again); the ranks of each doubling give the longest common prefix of neighbours in the suffix
array. A suffix's longest repeat is the longer of its two neighbours' prefixes: these spans are the maximal repeats,
and their union is the covered part. The verdict limits the covered share and the longest repeat.

Nulls and empty texts have no words. A row's result depends on its text alone, so repeated rows get equal results; an
empty table stays empty. Documents pass through with all their columns; the signals come as one struct column, which
replaces a column of that name. A text is whole in its task, however long: sorting its n symbols takes about
50 + 4 * log2(longest repeat) bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltgrain.llm.common import release, table, text_bytes, unused

SYMBOLS = "#*$%&|<>"
SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"
#: Symbols of a batch whose suffixes are sorted together; a longer text makes a batch of its own.
BATCH_WORDS = 400_000


def suffix_ranks(first: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks by the first 1, 2, 4, ... symbols, until no two suffixes tie. ends: where each position's document ends."""
    n = len(first)
    order = np.argsort(first, kind="stable")
    new = np.ones(n, bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    levels, h = [rank.astype(np.int32)], 1
    tied = _tied(order, new)
    while len(tied):
        follow = np.where(tied + h < ends[tied], rank[np.minimum(tied + h, n - 1)] + 1, 0)
        by = np.lexsort((follow, rank[tied]))
        at, key, then = tied[by], rank[tied][by], follow[by]
        group = np.ones(len(at), bool)
        group[1:] = key[1:] != key[:-1]
        new = group.copy()
        new[1:] |= then[1:] != then[:-1]
        i = np.arange(len(at))
        rank = rank.copy()
        rank[at] = key + np.maximum.accumulate(np.where(new, i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
        levels.append(rank.astype(np.int32))
        tied = _tied(at, new)
        h *= 2
    return levels


def _tied(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The positions whose group, one run of order from each new mark, has two members or more."""
    last = np.append(new[1:], True)
    return order[~(new & last)]


def longest_repeats(levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """For each position the longest prefix of its suffix that occurs elsewhere too."""
    n = len(ends)
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    prefix = np.zeros(max(n - 1, 0), np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    for k in range(len(levels) - 1, -1, -1):
        i, j = a[live] + prefix[live], b[live] + prefix[live]
        ok = (i + (1 << k) <= ends[a[live]]) & (j + (1 << k) <= ends[b[live]])
        at = live[ok]
        at = at[levels[k][a[at] + prefix[at]] == levels[k][b[at] + prefix[at]]]
        prefix[at] += 1 << k
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, prefix)
    np.maximum.at(out, b, prefix)
    return out


def union_length(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def longest_of(symbol: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position of documents that follow each other the longest repeat from there on, and its document."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    return longest_repeats(suffix_ranks(doc * (symbol.max(initial=0) + 1) + symbol, ends), ends), doc


def repetition(texts: list[list[bytes]], min_repeat: int, window: int = 3) -> np.ndarray:
    """Rows of words in repeated windows, words covered by repeats of min_repeat words or more, words of the longest repeat."""
    sizes = np.array([len(w) for w in texts], np.int64)
    n, out = int(sizes.sum()), np.zeros((len(texts), 3), np.int64)
    if not n:
        return out
    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for text in texts for w in text), np.int64, n)
    longest, doc = longest_of(word, sizes)
    at = np.flatnonzero(longest >= window)
    out[:, 0] = np.bincount(doc[union_length(at, np.full(len(at), window), n)], minlength=len(texts))
    at = np.flatnonzero(longest >= min_repeat)
    out[:, 1] = np.bincount(doc[union_length(at, longest[at], n)], minlength=len(texts))
    np.maximum.at(out[:, 2], doc, longest)
    return out


def _signals(min_repeat: int):
    def batches(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in it:
            rows, held, words = [], [], 0
            for raw in column.to_pylist():
                text = raw.decode("utf-8", "replace")
                w = raw.split()
                seen: set[str] = set()
                dup = 0
                for line in text.split("\n"):
                    if line in seen:
                        dup += 1
                    elif line.encode().split():
                        seen.add(line)
                space = sum(map(text.count, " \t\n\v\f\r"))
                rows.append([len(w), len(text) - space, sum(map(text.count, SYMBOLS)), dup])
                held.append(w)
                words += len(w)
                if words >= BATCH_WORDS:
                    _flush(rows, held, min_repeat)
                    held, words = [], 0
            _flush(rows, held, min_repeat)
            names = [x.split()[0] for x in SIGNALS.split(", ")]
            columns = list(zip(*rows, strict=True)) or list(repeat((), len(names)))
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
            release()

    return batches


def _flush(rows: list[list[int]], held: list[list[bytes]], min_repeat: int) -> None:
    if held:
        for row, more in zip(rows[-len(held) :], repetition(held, min_repeat).tolist(), strict=True):
            row += more


def quality_signals(docs: DataFrame, text_col: str = "text", out_col: str = "quality", *, min_repeat: int = 15) -> DataFrame:
    """docs with a struct of counts (SIGNALS). min_repeat: words from which a repeat counts as covering."""
    signals = F.arrow_udf(_signals(min_repeat), SIGNALS, F.ArrowUDFType.SCALAR_ITER)
    return docs.withColumn(out_col, signals(text_bytes(text_col)))


def verdict(q: str = "quality", *, max_covered: float = 0.2, max_longest: int = 50, min_words: int = 50, max_repeat_share: float = 0.5):
    """base_failed and kept as columns: too few words or too many in repeated windows; then the suffix array's two limits,
    the share covered by repeats and the words of the longest one."""
    s = F.col(q)
    base = (s["n_words"] < min_words) | (s["n_repeat_words"] > max_repeat_share * s["n_words"])
    return base, ~base & (s["covered_words"] <= max_covered * s["n_words"]) & (s["longest_repeat"] <= max_longest)


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    mark = unused("_quality", docs)
    return quality_signals(docs, text_col, mark).filter(verdict(mark)[1]).drop(mark)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    base, kept = verdict()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
    return quality_signals(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(F.col("quality")[n].alias(n) for n in names), base.alias("base_failed"), kept.alias("kept"))
