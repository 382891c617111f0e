"""Operator 6, language-model scoring by a weighted backoff automaton.

n-grams of up to order tokens are counted in the training texts and smoothed by interpolation:

    p(w | u) = (c(u w) + K * p(w | u without its first token)) / (c(u) + K),   p(w) = (c(w) + 1) / (N + V + 1)

States are the contexts of up to order - 1 tokens that occur in training; the root is the empty one. An arc of a state
carries the log-probability of its token and leads to the longest context known that ends with it; at the root every
token has an arc, known or not. A state's failure arc leads to the context without its first token and carries what
smoothing leaves to it, log K / (c(u) + K): it is taken when a token has no arc, so that the sums are p. A text begins
in the state of the token that ends texts; it is traversed once, from left to right, with the state carried on and
log-probabilities added up.

The model grows with the corpus and is never whole anywhere. Blocks of documents count n-grams, buckets add them up
(voltgrain.llm.blocks), and each block builds the part of the automaton that its own texts can reach. The texts of a
block are traversed side by side, in stretches of STRETCH tokens: a state depends on order - 1 tokens, so a stretch
begins that many tokens early, at the root, and adds up what comes after. n-grams are compared by whole 64-bit hashes.

Null and empty texts are one end token. A row depends on its text and the corpus; repeated rows count each time. A null
id counts as an empty one when documents are set aside; an empty table gives no rows, and without training texts all
tokens are unknown. Only the id, the text and what held_out reads are used, whatever other columns are named. Tokens
are lower-cased A-Z. A very long text makes its block larger by its own size, and is spread over many stretches.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrain.llm import blocks as B
from voltgrain.llm.common import release, table, text_bytes

#: The end token's hash: that of a line feed, which no word holds.
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
STRETCH = 512
#: K for contexts of one token, two tokens, ...
STRENGTHS = (1000.0, 100.0)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Texts:
    """The texts of a block as hashed tokens, each with an end token before and after."""

    def __init__(self, rows: pa.Table) -> None:
        words = B.Words.of(B.texts_of(rows))
        self.sizes = words.per_text() + 2
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(self.sizes.sum()) - np.repeat(self.starts, self.sizes)
        self.flat = np.full(len(self.place), END)
        self.flat[(self.place > 0) & (self.place < np.repeat(self.sizes - 1, self.sizes))] = words.hashes
        self.train = np.repeat(~rows["held_out"].to_numpy(zero_copy_only=False).astype(bool), self.sizes)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams of k + 1 tokens end, and their hashes. The first end token of a text is a context only."""
        at = np.flatnonzero(self.place >= max(k, 1))
        return at, B.joined([self.flat[at - i] for i in range(k, -1, -1)])


class Automaton(NamedTuple):
    """States are numbers, those of longer contexts larger: 0 is the root, base[k] the first of k + 1 tokens."""

    words: np.ndarray  # the token at each place of the texts, as a number
    start: int  # the state in which texts begin
    base: list[int]
    keys: list[np.ndarray]  # state * number of words + word of each arc, for states of 1, 2, ... tokens
    slots: list[np.ndarray]  # which arc lies where, by a hash of its key
    logs: list[np.ndarray]
    then: list[np.ndarray]
    root: np.ndarray  # the root's arcs, by word
    root_then: np.ndarray
    fail: np.ndarray  # by state
    weight: np.ndarray


def counted(docs: DataFrame, order: int, bits: int) -> DataFrame:
    def count(rows: pa.Table) -> pa.Table:
        block, texts, out = rows["block"][0].as_py(), Texts(rows), []
        for k in range(order):
            at, hashes = texts.grams(k)
            out += B.sent(block, k, *B.told_apart(hashes, texts.train[at]), bits)
            release()
        return B.rows_of(out, B.SENT)

    return B.spread(docs.groupBy(*B.BLOCK).applyInArrow(count, B.SENT), bits)


def automaton(texts: Texts, told: Callable[[int, int], np.ndarray], total: int, distinct: int, strengths: tuple[float, ...]) -> tuple[Automaton, np.ndarray]:
    """The states and arcs that the texts can reach, and each word's count. told: of a length less one and a number of n-grams,
    their totals in the order of their hashes."""
    known, words = B.ranked(texts.flat)
    n_words, c = len(known), told(0, len(known))  # the end tokens before texts end texts too: they add no word
    p = (c + 1) / (total + distinct + 1)
    word_counts, root, of = c, np.log10(p), words
    base, fail, weight, to = [1], [np.zeros(1, np.int64)], [np.zeros(1)], np.zeros(n_words, np.int64)
    keys, slots, logs, then = [], [], [], []
    for k, strength in enumerate(strengths, 1):
        # of: the n-gram of k tokens that ends at each place (-1: none); c, p, to: its count, probability and failure state
        fail.append(to)
        weight.append(np.log10(strength / (c + strength)))
        base.append(base[-1] + len(c))
        at, hashes = texts.grams(k)
        first, inverse = B.ranked(hashes)
        del hashes
        end = at[first]  # a place where each n-gram of k + 1 tokens ends
        del first
        context, below, count = of[end - 1], of[end], told(k, len(end))
        p = np.where(count > 0, (count + strength * p[below]) / (c[context] + strength), 1)
        on = np.flatnonzero(count > 0)
        keys.append((base[k - 1] + context[on].astype(np.int64)) * n_words + words[end[on]])
        slots.append(slots_of(keys[-1]))
        logs.append(np.log10(p[on]))
        to = base[k - 1] + below
        then.append((base[k] + on if k < len(strengths) else to[on]).astype(np.int32))
        if k < len(strengths):
            of = np.full(len(words), -1, np.int32)
            of[at] = inverse
        del at, inverse, context, end
        c = count
    root_then = np.where(word_counts > 0, base[0] + np.arange(n_words), 0) if strengths else np.zeros(n_words, np.int64)
    start = int(root_then[words[-1]]) if len(words) else 0
    return Automaton(words, start, base, keys, slots, logs, then, root, root_then, np.concatenate(fail), np.concatenate(weight)), word_counts


def slots_of(keys: np.ndarray) -> np.ndarray:
    """A hash table of distinct keys: each slot holds a key's place, or -1; a key lies in the first free slot from its own on."""
    bits = max(4, (2 * len(keys)).bit_length())
    out, left, at = np.full(1 << bits, -1, np.int32), np.arange(len(keys), dtype=np.int32), _slot(keys, bits)
    while len(left):
        free = out[at] < 0
        out[at[free]] = left[free]
        more = out[at] != left
        left, at = left[more], (at[more] + 1) & ((1 << bits) - 1)
    return out


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)


def found(want: np.ndarray, keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The place of each key that is wanted; -1 if there is none."""
    at = _slot(want, len(slots).bit_length() - 1)
    out = slots[at]
    again = np.flatnonzero((out >= 0) & (keys[out] != want))
    while len(again):
        at[again] = (at[again] + 1) & (len(slots) - 1)
        out[again] = there = slots[at[again]]
        again = again[(there >= 0) & (keys[there] != want[again])]
    return out


def traversed(a: Automaton, texts: Texts) -> np.ndarray:
    """The log-probability of the token at each place; 0 for the end tokens before the texts."""
    warm, out = len(a.keys), np.zeros(len(a.words))
    n = -(-(texts.sizes - 1) // STRETCH)  # stretches of each text
    text = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = texts.starts[text] + 1 + number * STRETCH
    last = np.minimum(first + STRETCH, texts.starts[text] + texts.sizes[text])
    begin = np.maximum(first - warm, texts.starts[text] + 1)
    by = np.argsort(begin - last, kind="stable")  # the longest first
    first, last, begin = first[by], last[by], begin[by]
    state = np.where(begin == texts.starts[text[by]] + 1, a.start, 0)
    length = last - begin
    for t in range(int(length.max(initial=0))):
        m = int(np.searchsorted(-length, -t))  # those that are longer
        s, place = state[:m], begin[:m] + t
        word, log = a.words[place], np.zeros(m)
        left = np.ones(m, bool)  # no arc found yet
        for k in range(len(a.keys) - 1, -1, -1):
            who = np.flatnonzero(left & (s >= a.base[k]))
            if not len(who) or not len(a.keys[k]):
                log[who] += a.weight[s[who]]
                s[who] = a.fail[s[who]]
                continue
            want = s[who].astype(np.int64) * len(a.root) + word[who]
            arc = found(want, a.keys[k], a.slots[k])
            there = arc >= 0
            yes, no, arc = who[there], who[~there], arc[there]
            log[yes] += a.logs[k][arc]
            s[yes] = a.then[k][arc]
            left[yes] = False
            log[no] += a.weight[s[no]]
            s[no] = a.fail[s[no]]
        who = np.flatnonzero(left)
        log[who] += a.root[word[who]]
        s[who] = a.root_then[word[who]]
        counts = place >= first[:m]
        out[place[counts]] = log[counts]
    return out


def scored(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", strengths: tuple[float, ...] = STRENGTHS, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """SCORED for every row; held_out: of rows that the model doesn't learn from. The order is one more than there are strengths."""
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    order, bits = len(strengths) + 1, B.bucket_bits(n_bytes)
    rows, n = B.blocks_of(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_bytes(text_col).alias("text")), n_bytes, block_bytes)
    sent = counted(rows, order, bits)
    size = B.sums_of(sent)
    asking = rows.withColumn("total", size.select("n").scalar()).withColumn("distinct", size.select("v").scalar())

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = Texts(left)
        total, distinct = (left[c][0].as_py() for c in ("total", "distinct"))
        a, c = automaton(texts, lambda k, n: B.told(right, k, n), total, distinct, strengths)
        release()
        score = add(traversed(a, texts), texts)
        there = texts.place > 0
        known, base = (c[a.words] > 0) & there, np.where(there, a.root[a.words], 0)
        columns = [left["doc_id"], left["held_out"], texts.sizes - 1, add(known.astype(np.int64), texts), np.full(len(texts.sizes), total), add(base, texts), score]
        del a
        release()
        return pa.table({name.split()[0]: c for name, c in zip(SCORED.split(", "), columns, strict=True)})

    return asking.groupBy(*B.BLOCK).cogroup(B.added_up(sent, n).groupBy(*B.BLOCK)).applyInArrow(score, SCORED)


def add(x: np.ndarray, texts: Texts) -> np.ndarray:
    """Sums over each text's places."""
    return np.add.reduceat(x, texts.starts) if len(x) else np.zeros(0, x.dtype)


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    return scored(table(spark, sf_dir, "documents"), held_out)
