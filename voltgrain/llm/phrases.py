r"""Operator 12, phrase collocation mining by dynamic itemset counting.

Documents are encoded once, in shards: a language's words as 64-bit hashes, 0 where a phrase can't go on. The shards are
scanned in a cycle. Words are counted from the start; a longer phrase is activated at the stop after which its first and
its last words (all but one) have both reached the threshold, and is then counted in the scans that follow until it has
completed one full cycle. So lengths interleave: pairs of common words are counted while rarer words are.

A scan has to know which phrases have reached the threshold. It gets them as a filter of a fixed number of bits (at most
FILTER_BYTES, however many phrases there are), which only grows from stop to stop. Its false hits activate some phrases
early, never late, and a phrase is counted in one full cycle from its activation all the same: what counts as
activated is a function of the phrase and the stop's filter alone. A filter that is too small for a corpus lets more phrases
be counted; counts stay exact. Counts are pre-aggregated in each task, so no phrase is hot, and shuffled packed, a row for each
bucket of keys (voltgrain.llm.blocks); each bucket is added up alone.

A scan's counts are written as its tasks make them, with the phrase's phase: which scan of its cycle this is. The stop that
ends a phrase's cycle adds its counts up, once. Stops before that add up what tasks have met twice or more: what reaches the
threshold even so has reached it. When no new phrase has reached the threshold for a full cycle, all counts are complete.
Phrases are known by their hashes until then; scans of growing parts of the corpus, while any is missing, find the words of
those at or above the threshold. Cuts
are scored in whole decimals (38 digits). The best of a language are ranked in parts first, then together. Equality of
phrases is that of 64-bit hashes, which mix in the language.

Null languages count as `und`, together with documents that say so; null and empty texts have no words, repeated rows count
each, a very long text is scanned in stretches. Ties end with the phrase in UTF-8 order, so ranks are unique. An empty table gives
no rows. Other columns are ignored, whatever they are named.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltgrain.llm import blocks as B
from voltgrain.llm.blocks import joined
from voltgrain.llm.common import dropped, new_path, release, stored, table, text_bytes, tidied, written

LONGEST, SHARDS = 5, 2
#: Bits of the filter for each phrase that may reach the threshold (a tenth of these do), and the most bytes it takes.
FILTER_BITS, FILTER_BYTES = 8, 16 << 20
#: Bytes of text that are encoded together, words that are scanned together, phrases whose counts a task holds.
ENCODE_BYTES, SCAN_WORDS, HELD = 4 << 20, 1 << 18, 1 << 19
#: Parts in which a language's phrases are ranked first.
RANK_PARTS = 64
BREAK = b"\n"
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\t"
#: Parts of the corpus, and up to which of them each search for words goes.
PARTS, SEARCHES = 64, (0, 1, 4, 16, 64)
ENCODED = "part int, words array<long>, key long, lang string, word string, n long"
COUNTED = "bucket int, phase int, hashes binary, counts binary"
#: Words for each bucket of phrases; a scan has at most a few times as many counts.
BUCKET_WORDS = 1 << 21
SEEN = "key long, words array<long>"


def _translation() -> bytes:
    out = bytearray(range(256))
    out[ord("A") : ord("Z") + 1] = bytes(range(ord("a"), ord("z") + 1))
    for c in BREAKS:
        out[c] = ord(BREAK)
    for c in BLANKS:
        out[c] = ord(" ")
    return bytes(out)


FOLDED = _translation()


def tagged(keys: np.ndarray, length: int) -> np.ndarray:
    """Hashes with the phrase's length in their last three bits."""
    return (keys & ~np.uint64(7)) | np.uint64(length)


def phrase_key(words: list[np.ndarray]) -> np.ndarray:
    """The key of each row of words."""
    return reduce(lambda key, x: tagged(joined([key, x[1]]), x[0]), enumerate(words[1:], 2), words[0])


def length_of(key: str = "key") -> Column:
    return F.col(key).bitwiseAND(7)


def encoded(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """The documents' words as hashes, and, beside them, each task's words with their counts. A task's rows are in one part."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_bytes(text_col).alias("text"))
    schema = pa.schema([("part", pa.int32()), ("words", pa.list_(pa.int64())), ("key", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def words_of_task(part: int, held: list[tuple]) -> pa.RecordBatch:
        """Words that were met in several units, once."""
        keys = np.concatenate([h[0] for h in held])
        first, place = B.ranked(keys)
        keys = keys[first]
        n = np.bincount(place, np.concatenate([h[1] for h in held]), len(keys)).astype(np.int64)
        take = lambda i: pa.concat_arrays([h[i] for h in held]).take(pa.array(first))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), pa.nulls(len(keys)).cast(schema.types[1]), pa.array(keys.view(np.int64)), take(2), take(3), pa.array(n)], schema=schema)

    def unit(part: int, held: list[tuple], langs: list[str], texts: list[bytes]) -> pa.RecordBatch:
        words = B.Words.of(texts, lambda raw: raw.translate(FOLDED))
        n_words, per_text = len(words.starts), words.per_text()
        of = {lang: np.uint64(xxhash.xxh3_64_intdigest(lang.encode())) for lang in set(langs)}
        keys = tagged(joined([np.repeat(np.array([of[x] for x in langs], np.uint64), per_text), words.hashes]), 1)
        # Where each word goes: behind a 0 if a break is before it, which may end the text before. Another 0 ends the last text.
        breaks = np.cumsum(np.frombuffer(words.raw, np.uint8) == BREAK[0], dtype=np.int32)[words.starts]
        place = np.arange(n_words) + np.cumsum(np.diff(breaks, prepend=breaks[:1]) > 0)
        size = int(place[-1]) + 2 if n_words else 0
        flat = np.zeros(size, np.uint64)
        flat[place] = keys
        begins = np.cumsum(per_text) - per_text
        lists = pa.ListArray.from_arrays(pa.array(np.append(place, size)[np.append(begins, n_words)].astype(np.int32)), pa.array(flat.view(np.int64)))
        by = np.argsort(keys)
        ordered = keys[by]
        new = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[:n_words])
        if len(new):
            first = by[new]
            doc = np.searchsorted(begins, first, side="right") - 1
            held.append((ordered[new], np.diff(np.append(new, n_words)), pa.array(langs).take(pa.array(doc)), strings(words, first)))
        rows = pa.nulls(len(texts))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), part, np.int32)), lists, *(rows.cast(t) for t in schema.types[2:])], schema=schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId() % PARTS, []
        for batch in it:
            sizes = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(sizes // ENCODE_BYTES, prepend=0)).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
                if a < b:
                    yield unit(part, held, batch["lang"][a:b].to_pylist(), batch["text"][a:b].to_pylist())
                if sum(len(h[0]) for h in held) >= HELD // 2:
                    yield words_of_task(part, held)
                    held.clear()
        if held:
            yield words_of_task(part, held)
        release()

    path = new_path(docs.sparkSession, "phrases-shards")
    # Hashes of words recur: a larger dictionary keeps them small on disk.
    rows.mapInArrow(batches, ENCODED).write.option("parquet.dictionary.page.size", 8 << 20).parquet(path)
    return docs.sparkSession.read.schema(ENCODED).parquet(path)


def strings(words: B.Words, some: np.ndarray) -> pa.Array:
    """Some of the words as strings."""
    sizes = words.ends[some] - words.starts[some]
    ends = np.cumsum(sizes)
    data = np.frombuffer(words.raw, np.uint8)[np.arange(ends[-1]) + np.repeat(words.starts[some] - (ends - sizes), sizes)]
    found = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])
    try:
        return found.cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()])


class Filter:
    """A set of hashes in a fixed number of 64-bit words: three bits of one word for each."""

    def __init__(self, phrases: int) -> None:
        words = max(1, min(phrases * FILTER_BITS, FILTER_BYTES * 8) // 64)
        self.bits = max(6, (words - 1).bit_length())
        self.words = np.zeros(1 << self.bits, np.uint64)

    def with_(self, keys: DataFrame) -> tuple[np.ndarray, bool]:
        """The filter's words with a table's keys, and whether that changes them. What reaches the driver is no larger than
        the filter."""
        key = F.col("key")
        bit = lambda shift: F.expr(f"shiftleft(1L, cast(shiftright(key, {shift}) & 63 as int))")
        masks = keys.select(F.shiftrightunsigned(key, 64 - self.bits).alias("at"), bit(3).bitwiseOR(bit(9)).bitwiseOR(bit(15)).alias("mask"))
        found = masks.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
        at, mask = found["at"].to_numpy(), found["mask"].to_numpy().view(np.uint64)
        out = self.words.copy()
        out[at] |= mask
        return out, bool((out != self.words).any())


def within(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys are in a filter."""
    one, low = np.uint64(1), np.uint64(63)
    mask = (one << ((keys >> np.uint64(3)) & low)) | (one << ((keys >> np.uint64(9)) & low)) | (one << ((keys >> np.uint64(15)) & low))
    found = words[(keys >> np.uint64(64 - (len(words).bit_length() - 1))).astype(np.int64)]
    return (found & mask) == mask


def activated(flat: np.ndarray, filters: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 2 on: the places of activated phrases in flat, their keys, and how many stops ago that was. filters:
    the newest and those of the stops before."""
    on = [within(words, flat) & (flat != 0) for words in filters]
    keys = flat.copy()
    for length in range(2, LONGEST + 1):
        at = np.flatnonzero(on[0][:-1] & on[0][1:])
        at = at[at + length <= len(flat)]
        found = tagged(joined([keys[at], flat[at + length - 1]]), length)
        age = sum((x[at] & x[at + 1] for x in on[1:]), np.zeros(len(at), np.int8))
        yield length, at, found, age
        if not len(at) or length == LONGEST:
            break
        keys[at] = found
        for j, words in enumerate(filters):
            there = within(words, found) & (age >= j)
            on[j] = np.zeros(len(flat), bool)
            on[j][at] = there


def stretches(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    """Words in stretches, and how many of them phrases begin in; the others are only there to end phrases."""
    for batch in it:
        column = batch["words"]
        flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        for a in range(0, len(flat), SCAN_WORDS):
            yield flat[a : a + SCAN_WORDS + LONGEST - 1], min(SCAN_WORDS, len(flat) - a)


class Held:
    """Keys of phrases of one phase, and how often each was met, until there are enough to count."""

    def __init__(self, phase: int, bits: int) -> None:
        self.phase, self.bits, self.keys, self.times, self.n = phase, bits, [], [], 0

    def add(self, keys: np.ndarray, times: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        if times is not None:
            self.times.append(times)
        self.n += len(keys)
        if self.n >= HELD:
            yield from self.counts()

    def counts(self) -> Iterator[pa.RecordBatch]:
        """A row for each bucket that has any."""
        if self.n:
            keys, times, self.keys, self.times, self.n = np.concatenate(self.keys), self.times, [], [], 0
            found = B.totals(keys, np.concatenate(times)) if times else B.told_apart(keys, np.ones(len(keys), bool))
            rows = [(bucket, self.phase, hashes, n) for _, _, bucket, hashes, n in B.sent(0, 0, *found, self.bits)]
            yield B.rows_of(rows, COUNTED).to_batches()[0]


def words_counted(words: DataFrame, phase: int, bits: int) -> DataFrame:
    """COUNTED from words (key, n)."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(phase, bits)
        for batch in it:
            yield from held.add(batch["key"].to_numpy().view(np.uint64), batch["n"].to_numpy())
        yield from held.counts()
        release()

    return words.mapInArrow(count, COUNTED)


def scanned(shard: DataFrame, told: Broadcast, bits: int) -> DataFrame:
    """Counts, by task and phase, of the shard's phrases that are activated and have not completed their cycle. told: the newest
    filter and one for each stop of the cycle before."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = told.value
        held = {(k, age): Held(age + 1, bits) for k in range(2, LONGEST + 1) for age in range(len(filters) - 1)}
        for flat, n in stretches(it):
            for length, at, keys, age in activated(flat, filters):
                age = np.where(at < n, age, len(filters))
                for k in range(len(filters) - 1):
                    yield from held[length, k].add(keys[age == k])
        for some in held.values():
            yield from some.counts()
        release()

    return shard.mapInArrow(count, COUNTED)


def added(complete: list[DataFrame], early: list[DataFrame], threshold: int, bits: int) -> DataFrame:
    """key, n, early of what reaches the threshold in complete counts, and in early ones (early), of which those of what a task
    has met once only are left for the end of the cycle."""
    mark = lambda rows, early: [x.withColumn("early", F.lit(early)) for x in rows]
    rows = reduce(DataFrame.unionByName, [*mark(complete, False), *mark(early, True)])

    def add(rows: pa.Table) -> pa.Table:
        is_early, out = rows["early"].to_pylist(), []
        for kind in sorted(set(is_early)):
            some = [i for i, x in enumerate(is_early) if x == kind]
            keys = np.concatenate([B.unpacked(rows["hashes"][i].as_py()) for i in some])
            times = np.concatenate([B.unpacked_counts(rows["counts"][i].as_py()) for i in some])
            if kind:
                keys, times = keys[times > 1], times[times > 1]
            keys, times = B.totals(keys, times)
            on = times >= threshold
            out.append(pa.table({"key": keys[on].view(np.int64), "n": times[on], "early": np.full(int(on.sum()), kind)}))
        release()
        return pa.concat_tables(out)

    return B.spread(rows, bits).groupBy(*B.BUCKET).applyInArrow(add, "key long, n long, early boolean")


def phrase_counts(corpus: DataFrame, threshold: int, shards: int) -> tuple[DataFrame, Filter]:
    """Exact counts (key, n) of all phrases of up to LONGEST words with threshold occurrences, and the filter of those that can
    go on."""
    spark = corpus.sparkSession
    words = corpus.filter("key is not null")
    total = words.agg(F.sum("n")).first()[0] or 0
    bits = max(1, (total // BUCKET_WORDS).bit_length())
    reached = Filter(LONGEST * total // threshold + 1)  # no more phrases can reach the threshold
    none = reached.words
    filters = [none] * (shards + 1)  # the newest first
    counted: dict[int, tuple[DataFrame, str]] = {}
    found: list[DataFrame] = []
    step, last_new, told = 0, 0, None
    while step < max(last_new, 1) + shards:
        step += 1
        own = F.col("part") % shards == (step - 1) % shards
        rows = [words_counted(words.filter(own).select("key", "n"), step, bits)] if step <= shards else []
        if last_new:
            told = spark.sparkContext.broadcast(filters)
            rows.append(scanned(corpus.filter(own & F.col("words").isNotNull()).select("words"), told, bits))
        if not rows:
            break
        counted[step] = stored(reduce(DataFrame.unionByName, rows), "phrases-counts")
        if told:
            told.destroy()
        of = lambda ago, phase: counted[step - ago][0].filter(F.col("phase") == phase)  # noqa: B023, E731
        complete = [of(shards - j, j) for j in range(1, shards + 1) if step - shards + j in counted]
        early = [of(ago, phase) for ago in range(shards - 1) for phase in range(1, shards - ago) if step - ago in counted]
        stop = written(added(complete, early, threshold, bits), "phrases-found")
        found.append(stop.filter("not early").select("key", "n"))
        now, new = _replaced(reached, filters[0]).with_(stop.filter(length_of() < LONGEST))
        filters = [now, *filters[:-1]]
        if new:
            last_new = step
        if step - shards + 1 in counted:
            dropped(spark, counted.pop(step - shards + 1)[1])
        tidied(spark)
    return written(reduce(DataFrame.unionByName, found), "phrases-all"), _replaced(reached, filters[0])


def _replaced(of: Filter, words: np.ndarray) -> Filter:
    out = Filter.__new__(Filter)
    out.bits, out.words = of.bits, words
    return out


def phrase_words(corpus: DataFrame, found: DataFrame, reached: Filter) -> DataFrame:
    """found (key, n) of two words or more with the hashes of their words. They are looked for in one part of the corpus, then in
    four times as many: a phrase that is still missing then is rare, so that it is found a few times, not once a task."""
    missing, done = found.filter(length_of() > 1), []
    context = corpus.sparkSession.sparkContext
    empty = _replaced(reached, np.zeros_like(reached.words))
    for low, high in zip(SEARCHES, SEARCHES[1:], strict=False):
        asked, any_left = empty.with_(missing)
        if not any_left:
            break
        told = context.broadcast((reached.words, asked))

        def look(it: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            now, asked = told.value
            met = np.zeros(0, np.uint64)  # keys that this task has found, in order
            for flat, n in stretches(it):
                new = []
                for length, at, keys, _ in activated(flat, [now]):
                    on = (at < n) & within(asked, keys)
                    keys, first = np.unique(keys[on], return_index=True)
                    fresh = ~_in(keys, met)
                    keys, at = keys[fresh], at[on][first[fresh]]
                    if len(keys):
                        words = flat[at[:, None] + np.arange(length)].view(np.int64)
                        ends = np.arange(len(keys) + 1, dtype=np.int32) * length
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(words.ravel()))], names=["key", "words"])
                        new.append(keys)
                met = np.sort(np.concatenate([met, *new]))
            release()

        part = F.col("part")
        rows = corpus.filter((part >= low) & (part < high) & F.col("words").isNotNull()).select("words").mapInArrow(look, SEEN)
        met = written(rows.groupBy("key").agg(F.min("words").alias("words")), "phrases-words")
        told.destroy()
        done.append(missing.join(met, "key"))
        if high < PARTS:
            missing = written(missing.join(met, "key", "left_anti"), "phrases-missing")
    if not done:
        return missing.withColumn("words", F.expr("cast(null as array<long>)"))
    return written(reduce(DataFrame.unionByName, done), "phrases-candidates")


def _in(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of keys are in of, which is in order."""
    if not len(of):
        return np.zeros(len(keys), bool)
    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys


def common_words(corpus: DataFrame, threshold: int) -> DataFrame:
    """key, lang, word of the words that reach the threshold."""
    same = corpus.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n"), F.min("lang").alias("lang"), F.min("word").alias("word"))
    return same.filter(F.col("n") >= threshold).select("key", "lang", "word")


CUT = "key long, k int, l_key long, r_key long"


def _cuts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of a phrase's first k words and of the others, for each k."""
    for batch in it:
        lens = pc.list_value_length(batch["words"]).to_numpy(zero_copy_only=False)
        own = batch["key"].to_numpy(zero_copy_only=False)
        for length in np.unique(lens).tolist():
            rows = np.flatnonzero(lens == length)
            words = batch["words"].take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, length)
            for k in range(1, length):
                left, right = (phrase_key([words[:, i] for i in some]) for some in (range(k), range(k, length)))
                yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(np.full(len(rows), k, np.int32)), pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], names=["key", "k", "l_key", "r_key"])


def score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)) in whole numbers; each of them may have 16 digits."""
    whole = lambda c: f"cast({c} as decimal(17,0))"
    times = lambda x, y: f"cast({whole(x)} * {whole(y)} as decimal(34,0))"
    return F.expr(f"cast(cast({times(a, n)} * 1000 as decimal(38,0)) div {times(left, right)} as long)")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", threshold: int = 100, top: int = 2000, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to LONGEST words."""
    corpus = encoded(docs, text_col, lang_col)
    found, reached = phrase_counts(corpus, threshold, shards)
    phrases = phrase_words(corpus, found, reached)
    cuts = written(phrases.select("key", "words").mapInArrow(_cuts, CUT), "phrases-cuts")
    # A phrase is no more than a longer one's part if one with a word more occurs as often.
    more = phrases.select("key", "n", length_of().alias("len")).filter("len > 2").join(cuts, "key")
    parts = more.filter("k = 1").select(F.col("r_key").alias("key"), "n").unionByName(more.filter("k = len - 1").select(F.col("l_key").alias("key"), "n"))
    longer = parts.groupBy("key").agg(F.max("n").alias("longer"))
    closed = phrases.join(longer, "key", "left").filter("longer is null or longer < n").select("key", F.col("n").alias("a"), "words")
    words = corpus.filter("key is not null")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    strings = written(common_words(corpus, threshold), "phrases-strings")
    of = lambda side: found.select(F.col("key").alias(f"{side}_key"), F.col("n").alias(side))
    langs = strings.select(F.col("key").alias("first"), "lang").join(totals, "lang")
    scored = closed.withColumn("first", F.col("words")[0]).join(langs, "first").drop("first").join(cuts, "key").join(of("l"), "l_key").join(of("r"), "r_key")
    scored = scored.withColumn("score", score("a", "n", "l", "r"))
    cut = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = scored.groupBy("key", "lang", "a", "n").agg(cut, F.first("words").alias("words"))
    scored = written(scored.select("key", "lang", "a", "n", "words", "cut.score", "cut.l", "cut.r"), "phrases-scored")
    best = scored.withColumn("part", F.pmod(F.shiftright("key", 8), F.lit(RANK_PARTS)))
    order = (F.desc("score"), F.desc("a"))
    for by in (("lang", "part"), ("lang",)):  # equals stay: their strings decide
        best = best.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    best = written(best.drop("part", "rank"), "phrases-best")
    spelled = best.select("key", F.posexplode("words").alias("i", "w")).join(strings.select(F.col("key").alias("w"), "word"), "w")
    spelled = spelled.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list(F.struct("i", "word")))["word"], " ").alias("phrase"))
    ranked = best.join(spelled, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _sql(threshold: int = 100, top: int = 2000) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS len, unnest([array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k} + 2)]) AS phrase FROM p" for k in range(1, LONGEST + 1))
    first = lambda k: f"array_to_string(string_split(c.phrase, ' ')[:{k}], ' ')"
    rest = lambda k: f"array_to_string(string_split(c.phrase, ' ')[{k + 1}:], ' ')"
    cuts = " UNION ALL ".join(f"SELECT c.*, {k} AS k, {first(k)} AS left_part, {rest(k)} AS right_part FROM closed c WHERE len > {k}" for k in range(1, LONGEST))
    return rf"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
f AS MATERIALIZED (SELECT lang, len, phrase, count(*) AS a FROM ({grams}) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE a >= {threshold}),
inner_parts AS (
  SELECT lang, phrase[:length(phrase) - length(string_split(phrase, ' ')[len]) - 1] AS phrase, a FROM c WHERE len > 2
  UNION ALL SELECT lang, phrase[length(string_split(phrase, ' ')[1]) + 2:] AS phrase, a FROM c WHERE len > 2),
closed AS (
  SELECT c.* FROM c LEFT JOIN (SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY ALL) i USING (lang, phrase)
  WHERE c.len > 1 AND coalesce(i.longer < c.a, true)),
k AS ({cuts}),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, n.n, CAST((1000::HUGEINT * k.a * n.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM k JOIN c l ON l.lang = k.lang AND l.phrase = k.left_part JOIN c r ON r.lang = k.lang AND r.phrase = k.right_part JOIN n ON n.lang = k.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS INTEGER) AS rank FROM m)
SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= {top}
"""


OP12_SQL = _sql()
