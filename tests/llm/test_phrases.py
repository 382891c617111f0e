"""Phrase mining."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import same
from voltgrain.llm import phrases


def brute(rows, threshold, top):
    """By the definition: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    many = {p: n for p, n in counts.items() if n >= threshold}
    inside = {}
    for p, n in many.items():
        for i in range(1, len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p) - 1:
                    inside[p[0], *p[i:j]] = max(n, inside.get((p[0], *p[i:j]), 0))
    out = {}
    for p, a in many.items():
        if len(p) > 2 and inside.get(p, 0) < a:
            lang, words = p[0], p[1:]
            cuts = [(1000 * a * totals[lang] // (many[lang, *words[:k]] * many[lang, *words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), many[lang, *words[:k]], many[lang, *words[k:]]))
    return sorted((lang, r, x[2].decode(), -x[1], x[3], x[4], totals[lang], -x[0]) for lang, found in out.items() for r, x in enumerate(sorted(found)[:top], 1))


def mined(df, **how):
    return sorted(tuple(r) for r in phrases.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_query(spark, sf_dir, duck):
    assert same(phrases.op12_phrase_mining(spark, sf_dir), duck.sql(phrases.OP12_SQL))


def test_phrases_sql_at_a_lower_threshold(docs, duck):
    assert same(phrases.collocations(docs, threshold=12, top=300), duck.sql(phrases._sql(12, 300)))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    vocabulary = ["a", "b", "C", "c", "é", "É", "日本", "x\x00y", "\x1f", "don't", "\U0001f600", "￿", "longer-word"]
    rows = [(" ".join(rng.choices(vocabulary, weights=range(13, 0, -1), k=rng.randrange(40))), rng.choice(["en", "EN", None, "und", ""])) for _ in range(300)]
    rows += [("A b\tc.  a b c,a b\nc;a b\x0bc:a b\x0cc!a b\rc?a b c", "en"), (None, "en"), ("", None), (".,;", "en"), ("same words here again and again", "fr")]
    rows += [("same words here again and again", "fr")] * 9 + [("stop " * 30_000, "en"), (" ".join(f"w{i % 7}" for i in range(5000)), "zz")]
    return rows


@pytest.mark.parametrize("shards", [1, 3])
@pytest.mark.parametrize("filter_bytes", [8, 1 << 20])
def test_phrases_odd(spark, odd_rows, monkeypatch, shards, filter_bytes):
    """Nulls, empty and long texts, every break, other scripts, ties, repeated rows, clashing names; a filter that lets all through."""
    monkeypatch.setattr(phrases, "FILTER_BYTES", filter_bytes)
    df = spark.createDataFrame(odd_rows, "text string, lang string").repartition(6).withColumns({c: F.lit(1) for c in ("key", "n", "word", "words", "shard", "rank")})
    assert mined(df, threshold=5, top=60, shards=shards) == brute(odd_rows, 5, 60)


def test_phrases_none(spark):
    df = spark.createDataFrame([("a b", "en")], "text string, lang string")
    assert mined(df) == [] and mined(df.limit(0)) == []


def test_score_is_exact(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randrange(1, 10**rng.randrange(1, 16)) for _ in range(4)) for _ in range(500)]
    rows = [(a, n, max(1, x), max(1, y)) for a, n, x, y in rows if 1000 * a * n // (x * y) < 2**63] + [(10**15, 10**15, 10**15, 10**15), (3, 10**15, 7, 10**15 - 1)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    for r in df.withColumn("s", phrases.score("a", "n", "l", "r")).collect():
        assert r["s"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"])


def test_counts_are_packed(spark):
    """A scan's counts travel as a row for each bucket, not one for each phrase; what has been met once in a task waits for the end."""
    words = spark.range(4000).selectExpr("(id % 1000) * 4611686018427387 as key", "id % 3 + 1 as n").coalesce(2)
    packed = phrases.words_counted(words, 1, 2).persist()
    assert packed.count() <= 2 * 4
    want = {(r["key"], r["n"]) for r in words.groupBy("key").agg(F.sum("n").alias("n")).filter("n >= 8").collect()}
    found = phrases.added([packed], [packed.withColumn("phase", F.lit(2))], 8, 2).collect()
    assert {(r["key"], r["n"]) for r in found if not r["early"]} == want and 0 < len(want) < 1000
    assert {(r["key"], r["n"]) for r in found if r["early"]} <= want
    packed.unpersist()


def test_encoded_words(spark):
    rows = [(1, "A b. b\ta", "x"), (2, None, "x"), (3, "..", None), (4, "", "x"), (5, "!b " + "q" * 70, "x"), (6, None, "y")]
    corpus = phrases.encoded(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), "text", "lang")
    of = {r["key"]: (r["lang"], r["word"], r["n"]) for r in corpus.filter("key is not null").collect()}
    assert sorted(of.values()) == [("x", "a", 2), ("x", "b", 3), ("x", "q" * 70, 1)]
    flat = [of[w][1] if w else "" for r in corpus.filter("words is not null").collect() for w in r["words"]]
    assert flat == ["a", "b", "", "b", "a", "", "b", "q" * 70, ""]
