"""Operators that look at one text at a time: quality rules, BPE, toxicity."""

import hashlib
import math
import random
import struct
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from voltgrain.llm import bpe, quality, toxicity


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30), max_size=5))
@settings(max_examples=60, deadline=None)
def test_repetition(texts):
    got = quality.repetition(texts, 4)
    for w, row in zip(texts, got.tolist(), strict=True):
        assert row == [brute.repeat_words(w), *brute.repeated(w, 4)]


@pytest.mark.parametrize("size", [6, 64, 65, 340, 5000])
def test_long_words_are_words(size):
    """The verdict doesn't hang on a word's bytes: 300 words of which one recurs, and a link written twice."""
    words = [f"w{i}".encode() for i in range(300)]
    link = b"h" * size
    recurring = [link if i % 43 == 0 else w for i, w in enumerate(words)]
    assert quality.repetition([recurring, [*words[:298], link, link]], 15).tolist() == [[0, 0, 1], [0, 0, 1]]


def test_quality_query(spark, sf_dir, rows):
    found = {r["doc_id"]: r for r in quality.op8_quality_rules(spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        r, w = found[i], brute.words(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in quality.SYMBOLS))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (brute.dup_lines(text), brute.repeat_words(w))
        assert r["base_failed"] == (len(w) < 50 or 2 * r["n_repeat_words"] > len(w))
        covered, longest = brute.repeated_spans(w, 15)
        assert (r["covered_words"], r["longest_repeat"]) == (covered, longest)
        assert r["kept"] == (not r["base_failed"] and 5 * covered <= len(w) and longest <= 50)


def test_quality_verdict(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    clean = [word() for _ in range(400)]
    copied = [word() for _ in range(300)] + clean[:0]
    copied += copied[:80]
    noisy = [w + "%%%" for w in clean[:200]]
    docs = spark.createDataFrame([(1, " ".join(clean)), (2, " ".join(copied)), (3, " ".join(noisy)), (4, "too short")], "doc_id long, text string")
    assert {r["doc_id"] for r in quality.quality_filter(docs).collect()} == {1, 3}


def test_quality_odd(spark, odd):
    out = quality.quality_signals(odd)
    assert set(out.columns) == set(odd.columns) and out.count() == odd.count()
    empty = out.filter("doc_id = 1").first()["quality"]
    assert all(v == 0 for v in empty.asDict().values())
    long = out.filter("doc_id = 4").first()["quality"]
    assert long["n_words"] == 3000 * 14 and long["longest_repeat"] > 10
    kept = quality.quality_filter(odd)
    assert kept.columns == odd.columns
    assert quality.quality_filter(odd.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(bpe.default_path())


def test_bpe_query(spark, sf_dir, rows, library):
    found = {r["doc_id"]: r for r in bpe.op5_bpe_encoding(spark, sf_dir).collect()}
    for (i, text), e in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        ids = struct.pack(f"<{len(e.ids)}I", *e.ids)
        decoded = library.decode(e.ids, skip_special_tokens=False).encode()
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(e.ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_bpe_any_text(text):
    import functools

    import tokenizers

    library = functools.cache(tokenizers.Tokenizer.from_file)(bpe.default_path())
    text = "".join(c for c in text if unicodedata.category(c) not in ("Cn", "Cs"))  # what a Unicode version has not assigned, another may have
    ids = np.frombuffer(bpe.loaded(bpe.default_path()).encode(text), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "<|endoftext|>a<|startoftext|>", "ΑΣ ΣΑΣ", "x" * 5000, "I'LL don't 123½", "a\u0085b\x1cc\u2028d"])
def test_bpe_special(text, library):
    assert np.frombuffer(bpe.loaded(bpe.default_path()).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_long(library):
    """Long fragments merge as short ones do; a text without blanks takes seconds."""
    rng = random.Random(2)
    b = bpe.loaded(bpe.default_path())
    for _ in range(20):
        text = "".join(rng.choice("etaoin") for _ in range(rng.randint(40, 400)))
        assert np.frombuffer(b.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    began = time.process_time()
    got = b.encode("".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000)))
    assert len(got) > 400_000 and time.process_time() - began < 60


def test_bpe_long_words(library):
    """Many words too long to be merged side by side take no longer a byte than shorter ones."""
    b, rng = bpe.loaded(bpe.default_path()), random.Random(7)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(1500))
    b.encode("x" * 60)  # tables that are made once
    began = time.process_time()
    got = b.encode(text)
    assert time.process_time() - began < 2
    assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_forgets(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 250_000)
    b = bpe.ByteBPE(bpe.default_path())
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(8000))
    w = text.split()
    got = b"".join(b.encode(" ".join(w[i : i + 500])) for i in range(0, len(w), 500))
    assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert b.of_word.older and len(b.of_chunk.now) + len(b.of_chunk.older) < len(set(w))


def test_bpe_cuts():
    """Fragments are the words, cut wherever a pair of bytes is inside no token."""
    b = bpe.loaded(bpe.default_path())
    letters = bpe.byte_letters()
    inside = {t[i : i + 2] for token in b.vocab for t in [b.bare(token)] for i in range(len(t) - 1)}
    words = [b"zqzq", b"hello", "é".encode(), b"qzqxjx", b"x"]
    flat = np.frombuffer(b"".join(words), np.uint8)
    ends, last = b.cuts(flat, np.cumsum([len(w) for w in words]))
    want, at = [], 0
    for w in words:
        for i in range(1, len(w) + 1):
            if i == len(w) or letters[w[i - 1]] + letters[w[i]] not in inside:
                want.append((at + i, i == len(w)))
        at += len(w)
    assert list(zip(ends.tolist(), last.tolist(), strict=True)) == want and len(want) > len(words)


def test_bpe_odd(spark, odd):
    out = bpe.encoded(odd)
    assert set(out.columns) == set(odd.columns) and out.count() == odd.count()
    assert out.filter("doc_id = 1").first()["bpe"]["ids"] == []
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [320, None, -1, 10**8, 320])], "doc_id long, ids array<int>")
    word = bpe.loaded(bpe.default_path()).tokens[320].as_py()
    assert {r["doc_id"]: r["decoded"] for r in bpe.decoded(nulls).collect()} == {1: "", 2: "", 3: f"{word} {word}"}
    back = bpe.decoded(out.select("doc_id", F.col("bpe.ids").alias("ids"), F.col("bpe.decoded").alias("want")))
    assert back.filter("decoded <> want").count() == 0
    assert bpe.digests(odd.limit(0)).count() == 0


TOXIC = ["grumblefoul", "nastyword", "vilething", "scumtalk"]


def corpus(rng, n, share=0.3):
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        toxic = rng.random() < share
        w = [rng.choice(plain) for _ in range(rng.randint(30, 120))]
        if toxic:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(TOXIC))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity_held_out(spark):
    data = corpus(random.Random(3), 900)
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.col("doc_id") % 5 != 0)
    got = toxicity.scored(df, model).filter("doc_id % 5 = 0").select("toxic", "score").collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in got) >= 0.95 * len(got)


def test_toxicity_late_passage(spark):
    """Toxic words after the first 20,000 characters teach as others do, and long clean texts stay clean."""
    rng = random.Random(6)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    data = []
    for i in range(240):
        w = [rng.choice(plain) for _ in range(3600)]
        if i % 3 == 0:
            for _ in range(6):
                w.insert(rng.randrange(3450, len(w)), rng.choice(TOXIC))
            assert min(" ".join(w).find(x) for x in TOXIC if x in w) > 20_000
        data.append((i, " ".join(w), int(i % 3 == 0)))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int").repartition(8)
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.col("doc_id") % 4 != 0)
    got = toxicity.scored(df, model).filter("doc_id % 4 = 0").select("toxic", "score").collect()
    assert sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in got) >= 0.95 * len(got)


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(5, 1), (5, None), (None, 1), (6, 0), (99, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, F.lit(True))
    assert model.weights == [] and model.prior == pytest.approx(1 / 3)
    out = toxicity.scored(odd, model)
    assert out.count() == odd.count() and out.columns == odd.columns
    assert toxicity.fit(odd, labels.limit(0), F.lit(True)).prior == 0
    some = toxicity.fitted([(t.encode(), y) for _, t, y in corpus(random.Random(5), 80)], 0.3)
    assert toxicity.scored(odd, some).filter("score between 0 and 1").count() == odd.count()
    assert toxicity.scored(odd.limit(0), some).count() == 0


def test_toxicity_query(spark, sf_dir, rows):
    """The query's scores from windows that are compressed one by one, with the model it fits."""
    out = toxicity.op4_toxicity(spark, sf_dir)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(rows)
    assert out.filter("predicted <> cast(score >= 0.5 as int)").count() == 0
    found = {r["doc_id"]: r for r in out.collect()}
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    model = toxicity.fit(table("documents"), table("labels"), ~held)
    assert len(model.pairs) == len(toxicity.SIZES)

    def length(window, dictionary):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(window))

    for i, text in rows[:25]:
        text, cuts = (text or "").lower().encode(), []
        while text:
            j = len(text) if len(text) <= toxicity.WINDOW else text.rfind(b" ", 0, toxicity.WINDOW) + 1 or toxicity.WINDOW
            cuts.append(b" " + text[:j])
            text = text[j:]
        each = [[length(w, ordinary) - length(w, toxic) for w in cuts] or [0] for toxic, ordinary in model.pairs]
        x = []
        for d, steps in [*((d, toxicity.THRESHOLDS) for d in each), ([sum(z) for z in zip(*each, strict=True)], toxicity.SUM_THRESHOLDS)]:
            x += [min(max(d), 30), *(math.log1p(sum(y >= t for y in d)) for t in steps)]
        x.append(math.log1p(len(cuts)))
        z = sum(a * b for a, b in zip(x, model.weights, strict=False)) + model.weights[-1]
        assert found[i]["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))


def test_toxicity_real_labels(spark):
    """Held-out labels of a larger table: the area under the curve."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    asked = labels.filter(held & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, ~held)
    got = toxicity.scored(docs.join(asked, "doc_id").select("toxic", "text"), model).select("toxic", "score").collect()
    rank = {id(r): i for i, r in enumerate(sorted(got, key=lambda r: r["score"]))}
    toxic = [rank[id(r)] for r in got if r["toxic"]]
    area = (sum(toxic) - len(toxic) * (len(toxic) - 1) / 2) / (len(toxic) * (len(got) - len(toxic)))
    print(f"area under the curve {area:.4f} of {len(toxic)} toxic and {len(got) - len(toxic)} other held-out texts")
    assert area > 0.9


def test_toxicity_wrong_labels():
    """A few wrong labels strike out no word that one kind of text has far more often; words that both have stay out."""
    rng = random.Random(11)
    rows = [(t.encode(), y) for _, t, y in corpus(rng, 400)]
    turned = [(t, y ^ (i % 20 == 0)) for i, (t, y) in enumerate(rows)]

    def own(some):
        seen = {0: Counter(), 1: Counter()}
        for text, y in some:
            seen[y].update(toxicity.words_of(text))
        return seen, toxicity.vocabulary(seen, Counter(y for _, y in some))

    (_, right), (seen, found) = own(rows), own(turned)
    spoken = {w.encode() for w in TOXIC} & right.toxic
    assert spoken and any(seen[0][w] for w in spoken)  # texts of the other label have them now
    assert spoken <= found.toxic and not found.toxic & found.ordinary
    model = toxicity.fitted(turned, 0.3)
    asked = [(t.encode(), y) for _, t, y in corpus(random.Random(12), 200)]
    x = toxicity.features([t for t, _ in asked], toxicity.compressors(model.pairs))
    score = x @ np.array(model.weights[:-1]) + model.weights[-1]
    pairs = [a > b for a, (_, y) in zip(score, asked, strict=True) if y for b, (_, z) in zip(score, asked, strict=True) if not z]
    assert sum(pairs) > 0.9 * len(pairs)
