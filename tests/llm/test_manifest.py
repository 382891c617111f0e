"""Merkle manifest and its proofs."""

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import same
from voltgrain.llm import merkle


def H(*parts):
    return hashlib.sha256(b"".join(p if isinstance(p, bytes) else p.encode() for p in parts)).hexdigest()


def leaf(row):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, i):
    """Left and right of the i-th leaf's ancestor at each level."""
    for nodes in levels[:-1]:
        first = i // 16 * 16
        yield nodes[first:i], nodes[i + 1 : first + 16]
        i //= 16


def brute(rows):
    """Every row by the definition: doc_id, leaf, subroot, root, proof, folded root."""
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0], leaf(r), leaf((*r[:4], r[4] and r[4].translate(lower)))))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(levels_of([x[1] for x in by_source[s]]))
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, digest, other) in enumerate(by_source[s]):
            path = [*siblings(trees[k], i), *siblings(top, k)]
            at = other if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else digest
            for left, right in path:
                at = H(*left, at, *right)
            out.append((doc_id, digest, trees[k][-1][0], top[-1][0], H(*(x for pair in path for side in pair for x in side)), at))
    return out


def of(df, **more):
    tampered = merkle.leaf(*(F.translate("text", merkle.UPPER, merkle.LOWER) if c == "text" else F.col(c) for c in merkle.COLUMNS))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.proofs(merkle.manifest(df, changed=F.when(chosen, tampered), **more))


KEY = lambda r: tuple((x is None, x) for x in r)


def test_manifest_query(spark, sf_dir, duck):
    assert same(merkle.op13_merkle_manifest(spark, sf_dir), duck.sql(merkle.OP13_SQL))


def test_manifest_odd(spark):
    """Deep and lone trees, nulls, repeated rows and ids, long texts, clashing names; blocks that cut runs in two."""
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(4200)]
    rows += [(i, f"s{i % 40}", None, None, "Aé" * (i % 3)) for i in range(5000, 5300)]
    rows += [(None, None, None, None, None), (None, None, None, None, ""), (7, None, "x", 1, "LONG " * 100_000), (1, "twice", "x", 1, "Same"), (1, "twice", "x", 1, "Same"), (1, "twice", "x", 2, "Other"), (None, "hot", "en", 3, "No id"), (5, "", "", 0, "Z"), (6, "\U0001f600", "", 0, "Z"), (6, "￿", "", 0, "Z"), (-3, "lone", "", 0, "Q")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7).withColumns({c: F.lit(c) for c in ("leaf", "tree", "place", "block", "root", "at", "part", "id")})
    want = sorted(brute(rows), key=KEY)
    for block_leaves in (100, 4096):
        got = of(df, block_leaves=block_leaves).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
        assert sorted((tuple(r[:6]) for r in got), key=KEY) == want
        assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
        assert sum(not r["verified"] for r in got) > 500
    none = of(df.limit(0))
    assert none.count() == 0 and merkle.manifest(df.limit(0)).root is None


def test_one_row(spark):
    row = (1, "s", None, None, "x")
    df = spark.createDataFrame([row], "doc_id long, source string, lang string, n_chars long, text string")
    assert tuple(of(df).select("leaf", "subroot", "root", "proof_sha256", "verified").first()) == (leaf(row), leaf(row), leaf(row), H(), True)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5000), st.data())
def test_lacking_is_minimal(size, data):
    """What is fetched is what a climb from the leaves needs and doesn't make itself."""
    known = np.unique(data.draw(st.lists(st.integers(0, size - 1), min_size=1, max_size=40)))
    have, n = set(known.tolist()), size
    for _level, runs, gone in merkle.lacking(known, size):
        need = {k for p in have for k in range(p // 16 * 16, min(p // 16 * 16 + 16, n))}
        assert set(gone.tolist()) == need - have
        have, n = {p // 16 for p in have}, -(-n // 16)
        assert set(runs.tolist()) == have
    assert n == 1
