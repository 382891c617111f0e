"""Operator 13, a Merkle manifest of a dataset with octopus multiproofs.

A row's leaf is the SHA-256 of its columns, each with its length. The leaves of a source, in order of their ids, are the
leaves of a tree of fan-out 16; the roots of the sources, in order of their names (null first, by UTF-8 bytes), are the
leaves of one more tree, whose root stands for the dataset. A node is a row (tree, level, place, digest); levels are built
one from the other by grouping 16 places, so no group is larger and no source is hot.

Proofs are made a block of consecutive leaves at a time, whatever sources these belong to. A block computes which nodes it
lacks: level by level, the children of its nodes' parents that it does not have itself (the octopus). All blocks' lacking
nodes are fetched by one join; a block then derives the interiors that its leaves share and expands each leaf's own proof.

Leaves get their places without a window over a source: rows are range-partitioned in order, partitions are counted (a
row each), and a source's part of a partition is placed by what stands before it.

Null columns have a mark of their own, so a null differs from an empty text. Null ids come first in their source and are
never tampered with by op13; a null source is a source. Rows of one source and id are ordered by their leaves; repeated rows
are leaves each, equal in all but their proofs. A lone leaf is its source's root, a lone source's root is the dataset's. An
empty table has no rows and no root. Very long texts are read once, where they lie: only digests are shuffled. Columns
not named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltgrain.llm.common import table, written

FANOUT = 16
#: Leaves that are proved together.
BLOCK_LEAVES = 4096
#: The tree over the sources' roots; those of sources are numbered from 0 on.
TOP = -1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, level int, place long, digest string"
PROVED = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, n_siblings long"


def field(value: Column) -> Column:
    """A value with its length in UTF-8; `-` if null."""
    text = value.cast("string").cast("binary")
    return F.coalesce(F.concat(F.octet_length(text).cast("string").cast("binary"), F.lit(b":"), text), F.lit(b"-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """rows, written, with part and place: the partition and the place in the order of the columns by, from 0 on."""
    at = F.monotonically_increasing_id()  # the partition, and 33 bits of the place in it
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", at)
    rows = written(rows.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)}), "merkle-order")
    sizes = sorted(rows.groupBy("part").count().collect())  # a row a partition
    before = accumulate((n for _, n in sizes), initial=0)
    starts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part long, before long")
    return rows.join(F.broadcast(starts), "part").withColumn("place", F.col("before") + F.col("at")).drop("before", "at")


def grouped(level: DataFrame, n: int) -> DataFrame:
    """The nodes above a level (tree, size, level, place, digest): a row for every 16 places. Trees of one node are done."""
    run = F.sort_array(F.collect_list(F.struct("place", "digest")))
    up = level.filter("size > 1").groupBy("tree", "size", F.expr(f"place div {FANOUT}").alias("place")).agg(run.alias("run"))
    digest = F.sha2(F.concat_ws("", F.col("run.digest")), 256)
    return up.select("tree", F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("size"), F.lit(n).alias("level"), "place", digest.alias("digest"))


def tree_levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels of the trees whose leaves (tree, size, level, place, digest) are given, each written."""
    levels = [leaves]
    size = leaves.agg(F.max("size")).first()[0] or 0
    while size > 1:
        levels.append(written(grouped(levels[-1], len(levels)), "merkle-level"))
        size = -(-size // FANOUT)
    return levels


class Manifest(NamedTuple):
    """leaves: id, source, leaf, changed, tree, size (of the tree), place (in it), block. nodes: as NODE has them. sources:
    tree, size, source, subroot. root: None for an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame
    root: str | None


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, *, changed: Column | None = None, block_leaves: int = BLOCK_LEAVES) -> Manifest:
    """The manifest of docs; the first two of columns are the id and the source. changed: another leaf for some rows, whose
    verification is asked for."""
    id_, source = (F.col(c) for c in columns[:2])
    rows = docs.select(id_.alias("id"), source.cast("string").alias("source"), leaf(*map(F.col, columns)).alias("leaf"), (F.lit(None) if changed is None else changed).cast("string").alias("changed"))
    rows = in_order(written(rows, "merkle-leaves"), "source", "id", "leaf")
    # A source's part of each partition: a partition has few sources or they are small, and a source has no more parts than there are partitions.
    parts = rows.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("start"))
    of_source = Window.partitionBy("source")
    parts = parts.select("part", "source", F.min("start").over(of_source).alias("first"), F.sum("n").over(of_source).alias("size"))
    parts = written(parts, "merkle-parts")
    sources = in_order(parts.select("source", "size").distinct(), "source").select("source", "size", F.col("place").alias("tree"))
    parts = parts.alias("p").join(sources.alias("s"), F.expr("p.source <=> s.source")).select("p.part", "p.source", "p.first", "p.size", "s.tree")
    placed = rows.alias("r").join(parts.alias("p"), F.expr("r.part = p.part and r.source <=> p.source"))
    block = F.expr(f"r.place div {block_leaves}")
    leaves = written(placed.select("r.id", "r.source", "r.leaf", "r.changed", "p.tree", "p.size", (F.col("r.place") - F.col("p.first")).alias("place"), block.alias("block")), "merkle-placed")
    node = lambda df: df.select("tree", "level", "place", "digest")
    levels = tree_levels(leaves.select("tree", "size", F.lit(0).alias("level"), "place", F.col("leaf").alias("digest")))
    roots = reduce(DataFrame.unionByName, (x.filter("size = 1") for x in levels)).select("tree", F.col("digest").alias("subroot"))
    sources = written(sources.join(roots, "tree"), "merkle-sources")
    many = sources.count()
    top = tree_levels(sources.select(F.lit(TOP).cast("long").alias("tree"), F.lit(many).cast("long").alias("size"), F.lit(0).alias("level"), F.col("tree").alias("place"), F.col("subroot").alias("digest")))
    root = top[-1].filter("size = 1").select("digest").first()
    return Manifest(leaves, reduce(DataFrame.unionByName, map(node, [*levels, *top])), sources, root and root[0])


def lacking(known: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a tree of size leaves, of which the sorted places known are there: for each level the runs of FANOUT that lead to the
    root, and the places in them that have to be fetched."""
    level = 0
    while size > 1:
        runs = np.unique(known // FANOUT)
        kids = (runs[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        yield level, runs, np.setdiff1d(kids[kids < size], known, assume_unique=True)
        known, size, level = runs, -(-size // FANOUT), level + 1


def _trees(rows: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """Tree, size and sorted places of a block's leaves."""
    tree, size, place = (rows[c].to_numpy() for c in ("tree", "size", "place"))
    by = np.lexsort((place, tree))
    cuts = np.flatnonzero(np.diff(tree[by], prepend=-1, append=-1))
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(tree[by[a]]), int(size[by[a]]), place[by[a:b]]


def lacking_of(rows: pa.Table, n_sources: int) -> Iterator[tuple[int, int, int]]:
    """Tree, level and place of every node that a block of leaves has to fetch."""
    trees = list(_trees(rows))
    trees.append((TOP, n_sources, np.array([t for t, _, _ in trees], np.int64)))
    for tree, size, places in trees:
        for level, _, gone in lacking(places, size):
            for p in gone.tolist():
                yield tree, level, p


class Block:
    """What a block of leaves knows: its own digests, the fetched ones, and the interiors derived from both."""

    def __init__(self, rows: pa.Table, fetched: pa.Table, n_sources: int) -> None:
        names = ("tree", "level", "place")
        self.sizes = {TOP: n_sources}
        self.digest = dict(zip(zip(*(fetched[c].to_pylist() for c in names), strict=True), map(str.encode, fetched["digest"].to_pylist()), strict=True))
        self.digest.update(zip(((t, 0, p) for t, p in zip(rows["tree"].to_pylist(), rows["place"].to_pylist(), strict=True)), map(str.encode, rows["leaf"].to_pylist()), strict=True))
        self.top: dict[int, tuple[int, int, int]] = {}
        tails: list[int] = []
        for tree, size, places in _trees(rows):
            self.sizes[tree] = size
            self.derive(tree, places)
            self.digest[TOP, 0, tree] = self.digest[self.top[tree]]
            tails.append(tree)
        self.derive(TOP, np.array(tails, np.int64))
        self.above: dict[tuple[int, int, int], tuple[bytes, int]] = {}

    def run(self, tree: int, level: int, place: int) -> range:
        """The places of a node's run."""
        size = -(-self.sizes[tree] // FANOUT**level)
        first = place // FANOUT * FANOUT
        return range(first, min(first + FANOUT, size))

    def derive(self, tree: int, places: np.ndarray) -> None:
        height = 0
        for level, runs, _ in lacking(places, self.sizes[tree]):
            for r in runs.tolist():
                kids = b"".join([self.digest[tree, level, p] for p in self.run(tree, level, r * FANOUT)])
                self.digest[tree, level + 1, r] = hashlib.sha256(kids).hexdigest().encode()
            height = level + 1
        self.top[tree] = tree, height, 0

    def parent(self, node: tuple[int, int, int]) -> tuple[int, int, int] | None:
        """The node whose digest is made from this one's run; a source's root stands in the tree of sources too."""
        tree, level, place = node
        if node == self.top[tree]:
            return None if tree == TOP else self.parent((TOP, 0, tree))
        return tree, level + 1, place // FANOUT

    def siblings(self, node: tuple[int, int, int]) -> tuple[bytes, bytes]:
        """Digests left and right of a node in its run."""
        tree, level, place = node
        if node == self.top[tree]:
            return (b"", b"") if tree == TOP else self.siblings((TOP, 0, tree))
        run = self.run(*node)
        return tuple(b"".join([self.digest[tree, level, p] for p in x]) for x in (range(run.start, place), range(place + 1, run.stop)))

    def proof(self, node: tuple[int, int, int]) -> tuple[bytes, int]:
        """A node's siblings from its level to the root, and how many; those of parents are kept."""
        found = self.above.get(node)
        if found is None:
            up = self.parent(node)
            own = b"".join(self.siblings(node))
            above, n = self.proof(up) if up else (b"", 0)
            found = own + above, n + len(own) // 64
            if node[1]:
                self.above[node] = found
        return found

    def folded(self, node: tuple[int, int, int], digest: bytes) -> bytes:
        """The root that follows from a node's digest and its original siblings."""
        while up := self.parent(node):
            if digest == self.digest[node]:  # all above is derived already
                return self.digest[self.top[TOP]]
            left, right = self.siblings(node)
            node, digest = up, hashlib.sha256(left + digest + right).hexdigest().encode()
        return digest


def proofs(made: Manifest) -> DataFrame:
    """For each leaf: id, leaf, subroot, root (the manifest's), the SHA-256 of its proof, the number of its siblings, the root
    that its changed leaf, else its leaf, folds to, and whether that is the manifest's."""
    n_sources = made.sources.count()
    kind = dict(made.leaves.dtypes)["id"]
    schema, out_kind = PROVED.format(kind), made.leaves.schema["id"].dataType

    def ask(rows: pa.Table) -> pa.Table:
        found = list(lacking_of(rows, n_sources))
        tree, level, place = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"block": pa.array([rows["block"][0].as_py()] * len(found), pa.int64()), "tree": pa.array(tree, pa.int64()), "level": pa.array(level, pa.int32()), "place": pa.array(place, pa.int64())})

    def prove(rows: pa.Table, fetched: pa.Table) -> pa.Table:
        block, out = Block(rows, fetched, n_sources), []
        for tree, place, digest, changed in zip(*(rows[c].to_pylist() for c in ("tree", "place", "leaf", "changed")), strict=True):
            proof, n = block.proof((tree, 0, place))
            folded = block.folded((tree, 0, place), (changed or digest).encode())
            out.append((digest, block.digest[block.top[tree]].decode(), hashlib.sha256(proof).hexdigest(), folded.decode(), n))
        names = ("leaf", "subroot", "proof_sha256", "folded_root", "n_siblings")
        got = dict(zip(names, zip(*out, strict=True), strict=True))
        return pa.table({"doc_id": rows["id"], "leaf": got["leaf"], "subroot": got["subroot"], "root": pa.array([root] * len(out), pa.string()), "proof_sha256": got["proof_sha256"], "folded_root": got["folded_root"], "n_siblings": pa.array(got["n_siblings"], pa.int64())})

    root = made.root
    asked = made.leaves.select("block", "tree", "size", "place").groupBy("block").applyInArrow(ask, "block long, tree long, level int, place long")
    fetched = asked.join(made.nodes, ["tree", "level", "place"]).select("block", "tree", "level", "place", "digest")
    found = made.leaves.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(prove, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast(out_kind)).withColumn("verified", F.col("folded_root") == F.col("root"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = leaf(*(F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return proofs(manifest(docs, changed=F.when(chosen, tampered)))


def _sql() -> str:
    """The same by joins, for up to 16^5 documents a source and 16^3 sources."""
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    whole = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in COLUMNS) + ")"
    crc = "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [n::UBIGINT FOR n IN range(8)]), lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))))"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    out = [
        f"d AS (SELECT doc_id, source, {whole('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {whole(lower)} END AS changed FROM documents)",
        "s0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM d)",
        "a0 AS (SELECT source, place, size, leaf AS digest FROM s0)",
    ]

    def levels(a: str, key: str, height: int) -> None:
        for i in range(height):
            run = f"OVER (PARTITION BY {key}, place // 16 ORDER BY place ROWS BETWEEN"
            out.append(f"{a}r{i} AS (SELECT *, coalesce(string_agg(digest, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {a}{i})")
            out.append(f"{a}{i + 1} AS (SELECT {key}, place // 16 AS place, (size + 15) // 16 AS size, CASE WHEN size = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest FROM {a}{i} GROUP BY {key}, place // 16, size)")

    def climb(a: str, step: int, i: int, at: str, same: str) -> None:
        """One level up: the proof grows, the digest folds."""
        out.append(
            f"p{step + 1} AS (SELECT p.* EXCLUDE (proof, folded), p.proof || n.l || n.r AS proof, CASE WHEN n.size = 1 THEN p.folded ELSE sha256(n.l || p.folded || n.r) END AS folded "
            f"FROM p{step} p JOIN {a}r{i} n ON {same} AND n.place = p.{at} // {16**i})"
        )

    levels("a", "source", 5)
    out.append("b0 AS (SELECT 1 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size, digest, source FROM a5)")
    levels("b", "one", 3)
    out.append("p0 AS (SELECT s.*, b.place AS tree, b.digest AS subroot, '' AS proof, coalesce(changed, leaf) AS folded FROM s0 s JOIN b0 b ON s.source IS NOT DISTINCT FROM b.source)")
    for i in range(5):
        climb("a", i, i, "place", "n.source IS NOT DISTINCT FROM p.source")
    for i in range(3):
        climb("b", 5 + i, i, "tree", "true")
    return "WITH " + ",\n".join(out) + "\nSELECT doc_id, leaf, subroot, b3.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, CAST((length(proof) // 64) AS BIGINT) AS n_siblings, folded = b3.digest AS verified FROM p8, b3"


OP13_SQL = _sql()
