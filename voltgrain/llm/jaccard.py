"""Operator 10, n-gram Jaccard join in a prefix tree.

A document's set of word n-grams is put in one global order, rare n-grams first (by the number of
documents that have them; voltgrain.llm.blocks counts these). Two sets can only reach the threshold if
they share one of the first n - ceil(t n) + 1 n-grams, so a document whose rarest n-grams, that many,
occur nowhere else is linked with nothing, and its set goes no further.

Equal sets are one class from then on. Classes that share such a first n-gram, directly or in a chain,
form a cluster: every link lies within one. A cluster's sets go into a tree whose branches are their
ordered n-grams; each set walks the tree, its overlap with a branch is counted once for all sets below,
and a subtree goes as soon as what is left of both can't reach the threshold, or when all below is linked
with the set already. Only links that join two components are given.

A cluster too large for one task is never gathered, but walks trees all the same: its classes are dealt to
parts; the hub that a first n-gram points to (the class with most shared n-grams) walks the tree of those that it
is the hub of, part by part. What that leaves outside the cluster's largest component then walks the trees of all
parts, GROUP_SETS classes at a time. Nothing is capped or left out.

Words are lower-cased A-Z and compared by 64-bit hashes. Null and empty texts have no n-grams and are
linked with nothing; an empty table gives no rows; a text of fewer words than n has its whole sequence as
its one n-gram. A very long text's set is made in one task, in 8 bytes an n-gram, and is never cut. Repeated
rows and rows of one id count as rows of their own; null ids never are the smallest of a component, whose
id is null if no row of it has one. Of other columns, whatever their names, only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltgrain.llm import blocks as B
from voltgrain.llm.common import release, table, text_bytes, unused, written
from voltgrain.llm.components import components

SET = "doc_id long, n int, node binary, tokens binary, ranks binary, first array<long>"
#: A cluster with more classes, or more n-grams in all, is dealt to several tasks.
GROUP_SETS, GROUP_TOKENS = 1024, 2_000_000


def gram_set(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-grams of a text's word hashes, sorted by hash."""
    if not len(words):
        return words
    k = min(n, len(words))
    return np.unique(B.joined([words[i : len(words) - k + 1 + i] for i in range(k)]))


def first_n(n: int, percent: int) -> int:
    """How many n-grams of a set of n hold one of any set that it is linked with."""
    return n - -(-percent * n // 100) + 1


def _sets(rows: pa.Table, n: int) -> list[np.ndarray]:
    seen = B.WordHashes()
    return [gram_set(seen.of(text.lower().split()), n) for text in B.texts_of(rows)]


def signature(tokens: np.ndarray) -> bytes:
    """16 bytes that equal sets share."""
    return B.xxhash.xxh3_128_digest(tokens.tobytes())


def gram_sets(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """SET for every row; tokens (hashes, rare first), their ranks and the first ones that occur elsewhere are null for sets without a possible partner."""
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = B.bucket_bits(n_bytes)
    rows, n_blocks = B.blocks_of(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")), n_bytes)

    def count(left: pa.Table) -> pa.Table:
        flat = np.concatenate([np.zeros(0, np.uint64), *_sets(left, n)])
        out = [*B.sent(left["block"][0].as_py(), 0, *B.totals(flat, np.ones(len(flat), np.int64)), bits)]
        del flat
        release()
        return B.rows_of(out, B.SENT)

    def order(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = _sets(left, n)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        own, place = np.unique(flat, return_inverse=True)
        docs_with = B.told(right, 0, len(own))[place]
        del flat, own, place
        out, at = [], 0
        for doc_id, tokens in zip(left["doc_id"].to_pylist(), sets, strict=True):
            df = docs_with[at : at + len(tokens)]
            at += len(tokens)
            shared = np.flatnonzero(df > 1)
            few = first_n(len(tokens), percent) - (len(tokens) - len(shared)) if len(tokens) else 0
            if few <= 0:
                out.append((doc_id, len(tokens), None, None, None, None))
                continue
            by = shared[np.lexsort((tokens[shared], df[shared]))]
            out.append((doc_id, len(tokens), signature(tokens), tokens[by].tobytes(), df[by].astype(np.int64).tobytes(), tokens[by[:few]].view(np.int64).tolist()))
        release()
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 6, types, strict=True)], names=[x.split()[0] for x in SET.split(", ")])

    told = B.added_up(B.spread(rows.groupBy(*B.BLOCK).applyInArrow(count, B.SENT), bits), n_blocks)
    return rows.groupBy(*B.BLOCK).cogroup(told.groupBy(*B.BLOCK)).applyInArrow(order, SET)


class Tree:
    """Ordered sets as a prefix tree: leaves are the sets in lexical order, a node is a run of them with the n-grams they share."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.order = np.array(order, np.int64)
        self.sets, self.sizes = [sets[i] for i in order], sizes[self.order]
        m = len(order)
        shared = [0] * (m + 1)
        for i in range(1, m):
            a, b = self.sets[i - 1], self.sets[i]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            shared[i] = int(differ[0]) if len(differ) else k
        #: (low, high, n-grams of the branch to the node, n-grams below it at most, smallest size, children)
        self.root = self._build(shared)

    def _build(self, shared: list[int]) -> list:
        open_: list[list] = [[0, 0, []]]  # depth, low, children
        for i in range(len(self.sets)):
            low = i
            while open_[-1][0] > shared[i]:
                depth, low, children = open_.pop()
                above = max(open_[-1][0], shared[i])
                node = self._node(low, i, above, depth, children)
                if open_[-1][0] < shared[i]:
                    open_.append([shared[i], low, [node]])
                else:
                    open_[-1][2].append(node)
            length = len(self.sets[i])
            if length > open_[-1][0]:
                # a set that the next one repeats or goes on from is a leaf below its node
                goes_on = i + 1 < len(self.sets) and shared[i + 1] == length
                open_.append([length, i, [self._node(i, i + 1, length, length, [])] if goes_on else []])
            else:
                open_[-1][2].append(self._node(i, i + 1, length, length, []))
        while len(open_) > 1:
            depth, low, children = open_.pop()
            open_[-1][2].append(self._node(low, len(self.sets), open_[-1][0], depth, children))
        return open_[0][2]

    def _node(self, low: int, high: int, above: int, depth: int, children: list) -> tuple:
        most = max(len(s) for s in self.sets[low:high]) - depth
        return low, high, self.sets[low][above:depth], most, int(self.sizes[low:high].min()), int(self.sizes[low:high].max()), children


def spanning_links(sets: list[np.ndarray], sizes: np.ndarray, percent: int, labels: np.ndarray, probes: np.ndarray, held: np.ndarray) -> list[tuple[int, int]]:
    """Links of probes with held (places in sets) that join components. sets: places in the global order, ascending;
    sizes: of the whole sets; labels: components known before."""
    parent = {int(x): int(x) for x in np.unique(labels)}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = Tree([sets[i] for i in held], sizes[held])
    at = held[tree.order]
    found: list[tuple[int, int]] = []
    mark = np.zeros(max((int(s[-1]) + 1 for s in sets if len(s)), default=0), np.int64)
    now = np.zeros(0, np.int64)
    for turn, p in enumerate(probes):
        if turn % 32 == 0:
            now = np.array([top(int(x)) for x in labels[at]], np.int64)
            edges = np.append(np.flatnonzero(np.append(True, now[1:] != now[:-1])), len(now))
        x, nx = sets[p], int(sizes[p])
        mark[x] = 1
        stack = [(node, 0) for node in tree.root]
        while stack:
            (low, high, branch, most, smallest, largest, children), overlap = stack.pop()
            if percent * smallest > 100 * nx or percent * nx > 100 * largest:
                continue
            # one component alone below, and the probe is in it
            if edges[np.searchsorted(edges, low, "right")] >= high and top(int(now[low])) == top(int(labels[p])):
                continue
            left = len(x)
            if len(branch):
                overlap += int(mark[branch].sum())
                left -= int(np.searchsorted(x, branch[-1], "right"))
            if (100 + percent) * (overlap + min(left, most)) < percent * (nx + max(smallest, -(-percent * nx // 100))):
                continue
            if children:
                stack += [(child, overlap) for child in children]
                continue
            for i in range(low, high):
                a, b = top(int(labels[p])), top(int(labels[at[i]]))
                if a != b and (100 + percent) * overlap >= percent * (nx + int(tree.sizes[i])):
                    parent[max(a, b)] = min(a, b)
                    found.append((int(p), int(at[i])))
        mark[x] = 0
    return found


def _local(*tables: pa.Table) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
    """Sets as places in the global order, sizes and nodes; n-grams that one set alone has are left out."""
    raw = [(np.frombuffer(t.as_py(), np.uint64), np.frombuffer(r.as_py(), np.int64)) for table_ in tables for t, r in zip(table_["tokens"], table_["ranks"], strict=True)]
    sizes = np.concatenate([table_["n"].to_numpy() for table_ in tables]).astype(np.int64)
    tokens, ranks = np.concatenate([t for t, _ in raw]), np.concatenate([r for _, r in raw])
    distinct, where, inverse, times = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
    by = np.lexsort((distinct, ranks[where]))
    place = np.empty(len(distinct), np.int64)
    place[by] = np.cumsum(times[by] > 1) - 1
    place = np.where(times > 1, place, -1)[inverse]
    sets = [x[x >= 0] for x in np.split(place, np.cumsum([len(t) for t, _ in raw])[:-1])]
    return sets, sizes, [n for table_ in tables for n in table_["node"].to_pylist()]


def _pairs(found: list[tuple[int, int]], nodes: list[bytes]) -> pa.Table:
    return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.binary()), "b": pa.array([nodes[j] for _, j in found], pa.binary())})


LINK = "a binary, b binary"


def class_links(classes: DataFrame, percent: int, group_sets: int = GROUP_SETS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Links between classes (columns a and b) that connect what the threshold connects."""
    entries = classes.select("node", (F.octet_length("tokens") / 8 / F.col("n")).alias("shared"), F.explode("first").alias("token"))
    hubs = entries.groupBy("token").agg(F.max(F.struct("shared", "node"))["node"].alias("hub"))
    edges = written(entries.join(hubs, "token").filter("node <> hub").select("node", "hub").distinct(), "jaccard-edges")
    clusters = written(components(edges.select(F.col("node").alias("a"), F.col("hub").alias("b"))), "jaccard-clusters")
    members = classes.select("node", "n", "tokens", "ranks").join(clusters.withColumnRenamed("root", "cluster"), "node")
    members = written(members.withColumn("weight", F.octet_length("tokens") / 8), "jaccard-members")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("weight").alias("weight"))
    large = written(sizes.filter((F.col("sets") > group_sets) | (F.col("weight") > group_tokens)), "jaccard-large")
    small = members.join(large.select("cluster"), "cluster", "left_anti")

    def walk(rows: pa.Table) -> pa.Table:
        sets, sizes_, nodes = _local(rows)
        all_of = np.arange(len(nodes))
        return _pairs(spanning_links(sets, sizes_, percent, all_of, all_of, all_of), nodes)

    links = small.groupBy("cluster").applyInArrow(walk, LINK)
    if large.isEmpty():
        return links
    return links.unionByName(large_links(members.join(large.select("cluster", F.ceil(F.greatest(F.col("sets") / group_sets, F.col("weight") / group_tokens)).cast("int").alias("parts")), "cluster"), edges, percent, group_sets))


def large_links(members: DataFrame, edges: DataFrame, percent: int, group_sets: int) -> DataFrame:
    """Links within clusters that are dealt to parts. Hubs first walk the trees of what points to them."""
    members = written(members, "jaccard-spread")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")
    near = edges.join(members, "node").select("hub", part, "node", "n", "tokens", "ranks")
    hubs = edges.join(members.select("node", "parts"), "node").select("hub", part).distinct()
    hubs = hubs.join(members.select(F.col("node").alias("hub"), "n", "tokens", "ranks"), "hub").select("hub", "part", F.col("hub").alias("node"), "n", "tokens", "ranks")
    hubs = hubs.toDF(*hubs.columns)  # columns of its own

    def from_hub(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _pairs([], [])
        sets, sizes, nodes = _local(left, right)
        return _pairs(spanning_links(sets, sizes, percent, np.arange(len(nodes)), np.arange(1), np.arange(1, len(nodes))), nodes)

    hub_links = written(hubs.groupBy("hub", "part").cogroup(near.groupBy("hub", "part")).applyInArrow(from_hub, LINK), "jaccard-hub-links")
    roots = components(hub_links)
    known = written(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-known")
    by_root = known.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("k"))
    top = by_root.groupBy("cluster").agg(F.max(F.struct("k", "root"))["root"].alias("top"), (F.sum("k") - F.max("k")).alias("others"))
    known = known.join(top, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("turns", F.ceil(F.col("others") / group_sets))
    known = written(known.select("cluster", "part", "node", "n", "tokens", "ranks", "root", "parts", "turns", (F.col("root") != F.col("top")).alias("minor")), "jaccard-parts")
    # those outside the largest component, group_sets at a time, meet every part once
    asking = known.filter("minor").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns"))).withColumn("other", F.explode(F.expr("sequence(0L, parts - 1L)")))
    asked = known.filter("turns > 0").withColumn("mine", F.explode(F.expr("sequence(0L, turns - 1L)"))).withColumnRenamed("part", "other")

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _pairs([], [])
        sets, sizes, nodes = _local(left, right)
        roots_ = left["root"].to_pylist() + right["root"].to_pylist()
        names = {r: i for i, r in enumerate(dict.fromkeys(roots_))}
        labels = np.array([names[r] for r in roots_], np.int64)
        return _pairs(spanning_links(sets, sizes, percent, labels, np.arange(left.num_rows), np.arange(left.num_rows, len(nodes))), nodes)

    keys = ("cluster", "mine", "other")
    columns = (*keys, "node", "n", "tokens", "ranks", "root")
    more = asking.select(*columns).groupBy(*keys).cogroup(asked.select(*columns).toDF(*columns).groupBy(*keys)).applyInArrow(walk, LINK)
    return hub_links.unionByName(more)


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, group_sets: int = GROUP_SETS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; documents link whose sets' intersection is percent of their union or more."""
    sets = written(gram_sets(docs, id_col, text_col, n, percent), "jaccard-sets")
    likely = sets.filter(F.col("node").isNotNull())
    classes = written(likely.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.any_value(c).alias(c) for c in ("n", "tokens", "ranks", "first"))), "jaccard-classes")
    roots = written(components(class_links(classes, percent, group_sets, group_tokens)), "jaccard-roots")
    of = classes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    found = likely.select("doc_id", "n", "node").join(ids, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = sets.filter(F.col("node").isNull()).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """docs with only the document of the smallest id of each component. An id goes if one of its rows is linked with a
    smaller id; rows of the id that stays, rows without an id and texts without n-grams all stay."""
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, n=n, percent=percent)
    name = unused("_gone", docs)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)
