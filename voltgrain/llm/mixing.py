"""Operator 7, mixing sources to target weights.

A source's words, in an order that is fixed for its documents, are packed into blocks of BLOCK words. The mix has as
many slots as the targets need blocks, SHARD of them an output shard. Each shard draws how many of its slots each
source gets from a multinomial distribution with the targets' shares: a slot falls to a source by a hash. The shards'
sums then miss the targets by their spread (about the root of a target's blocks), and could take a full source more
than three times. So a source's draws are numbered through the shards, those beyond its target are given back, and the
slots given back go, in order, to the sources that drew too few: totals meet the targets, and but for these few slots
a shard's counts are the multinomial ones.

A source's n-th draw goes through a permutation of its own, a new one each time round, to a block number: no block
comes once more before all others have come. Blocks are then joined by number. A shard's slots are permuted too.

The permutation is a swap-or-not shuffle: in each round x swaps with k - x (mod n) if a hash of the pair says so. It
works for any n, needs no table, and is made of DataFrame functions; nothing here leaves them. What is sorted whole is
a row a source; of one source, a row a chunk and a row a shard; all other windows and joins are split further.

Targets: the sources' weights share all words; a target stops at MOST times its source's size, and the excess goes to
the others by weight. Word positions within a source are sums of two levels (documents within a chunk, chunks within a
source), so a source with most of the rows is spread over all tasks. Only ids, hashes and sizes go through windows,
never texts.

Null texts have no words; a null source is a source, the last one. Documents without words have taken 0, and so has an
empty table no rows. Repeated rows are rows of their own; rows that differ in any column have an order of their own.
Columns of docs keep their values, whatever their names. A very long text is cut to words in one task. Reruns agree:
everything follows from hashes of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltgrain.llm.common import WORD, table, unused, written

#: Words of a block, blocks of an output shard, rounds of the shuffle, most passes over a source.
BLOCK, SHARD, ROUNDS, MOST = 256, 4096, 24, 3
#: Documents of a chunk, whose order is found by itself, about.
CHUNK_ROWS = 1000
#: Sources up to which their cells (some megabytes) are broadcast.
MOST_BROADCAST = 20_000


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x (0 to n - 1) after a swap-or-not shuffle of n places; key picks the shuffle."""

    def swap(acc: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - acc, n)
        return F.when(F.xxhash64(r, *key, F.greatest(acc, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def with_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, tag: str | None = None) -> DataFrame:
    """tag (a number of the row; the column of that name, if given), doc_id, source, size and order (a hash of the row)."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    plain = [f"`{c}`" for c, kind in docs.dtypes if c != tag and "map<" not in kind and kind != "variant"]
    number = F.col(tag) if tag else F.monotonically_increasing_id()
    return docs.select(number.alias("tag"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(*plain).alias("order"))


def with_targets(sizes: DataFrame, weights: list[int]) -> DataFrame:
    """A row for each source: source, source_size, target, blocks, draws, first (draws of the sources before)."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    name = F.col("source").asc_nulls_last()
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(name)) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("all", F.sum("source_size").over(everything)).withColumn("most", MOST * F.col("source_size"))
    filled = Window.orderBy(F.col("most") / F.col("w"), name)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    rows = rows.withColumn("full", F.col("left") * F.col("w") >= F.col("most") * F.col("w_left"))
    free = lambda c: F.coalesce(F.sum(F.when(~F.col("full"), F.col(c))).over(everything), F.lit(0))
    room = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(room * F.col("w") / F.nullif(free("w"), F.lit(0)))
    rows = rows.withColumn("target", target).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.when(F.col("source_size") > 0, F.round((F.col("target") - whole * F.col("source_size")) / F.col("source_size") * F.col("blocks"))).otherwise(F.lit(0))
    rows = rows.withColumn("draws", F.least(MOST * F.col("blocks"), (whole * F.col("blocks") + rest).cast("long")))
    rows = rows.withColumn("first", F.coalesce(F.sum("draws").over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.select("source", "source_size", "target", "blocks", "draws", "first", F.sum("draws").over(everything).alias("slots"))


def counts(targets: DataFrame, seed: int) -> DataFrame:
    """shard, source and n, the multinomial counts; base: the source's draws in shards before; offset: the shard's slots of
    sources before."""
    spark = targets.sparkSession
    some = targets.filter("draws > 0")
    n, total = some.agg(F.count(F.lit(1)), F.coalesce(F.max("slots"), F.lit(0))).first()  # two numbers
    size = max(1, total // (4 * n + 4096))
    # a source holds the hashes from first on; so that slots find it by an equal cell, its range is cut at cells
    cells = written(some.withColumn("cell", F.explode(F.expr(f"sequence(first div {size}, (first + draws - 1) div {size})"))).select("source", "cell", "first", "draws"), "mix-cells")
    slots = spark.range(0, total, 1, spread(spark, total)).select(F.col("id").alias("slot"), chance(F.col("id"), F.lit(total), seed).alias("u"))
    # there are 5 * n + 4096 rows of cells at most
    found = slots.withColumn("cell", F.expr(f"u div {size}")).join(F.broadcast(cells) if n <= MOST_BROADCAST else cells.hint("merge"), "cell").filter("u >= first and u < first + draws")
    found = written(found.groupBy(F.expr(f"slot div {SHARD}").alias("shard"), "source").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("base", before(Window.partitionBy("source").orderBy("shard"))).withColumn("offset", before(Window.partitionBy("shard").orderBy(F.col("source").asc_nulls_last())))


def spread(spark: SparkSession, slots: int) -> int:
    """Partitions for what has a row a slot."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), slots >> 20)


def chance(slot: Column, slots: Column, seed: int) -> Column:
    """A pseudorandom number from 0 to slots - 1 for each slot."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("slot"), slot), slots)


def drawn(targets: DataFrame, seed: int = 1) -> DataFrame:
    """A row for each slot of the mix: shard, slot, source, pass (0, 1, ...) and block."""
    of = counts(targets, seed).alias("c")
    t = targets.filter("draws > 0").select(F.col("source").alias("of"), "draws", "blocks", "slots")
    rows = of.join(t, F.col("c.source").eqNullSafe(F.col("of"))).drop("of")
    totals = of.groupBy("source").agg(F.sum("n").alias("got")).alias("g")
    some = t.join(totals, F.col("of").eqNullSafe(F.col("g.source")), "left").select("of", "draws", "blocks", F.coalesce("got", F.lit(0)).alias("got"))
    line = Window.orderBy(F.col("of").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    over, under = F.greatest(F.lit(0), F.col("got") - F.col("draws")), F.greatest(F.lit(0), F.col("draws") - F.col("got"))
    some = written(some.withColumns({"spare": F.coalesce(F.sum(over).over(line), F.lit(0)), "lack": F.coalesce(F.sum(under).over(line), F.lit(0))}), "mix-totals")
    rows = rows.repartition(max(32, spread(targets.sparkSession, 0)), "shard", "source")  # a number: few rows become many
    one = rows.withColumn("i", F.explode(F.expr("sequence(0L, n - 1)"))).withColumn("n", F.col("base") + F.col("i"))
    # the last shard may be short
    room = F.least(F.lit(SHARD).cast("long"), F.col("slots") - F.col("shard") * SHARD)
    one = one.withColumn("slot", F.col("shard") * SHARD + permuted(F.col("offset") + F.col("i"), room, F.lit(seed), F.col("shard"))).select("shard", "slot", "source", "n", "draws", "blocks")
    kept = one.filter("n < draws").select("shard", "slot", "source", "n", "blocks")
    free = one.filter("n >= draws").alias("f").join(some.select("of", "spare"), F.col("f.source").eqNullSafe(F.col("of"))).select("shard", "slot", (F.col("spare") + F.col("n") - F.col("draws")).alias("k"))
    more = some.filter("draws > got").select(F.col("of").alias("source"), "got", "lack", "blocks", F.explode(F.expr("sequence(0L, draws - got - 1)")).alias("i"))
    more = free.hint("merge").join(more.select("source", "blocks", (F.col("lack") + F.col("i")).alias("k"), (F.col("got") + F.col("i")).alias("n")), "k")
    out = kept.unionByName(more.select("shard", "slot", "source", "n", "blocks")).withColumn("pass", F.expr("n div blocks"))
    block = permuted(F.expr("n % blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "source"), F.col("pass"))
    return written(out.select("shard", "slot", "source", "pass", block.alias("block")), "mix-draws")  # so that joins know its size


def placed(sizes: DataFrame) -> DataFrame:
    """sizes with at: the number of words of the source that come before a document. Documents with words only."""
    n = 1 + sizes.count() // CHUNK_ROWS
    rows = sizes.filter("size > 0").withColumn("chunk", F.pmod(F.col("order"), F.lit(n)))
    within = Window.partitionBy("source", "chunk").orderBy("doc_id", "order", "tag").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("source", "chunk").agg(F.sum("size").alias("n"))
    chunks = chunks.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    r, c = rows.alias("r"), chunks.alias("c")
    both = r.join(c, (F.col("r.chunk") == F.col("c.chunk")) & F.col("r.source").eqNullSafe(F.col("c.source")))
    return both.select("r.*", (F.col("base") + F.col("inside")).alias("at")).drop("chunk", "inside", "order")


def pieces(at: DataFrame, draws: DataFrame) -> DataFrame:
    """A row for each stretch of a document that a slot of the mix takes: tag, shard, slot, pass, source, block, place (in the
    source's words), from (word of the document), words."""
    rows = at.select("tag", "source", "at", "size", F.explode(F.expr(f"sequence(at div {BLOCK}, (at + size - 1) div {BLOCK})")).alias("block")).alias("d")
    both = rows.join(draws.alias("m"), (F.col("d.block") == F.col("m.block")) & F.col("d.source").eqNullSafe(F.col("m.source")))
    begin = F.greatest(F.col("at"), F.col("d.block") * BLOCK)
    end = F.least(F.col("at") + F.col("size"), (F.col("d.block") + 1) * BLOCK)
    return both.select("tag", "shard", "slot", "pass", "d.source", "d.block", begin.alias("place"), (begin - F.col("at")).alias("from"), (end - begin).alias("words"))


def mix_of(sizes: DataFrame, weights: list[int], seed: int) -> tuple[DataFrame, DataFrame]:
    """The pieces of the mix, and the targets."""
    targets = written(with_targets(sizes, list(weights)), "mix-targets")
    return pieces(placed(sizes), drawn(targets, seed)), targets


def mix_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[int] = (1, 2, 3), seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    sizes = written(with_sizes(docs, id_col, text_col, source_col), "mix-sizes")
    mix, targets = mix_of(sizes, weights, seed)
    got = mix.groupBy("tag").agg(F.sum("words").alias("taken"))
    t = targets.select(F.col("source").alias("of"), "source_size", "target")
    rows = sizes.join(got, "tag", "left").join(t, F.col("source").eqNullSafe(F.col("of")))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _tagged(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: list[int], seed: int) -> tuple[DataFrame, str, DataFrame]:
    """docs with a tag, written, so that tags stay; the tag's name; the pieces of the mix."""
    tag = unused("_mix_tag", docs)
    whole = written(docs.withColumn(tag, F.monotonically_increasing_id()), "mix-documents")
    sizes = written(with_sizes(whole, id_col, text_col, source_col, tag), "mix-sizes")
    return whole, tag, mix_of(sizes, weights, seed)[0]


def mix_blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[int] = (1, 2, 3), seed: int = 1) -> DataFrame:
    """The mix itself: shard, slot, source, block, words and text of every slot; BLOCK words, but for each source's last block."""
    whole, tag, mix = _tagged(docs, id_col, text_col, source_col, weights, seed)
    texts = whole.select(F.col(tag).alias("tag"), F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)).alias("all"))
    some = mix.join(texts, "tag").select("shard", "slot", "source", "block", "words", "place", F.array_join(F.slice("all", (F.col("from") + 1).cast("int"), F.col("words").cast("int")), " ").alias("some"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "some"))), lambda x: x["some"]), " ")
    return some.groupBy("shard", "slot", "source", "block").agg(F.sum("words").alias("words"), text.alias("text"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", weights: list[int] = (1, 2, 3), seed: int = 1) -> DataFrame:
    """The mix, with the columns of docs: a row for each document and pass that takes words of it. Its text is
    the document's if all words are taken, else the taken words with a blank between them; length_col is set anew."""
    whole, tag, mix = _tagged(docs, id_col, text_col, source_col, weights, seed)
    of, stretches = unused("_mix_of", whole), unused("_mix_stretches", whole)
    taken = mix.groupBy("tag", "pass").agg(F.sort_array(F.collect_list(F.struct("from", "words"))).alias(stretches)).select(F.col("tag").alias(of), stretches)
    both = whole.join(taken, F.col(tag) == F.col(of))
    words = F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))
    got = F.aggregate(stretches, F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    cut = F.array_join(F.flatten(F.transform(stretches, lambda s: F.slice(words, (s["from"] + 1).cast("int"), s["words"].cast("int")))), " ")
    out = both.withColumn(text_col, F.when(got == F.regexp_count(text_col, F.lit(WORD)), F.col(text_col)).otherwise(cut))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))
