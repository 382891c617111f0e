"""Operator 1, line dedup: a suffix array over the corpus' line sequences by distributed prefix doubling.

Every line with a word has a 128-bit hash; lines that occur once end a sequence and go no further. The
others get ids in the order of their hashes: a suffix's rank by its first line. In each doubling, the
rank by 2**(k+1) lines is the place of the pair of ranks by 2**k lines, here and 2**k lines on, among all
such pairs in order; pairs that occur once drop out, since nothing repeats there. Ranks come from a range
partitioning of the distinct pairs, so they keep the suffixes' order and no task sees all of them.

Suffixes that share a prefix of some length are one longest-common-prefix interval: they have equal ranks
at its first and at its last 2**k lines. A run of lines is long enough from min_words words on. From each
line on, and up to each line, the shortest run that is long enough is looked up; of an interval's runs all
but the first, by document id, are later copies. The union of these runs is what maximal repeated runs of
min_words or more cover in later copies, and is deleted. (A run that overlaps its own earlier copy loses
what it repeats.) So 2**k never exceeds min_words, and there are few rounds.

A null id sorts first. Null texts stay null, empty ones and an empty table stay as they are. Rows of equal
id and text are one document and get equal results; of equal runs in one document the first one stays.
Lines without a word never count, and stay. Other columns pass through, whatever their names. A text's lines
are split in one task; what goes on from there is a row a line, and a document's repeated lines are sorted
together once, with at most 2 * min_words entries beside each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltgrain.llm.common import WORD, table, unused, written

#: What a null id counts as.
NO_ID = -(2**63)
ROW = ("id", "mark")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(text_col)


def ranked(keys: DataFrame, name: str) -> DataFrame:
    """Distinct keys with a rank that keeps their order."""
    return written(keys.repartitionByRange(*keys.columns).sortWithinPartitions(*keys.columns).withColumn("rank", F.monotonically_increasing_id()), name)


def repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The lines that occur more than once: id, mark, seq (number among the document's lines with words), pos (among all), words, rank."""
    ident, mark = keyed(docs, id_col, text_col)
    lines = F.transform(F.split(text_col, "\n", -1), lambda line, i: F.struct(i.alias("pos"), line.alias("line")))
    some = F.filter(lines, lambda x: x["line"].rlike(WORD))
    rows = docs.select(ident.alias("id"), mark.alias("mark"), F.posexplode(some).alias("seq", "x"))
    line = F.col("x")["line"]
    rows = rows.select(*ROW, "seq", F.col("x")["pos"].alias("pos"), F.regexp_count(line, F.lit(WORD)).alias("words"), F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2"))
    rows = written(rows, "lines")
    ids = ranked(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2"), "line-ids")
    return written(rows.join(ids, ["h1", "h2"]).select(*ROW, "seq", "pos", "words", "rank").dropDuplicates([*ROW, "seq"]), "repeated-lines")


def doubled(level: DataFrame, step: int) -> DataFrame:
    """Ranks by 2 * step lines from ranks by step lines, where they occur more than once."""
    on = level.select(*ROW, (F.col("seq") - step).alias("seq"), F.col("rank").alias("then"))
    pairs = written(level.select(*ROW, "seq", "rank").join(on, [*ROW, "seq"]), "pairs")
    keys = ranked(pairs.groupBy("rank", "then").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("rank").alias("r"), "then"), "pair-ranks")
    keys = keys.select("r", F.col("then").alias("t"), F.col("rank").alias("new"))
    return written(pairs.join(keys, (F.col("rank") == F.col("r")) & (F.col("then") == F.col("t"))).select(*ROW, "seq", F.col("new").alias("rank")), "ranks")


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """id, mark, start, end of the shortest runs of repeated lines with min_words from each line on and up to each line."""
    run = Window.partitionBy(*ROW).orderBy("seq")
    rows = lines.select(*ROW, "seq", "words").withColumn("island", F.col("seq") - F.row_number().over(run))
    inside = Window.partitionBy(*ROW, "island").orderBy("seq")
    rows = rows.withColumn("upto", F.sum("words").over(inside))
    entry = F.struct("upto", (F.col("upto") - F.col("words")).alias("before"), "seq")
    rows = rows.withColumn("ahead", F.collect_list(entry).over(inside.rowsBetween(0, min_words - 1))).withColumn("behind", F.collect_list(entry).over(inside.rowsBetween(1 - min_words, 0)))
    to = F.filter("ahead", lambda x: x["upto"] - F.col("upto") + F.col("words") >= min_words)
    since = F.filter("behind", lambda x: F.col("upto") - x["before"] >= min_words)
    first, last = F.get(to, F.lit(0))["seq"], F.element_at(F.when(F.size(since) > 0, since), -1)["seq"]
    spans = F.array(F.struct(F.col("seq").alias("start"), (first + 1).alias("end")), F.struct(last.alias("start"), (F.col("seq") + 1).alias("end")))
    return rows.select(*ROW, F.explode(spans).alias("s")).select(*ROW, "s.start", "s.end").dropna().distinct()


def later_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """id, mark and the positions (gone) of the lines to delete, for documents that have any."""
    lines = repeated_lines(docs, id_col, text_col)
    runs = written(shortest_runs(lines, min_words).withColumn("k", F.floor(F.log2(F.col("end") - F.col("start") + 0.5)).cast("int")), "runs")
    longest = runs.agg(F.max("k")).first()[0]
    level, levels = lines.select(*ROW, "seq", "rank"), []
    for k in range(-1 if longest is None else longest + 1):
        if k:
            level = doubled(level, 1 << (k - 1))
        levels.append(level.withColumn("k", F.lit(k)))
    if not levels:
        levels = [level.withColumn("k", F.lit(0))]
    ranks = levels[0]
    for more in levels[1:]:
        ranks = ranks.unionByName(more)
    start = ranks.select(*ROW, "k", F.col("seq").alias("start"), F.col("rank").alias("r1"))
    tail = ranks.select(*ROW, "k", F.col("seq").alias("tail"), F.col("rank").alias("r2"))
    runs = runs.withColumn("tail", F.expr("end - shiftleft(1, k)"))
    runs = written(runs.join(start, [*ROW, "k", "start"]).join(tail, [*ROW, "k", "tail"]).withColumn("size", F.col("end") - F.col("start")).select(*ROW, "start", "size", "k", "r1", "r2"), "intervals")
    # the first run of an interval is found by an aggregation, and taken away by its own place: no join on a passage that many share
    first = runs.groupBy("k", "size", "r1", "r2").agg(F.min(F.struct(*ROW, "start")).alias("first")).select("first.*", "size")
    copies = runs.join(first, [*ROW, "start", "size"], "left_anti")
    gone = copies.select(*ROW, F.explode(F.expr("sequence(start, start + size - 1)")).alias("seq")).distinct()
    return gone.join(lines.select(*ROW, "seq", "pos"), [*ROW, "seq"]).groupBy(*ROW).agg(F.collect_list("pos").alias("gone"))


def without_later_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", removed_col: str | None = None, min_words: int = 50) -> DataFrame:
    """docs, their texts without later copies of repeated line runs of min_words or more. length_col is set anew where
    docs has it; removed_col gets the number of deleted lines."""
    a, b, gone, removed = (unused(f"_dedup_{x}", docs) for x in ("id", "mark", "gone", "removed"))
    found = later_copies(docs, id_col=id_col, text_col=text_col, min_words=min_words).select(F.col("id").alias(a), F.col("mark").alias(b), F.col("gone").alias(gone))
    ident, mark = keyed(docs, id_col, text_col)
    out = docs.withColumns({a: ident, b: mark}).join(found, [a, b], "left")
    lines = F.split(text_col, "\n", -1)
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n"))
    out = out.withColumn(removed, F.coalesce(F.array_size(gone), F.lit(0)).cast("long")).withColumn(text_col, text)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(gone).isNull(), F.col(length_col)).otherwise(F.char_length(text_col).cast(docs.schema[length_col].dataType)))
    return out.select(*docs.columns, *([F.col(removed).alias(removed_col)] if removed_col else []))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_later_copies(docs, removed_col="n_removed")
