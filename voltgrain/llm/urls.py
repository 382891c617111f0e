"""Operator 9, URL filter: rules first, then a ratio of two character language models.

URLs that a rule decides teach two variable-order Markov models, one of accepted and one of rejected
URLs. A character's probability after its longest context is interpolated with those after shorter
ones, down to a uniform one. URLs are compared by shape (host and path, each run of digits as one 0),
and equal shapes are counted together before anything is shuffled. A URL's score is the log-likelihood
difference, divided by its length; the threshold is where both kinds of a held-out fifth of the ruled
shapes are told apart best.

Everything is DataFrame functions. Log-likelihoods are summed as whole millionths, so that the order of
summation can't change a verdict. The rules are a list of a few entries, as a configuration has them.

A null url, or one without "://", has an empty host and path and is judged by the models like any other.
Repeated rows get equal results; columns other than the id and the url are ignored. Without ruled URLs
of both kinds the threshold is 0 and everything scores 0, which is allowed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltgrain.llm.common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of context, weight of the shorter context's estimate, size of the uniform alphabet.
ORDER, STRENGTH, ALPHABET = 4, 2.0, 256
START, STOP = "\u0002", "\u0003"
UNIT = 1e6


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the contract.
RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host and path."""
    url = F.col(url_col)
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return pages.select("*", host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def by_rules(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, written out, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.host + rule.path).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def grams(shapes: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of each shape: the character with its longest context, as one string g."""
    s = shapes.withColumn("s", F.concat(F.lit(START), "shape", F.lit(STOP)))
    at = s.select("s", *keep, F.explode(F.expr("sequence(2, length(s))")).alias("i"))
    return at.select(*keep, F.expr(f"substring(s, greatest(1, i - {ORDER}), i - greatest(1, i - {ORDER}) + 1)").alias("g"))


def suffixes(g: DataFrame, *keep: str) -> DataFrame:
    """For each g its ends of 1, 2, ... characters: gram, and context without the last character."""
    out = g.select("g", *keep, F.explode(F.expr("sequence(1, length(g))")).alias("j"))
    return out.select("g", *keep, "j", F.expr("right(g, j)").alias("gram"), F.expr("left(right(g, j), j - 1)").alias("context"))


def log_ratios(seen: DataFrame, trained: DataFrame) -> DataFrame:
    """For each g of seen, ln p(accepted) - ln p(rejected) in whole UNITs. trained: shapes with their numbers a and r."""
    counted = grams(trained, "a", "r").groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    counts = written(suffixes(counted, "a", "r").groupBy("gram", "context").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "url-grams")
    totals = counts.groupBy("context").agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
    each = suffixes(seen.select("g").distinct()).join(counts.drop("context"), "gram", "left").join(totals, "context", "left")
    each = each.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("j", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("a", "ta", "r", "tr"))))).alias("levels"))
    p = lambda n, t: F.aggregate("levels", F.lit(1.0 / ALPHABET), lambda acc, x: (x[n] + STRENGTH * acc) / (x[t] + STRENGTH))
    return each.select("g", F.round((F.log(p("a", "ta")) - F.log(p("r", "tr"))) * UNIT).cast("long").alias("ratio"))


def threshold(scores: DataFrame) -> float:
    """Where true accepts and true rejects add up to most: the middle of the best bin edge nearest 0. Bins: hundredths."""
    bins = scores.groupBy(F.greatest(F.lit(-2000), F.least(F.lit(2000), F.floor(F.col("score") * 100))).alias("bin")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    below, all_of = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    sides = bins.select("bin", (F.sum("a").over(all_of) - F.coalesce(F.sum("a").over(below), F.lit(0))).alias("ok_a"), F.coalesce(F.sum("r").over(below), F.lit(0)).alias("ok_r"), F.sum("a").over(all_of).alias("na"), F.sum("r").over(all_of).alias("nr"))
    best = sides.filter("na > 0 and nr > 0").orderBy(F.desc(F.col("ok_a") / F.col("na") + F.col("ok_r") / F.col("nr")), F.abs("bin"), "bin").first()
    return best["bin"] / 100 if best else 0.0


def judged(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides) of every page."""
    rows = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    rule, verdict = by_rules(RULES if rules is None else rules, F.col("host"), F.col("path"))
    shape = F.regexp_replace(F.concat("host", "path"), r"[0-9]+", "0")
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), shape.alias("shape"))
    shapes = written(rows.groupBy("shape").agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("r"), F.count_if(F.col("ruled").isNull()).alias("open")), "url-shapes")
    held_out = F.pmod(F.crc32(F.col("shape").cast("binary")), F.lit(5)) == 0
    ruled = F.col("a") + F.col("r") > 0
    needed = shapes.filter((F.col("open") > 0) | (ruled & held_out))
    seen = grams(needed, "shape")
    ratios = log_ratios(seen, shapes.filter(ruled & ~held_out))
    scores = seen.join(ratios, "g").groupBy("shape").agg((F.sum("ratio") / UNIT / F.count(F.lit(1))).alias("score"))
    scores = written(needed.join(scores, "shape"), "url-scores")
    cut = threshold(scores.filter(ruled & held_out))
    found = rows.join(scores.filter("open > 0").select("shape", "score"), "shape", "left")
    by_model = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("score")).alias("score"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
