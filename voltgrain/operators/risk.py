"""The risk score of a municipality and utility, its history and its trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltgrain.functions.columns import completed_years, exact_mean, half_up, month_index, trend_label

KEY = ("municipio", "distribuidora")


def with_violations(indicators: DataFrame) -> DataFrame:
    """indicators with violacao_dec and violacao_fec; null where either side is."""
    return indicators.withColumns({"violacao_dec": F.col("dec_apurado") > F.col("dec_limite"), "violacao_fec": F.col("fec_apurado") > F.col("fec_limite")})


def recent(indicators: DataFrame, months: int = 12, anchor: str = "all") -> DataFrame:
    """Rows of the last months. anchor: the last month of all rows, or of the row's 'utility'."""
    if anchor == "utility":
        last = indicators.groupBy("distribuidora").agg(F.max(month_index()).alias("_last"))
        return indicators.join(last, "distribuidora").filter(month_index() > F.col("_last") - months).drop("_last")
    return indicators.filter(month_index() > indicators.select(F.max(month_index())).scalar() - months)


def recent_means(indicators: DataFrame, months: int = 12, anchor: str = "all") -> DataFrame:
    """dec_medio_12m, dec_limite_medio, ratio_dec (3 at most; 3 if no DEC but a limit is known, 0 without a limit) and meses_violacao."""
    rows = with_violations(recent(indicators, months, anchor)).groupBy(*KEY, "uf").agg(exact_mean("dec_apurado").alias("dec_medio_12m"), exact_mean("dec_limite").alias("dec_limite_medio"), F.count_if("violacao_dec").alias("meses_violacao"))
    ratio = F.when(F.col("dec_limite_medio") > 0, F.least(F.col("dec_medio_12m") / F.col("dec_limite_medio"), F.lit(3.0))).otherwise(0.0)
    return rows.withColumn("ratio_dec", ratio)


def network_age(network: DataFrame, as_of: Column) -> DataFrame:
    """Mean completed years of the dated segments of a municipality and utility."""
    age = completed_years("data_implant", as_of)
    return network.filter(F.col("data_implant").isNotNull()).groupBy(*KEY).agg((F.sum(age).cast("double") / F.count(F.lit(1))).alias("idade_media_anos"))


def risk_score(indicators: DataFrame, network: DataFrame, as_of: Column, *, utility: str | None = None, anchor: str = "all", default_age: float = 20.0) -> DataFrame:
    """40 points for DEC against its limit, 30 for months over it, 30 for the network's age. utility: only this one's rows."""
    means = recent_means(indicators, anchor=anchor)
    if utility is not None:
        means, network = means.filter(F.col("distribuidora") == utility), network.filter(F.col("distribuidora") == utility)
    rows = means.join(network_age(network, as_of), list(KEY), "left").withColumn("idade_media_anos", F.coalesce("idade_media_anos", F.lit(default_age)))
    score = F.least(F.col("ratio_dec") / 3.0, F.lit(1.0)) * 40 + F.least(F.col("meses_violacao") / 12.0, F.lit(1.0)) * 30 + F.least(F.col("idade_media_anos") / 40.0, F.lit(1.0)) * 30
    return rows.select(*KEY, "uf", half_up(score, 2).alias("score_risco"), half_up("dec_medio_12m", 2).alias("dec_medio_12m"), half_up("ratio_dec", 4).alias("ratio_dec"), "meses_violacao", half_up("idade_media_anos", 1).alias("idade_media_anos"))


def best_first() -> list[Column]:
    """Highest score first; names break ties."""
    return [F.desc_nulls_last("score_risco"), F.asc("uf"), F.asc("municipio"), F.asc("distribuidora")]


def top_risk(scores: DataFrame, n: int = 5) -> DataFrame:
    return scores.orderBy(*best_first()).limit(n).select("municipio", "distribuidora", "score_risco")


def score_snapshot(scores: DataFrame, year: int, month: int) -> DataFrame:
    """scores as rows of the history of one month."""
    return scores.select(*KEY, "uf", F.lit(year).cast("int").alias("ano"), F.lit(month).cast("int").alias("mes"), "score_risco", F.col("dec_medio_12m").alias("dec_medio"))


def newest_first(history: DataFrame) -> DataFrame:
    """history with rn, 1 for the newest month of a municipality and utility."""
    return history.withColumn("rn", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("ano"), F.desc("mes"))))


def trend(history: DataFrame) -> DataFrame:
    """Means of the last three snapshots and the three before, and what these say as they are shown, rounded."""
    score = F.col("score_risco").cast("decimal(10,2)")
    rows = newest_first(history).filter("rn <= 6").groupBy(*KEY).agg(exact_mean(F.when(F.col("rn") <= 3, score)).alias("media_recente"), exact_mean(F.when(F.col("rn") > 3, score)).alias("media_anterior"))
    rows = rows.withColumns({c: half_up(c, 4) for c in ("media_recente", "media_anterior")})
    return rows.withColumn("tendencia", trend_label("media_recente", "media_anterior"))


def last_months(history: DataFrame, n: int = 12) -> DataFrame:
    """The last n snapshots, with their place in order of time (1: the oldest of them)."""
    rows = newest_first(history).filter(F.col("rn") <= n)
    return rows.withColumn("ordem", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("rn")))).drop("rn")


def best_utility(scores: DataFrame) -> DataFrame:
    """Of each municipality the utility with the highest score."""
    order = Window.partitionBy("municipio", "uf").orderBy(F.desc_nulls_last("score_risco"), "distribuidora")
    return scores.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
