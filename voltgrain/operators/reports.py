"""What users read: gaps, map, ranking, key figures, critical assets, municipality profiles, transformer aging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltgrain.functions.columns import completed_years, contains_ci, coverage_pct, density, equipment_status, exact_mean, fold_key, half_up, remaining_life
from voltgrain.operators.risk import KEY, best_first, best_utility, last_months, trend
from voltgrain.operators.spatial import nearest_asset

OLD = 25


def scoped(rows: DataFrame, utility: str | None = None, uf: str | None = None) -> DataFrame:
    """Rows whose utility contains a text, in any case, and whose state is uf."""
    if utility is not None:
        rows = rows.filter(contains_ci("distribuidora", utility))
    if uf is not None:
        rows = rows.filter(F.col("uf") == uf.upper())
    return rows


def gap_report(gaps: DataFrame, *, uf: str | None = None, utility: str | None = None, min_score: float = 30, n: int = 200) -> DataFrame:
    rows = scoped(gaps, utility, uf).filter(F.col("score_vulnerabilidade") >= min_score)
    return rows.orderBy(F.desc("score_vulnerabilidade"), F.desc("comprimento_km"), "cod_id").limit(n)


def gap_totals(gaps: DataFrame) -> DataFrame:
    """One row: gaps, kilometres, and the municipality with most of them."""
    km = F.col("comprimento_km").cast("decimal(18,3)")
    by_town = gaps.groupBy("municipio").agg(F.count(F.lit(1)).alias("n"), F.sum(km).alias("km"))
    return by_town.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_gaps"), half_up(F.coalesce(F.sum("km"), F.lit(0)), 1).alias("km_total"), F.min_by("municipio", F.struct(-F.col("km"), "municipio")).alias("pior_municipio"))


def with_boundary(scores: DataFrame, boundaries: DataFrame) -> DataFrame:
    """scores with the boundary of the municipality's folded name and state; rows without one stay. What has a row for each municipality
    is joined by sorting, here and below: it grows with the data, and each such table that is broadcast fills the driver too."""
    b = boundaries.select("codigo_ibge", F.col("uf").alias("_uf"), F.col("nome_norm").alias("_name"), F.col("geom").alias("boundary"))
    return scores.withColumn("_key", fold_key("municipio")).join(b.hint("merge"), (F.col("_key") == F.col("_name")) & (F.col("uf") == F.col("_uf")), "left").drop("_key", "_name", "_uf")


def risk_map(scores: DataFrame, boundaries: DataFrame, *, utility: str | None = None, uf: str | None = None) -> DataFrame:
    return with_boundary(scoped(scores, utility, uf), boundaries)


def old_transformers(transformers: DataFrame, as_of: Column) -> DataFrame:
    return transformers.filter(completed_years("data_implant", as_of) > OLD).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_old"))


def gap_km(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy(*KEY).agg(F.sum(F.col("comprimento_km").cast("decimal(18,3)")).cast("double").alias("gap_km"))


#: What rollups add up.
MEASURES = {"comprimento": "decimal(18,4)", "potencia_nom": "decimal(18,2)", "comprimento_km": "decimal(18,3)"}


def rollup(table: str, rows: DataFrame) -> DataFrame:
    """A table's sums by municipality, utility, state and date of installation: rows, metres, kVA, kilometres of gaps; what the
    table doesn't have is null. Ages hang on the day they are asked for, so the dates stay: at most a row for each day of a
    municipality and utility, however many rows the table has."""
    value = lambda c, kind: (F.col(c) if c in rows.columns else F.lit(None)).cast(kind)
    sums = (F.sum(value(c, kind)).cast("decimal(28,4)").alias(c) for c, kind in MEASURES.items())
    keys = (F.lit(table).alias("tabela"), *KEY, "uf", value("data_implant", "date").alias("data_implant"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)


def of_rollup(sums: DataFrame, table: str, **out: Column) -> DataFrame:
    """out's aggregates of a table's rollup, by municipality and utility."""
    return sums.filter(F.col("tabela") == table).groupBy(*KEY).agg(*(c.alias(n) for n, c in out.items()))


def risk_ranking(scores: DataFrame, boundaries: DataFrame, population: DataFrame, gaps: DataFrame, transformers: DataFrame, history: DataFrame, as_of: Column, *, utility: str | None = None, uf: str | None = None, page: int = 1, limit: int = 20) -> DataFrame:
    """A page of the ranking, with the place, the number of rows and of pages."""
    return _ranking(scores, boundaries, population, [gap_km(gaps), old_transformers(transformers, as_of)], history, utility, uf, page, limit)


def risk_ranking_of_sums(scores: DataFrame, boundaries: DataFrame, population: DataFrame, sums: DataFrame, history: DataFrame, as_of: Column, *, utility: str | None = None, uf: str | None = None, page: int = 1, limit: int = 20) -> DataFrame:
    """risk_ranking from rollups of gaps_protecao and transformadores."""
    old = of_rollup(sums.filter(completed_years("data_implant", as_of) > OLD), "transformadores", n_old=F.sum("n"))
    return _ranking(scores, boundaries, population, [_gap_sums(sums), old], history, utility, uf, page, limit)


def _gap_sums(sums: DataFrame) -> DataFrame:
    return of_rollup(sums, "gaps_protecao", gap_km=F.sum("comprimento_km").cast("double"))


def _ranking(scores: DataFrame, boundaries: DataFrame, population: DataFrame, sides: list[DataFrame], history: DataFrame, utility: str | None, uf: str | None, page: int, limit: int) -> DataFrame:
    rows = with_boundary(scoped(scores, utility, uf), boundaries).drop("boundary")
    rows = rows.join(population.select("codigo_ibge", "populacao").hint("merge"), "codigo_ibge", "left")
    for side in (*sides, trend(history).select(*KEY, "tendencia")):
        rows = rows.join(side.hint("merge"), list(KEY), "left")
    rows = rows.select(*KEY, "uf", "score_risco", "dec_medio_12m", "meses_violacao", "idade_media_anos", F.coalesce("populacao", F.lit(0)).alias("populacao"), F.coalesce("gap_km", F.lit(0.0)).alias("km_sem_protecao"), F.coalesce("n_old", F.lit(0)).alias("n_transformadores_criticos"), F.coalesce("tendencia", F.lit("estavel")).alias("tendencia"))
    total = scoped(scores, utility, uf).select(F.count(F.lit(1))).scalar()
    some = rows.orderBy(*best_first()).offset((page - 1) * limit).limit(limit)
    placed = some.withColumn("posicao", (F.row_number().over(Window.orderBy(*best_first())) + (page - 1) * limit).cast("int"))
    return placed.withColumns({"total": total, "pages": F.ceil(total / limit).cast("long")})


def kpis(scores: DataFrame, boundaries: DataFrame, population: DataFrame, gaps: DataFrame, transformers: DataFrame, as_of: Column, *, critical: float = 70, consumers: float = 0.37) -> DataFrame:
    """One row of figures over everything. A municipality counts once for each utility, and once in municipios_distintos."""
    score, dec = F.col("score_risco").cast("decimal(10,2)"), F.col("dec_medio_12m").cast("decimal(10,2)")
    hit = F.col("score_risco") > critical
    base = scores.agg(half_up(exact_mean(score), 2).alias("score_medio"), F.count_if(hit).alias("municipios_criticos"), F.count_distinct(F.when(hit, F.struct("municipio", "uf"))).alias("municipios_distintos"), half_up(exact_mean(dec), 4).alias("dec_medio_geral"), F.coalesce(F.sum("meses_violacao"), F.lit(0)).alias("total_meses_violacao"))
    people = with_boundary(scores.filter(hit), boundaries).join(population.select("codigo_ibge", "populacao"), "codigo_ibge").select(F.coalesce(F.round(F.sum(F.col("populacao").cast("decimal(18,0)")) * F.lit(consumers).cast("decimal(4,2)"), 0).cast("long"), F.lit(0).cast("long")))
    km = gaps.select(half_up(F.coalesce(F.sum(F.col("comprimento_km").cast("decimal(18,3)")), F.lit(0)), 1))
    old = transformers.filter(completed_years("data_implant", as_of) > OLD).select(F.count(F.lit(1)))
    return base.withColumns({"consumidores_afetados": people.scalar(), "km_rede_sem_protecao": km.scalar(), "transformadores_criticos": old.scalar()})


def critical_segments(network: DataFrame, scores: DataFrame, *, min_score: float = 70, n: int = 500) -> DataFrame:
    some = scores.filter(F.col("score_risco") >= min_score).select(*KEY, "score_risco")
    return network.join(some, list(KEY)).orderBy(F.desc("score_risco"), "cod_id").limit(n)


def transformers_with_risk(transformers: DataFrame, scores: DataFrame, *, municipality: str | None = None, n: int | None = 1000) -> DataFrame:
    """Transformers with their municipality's score, 0 if it has none; of one municipality, or of all."""
    if municipality is not None:
        transformers = transformers.filter(F.col("municipio") == municipality)
    rows = transformers.join(scores.select(*KEY, "score_risco"), list(KEY), "left").withColumn("score_risco", F.coalesce("score_risco", F.lit(0.0)))
    return rows if n is None else rows.orderBy(F.desc("score_risco"), "cod_id").limit(n)


def municipality_profile(scores: DataFrame, network: DataFrame, low_voltage: DataFrame, transformers: DataFrame, reclosers: DataFrame, switches: DataFrame, gaps: DataFrame, boundaries: DataFrame, population: DataFrame, history: DataFrame, as_of: Column, *, limits: DataFrame | None = None) -> DataFrame:
    """Everything about each municipality and utility in one row, for all at once; historico has the last 12 snapshots in
    order of time. melhor marks the utility that a request for the municipality alone gets. limits: municipio,
    distribuidora, uf, dec_limite_medio; where unknown, dec_limite is 12."""
    age = completed_years("data_implant", as_of)
    metres = lambda name: F.sum(F.col("comprimento").cast("decimal(18,4)")).cast("double").alias(name)
    mt = network.groupBy(*KEY).agg(metres("mt_m"), (F.sum(age).cast("double") / F.count(age)).alias("age"))
    bt = low_voltage.groupBy(*KEY).agg(metres("bt_m"))
    tr = transformers.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_tr"), F.sum(F.col("potencia_nom").cast("decimal(18,2)")).alias("kva"), F.count_if(age > OLD).alias("n_old"))
    count = lambda rows, name: rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias(name))
    return _profiles(scores, [mt, bt, tr, count(reclosers, "n_rec"), count(switches, "n_sw"), gap_km(gaps)], boundaries, population, history, limits)


def municipality_profile_of_sums(scores: DataFrame, sums: DataFrame, boundaries: DataFrame, population: DataFrame, history: DataFrame, as_of: Column, *, limits: DataFrame | None = None) -> DataFrame:
    """municipality_profile from rollups of rede_mt, rede_bt, transformadores, religadores, chaves and gaps_protecao."""
    age = completed_years("data_implant", as_of)
    metres, rows = F.sum("comprimento").cast("double"), F.sum("n")
    sides = [
        of_rollup(sums, "rede_mt", mt_m=metres, age=F.sum(age * F.col("n")).cast("double") / F.sum(F.when(age.isNotNull(), F.col("n")))),
        of_rollup(sums, "rede_bt", bt_m=metres),
        of_rollup(sums, "transformadores", n_tr=rows, kva=F.sum("potencia_nom"), n_old=F.coalesce(F.sum(F.when(age > OLD, F.col("n"))), F.lit(0))),
        of_rollup(sums, "religadores", n_rec=rows),
        of_rollup(sums, "chaves", n_sw=rows),
        _gap_sums(sums),
    ]
    return _profiles(scores, sides, boundaries, population, history, limits)


def _profiles(scores: DataFrame, sides: list[DataFrame], boundaries: DataFrame, population: DataFrame, history: DataFrame, limits: DataFrame | None) -> DataFrame:
    months = last_months(history).groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("ordem", "ano", "mes", "score_risco", "dec_medio"))), lambda x: x.dropFields("ordem")).alias("historico"))
    rows = with_boundary(scores, boundaries).drop("boundary").join(population.select("codigo_ibge", "populacao", "domicilios", "pib_per_capita", "area_km2").hint("merge"), "codigo_ibge", "left")
    best = best_utility(scores).select(*KEY, "uf", F.lit(True).alias("melhor"))
    rows = rows.join(best.hint("merge"), [*KEY, "uf"], "left")
    if limits is not None:
        rows = rows.join(limits.select(*KEY, "uf", "dec_limite_medio").hint("merge"), [*KEY, "uf"], "left")
    else:
        rows = rows.withColumn("dec_limite_medio", F.lit(None).cast("double"))
    for side in (*sides, trend(history).select(*KEY, "tendencia"), months):
        rows = rows.join(side.hint("merge"), list(KEY), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.withColumns({"comprimento_mt_km": half_up(zero("mt_m") / 1000, 1), "km_sem_protecao": half_up(zero("gap_km"), 1)})
    return rows.select(
        *KEY, "uf", "score_risco", "dec_medio_12m", half_up(F.coalesce("dec_limite_medio", F.lit(12.0)), 2).alias("dec_limite"), "ratio_dec", "meses_violacao", F.coalesce("melhor", F.lit(False)).alias("melhor"),
        F.coalesce("tendencia", F.lit("estavel")).alias("tendencia"), "comprimento_mt_km", half_up(zero("bt_m") / 1000, 1).alias("comprimento_bt_km"), zero("n_tr").alias("n_transformadores"), half_up(zero("kva"), 0).alias("potencia_total_kva"),
        half_up(F.coalesce("age", F.lit(0.0)), 1).alias("idade_media_anos"), zero("n_old").alias("transformadores_criticos"), zero("n_rec").alias("n_religadores"), zero("n_sw").alias("n_chaves"), coverage_pct("km_sem_protecao", "comprimento_mt_km").alias("cobertura_pct"), "km_sem_protecao",
        "populacao", "domicilios", density("populacao", "area_km2").alias("densidade_hab_km2"), "pib_per_capita", "historico",
    )


def transformer_aging(transformers: DataFrame, reclosers: DataFrame, as_of: Column, *, municipality: str | None = None, utility: str | None = None, n: int | None = 500) -> DataFrame:
    """Age up to 60 points, distance from the utility's nearest recloser up to 40 (all of them from 2 km on, or without any).
    distance_m is null beyond 2 km. An unknown age gives 60 points, status ok and no remaining life."""
    if municipality is not None:
        transformers = transformers.filter(F.col("municipio") == municipality)
    transformers = scoped(transformers, utility)
    near = nearest_asset(transformers, reclosers, within_m=2000.0)
    rows = transformers.join(near, "cod_id", "left").withColumn("idade_anos", completed_years("data_implant", as_of).cast("int"))
    score = F.least(F.col("idade_anos") / 30.0, F.lit(1.0)) * 60 + F.least(F.coalesce(F.col("distance_m"), F.lit(2000.0)) / 2000.0, F.lit(1.0)) * 40
    rows = rows.withColumn("score_equipamento", half_up(score, 1)).select("*", remaining_life("idade_anos").alias("vida_util_restante_anos"), equipment_status("idade_anos").alias("status"))
    return rows if n is None else rows.orderBy(F.desc("score_equipamento"), "cod_id").limit(n)


def with_geometry(rows: DataFrame, geom: str = "geom") -> DataFrame:
    """What a map can draw."""
    return rows.filter(F.col(geom).isNotNull())


def critical_transformers(aging: DataFrame, n: int = 20) -> DataFrame:
    """The first of transformer_aging's rows whose status is critico, in its order."""
    return aging.filter(F.col("status") == "critico").orderBy(F.desc("score_equipamento"), "cod_id").limit(n)


def of_state(equipment: DataFrame, boundaries: DataFrame, uf: str, utility: str | None = None) -> DataFrame:
    """A utility's equipment in the municipalities of a state, by their names."""
    if utility is not None:
        equipment = equipment.filter(F.col("distribuidora") == utility)
    return equipment.join(boundaries.filter(F.col("uf") == uf.upper()).select(F.col("nome").alias("municipio")), "municipio", "left_semi")


def towns_by_state(indicators: DataFrame) -> DataFrame:
    return indicators.groupBy("uf").agg(F.count_distinct("municipio").alias("n"))


def utilities(rows: DataFrame) -> DataFrame:
    return rows.select("distribuidora").distinct()


def worst_mean_dec(indicators: DataFrame, n: int = 5) -> DataFrame:
    """The municipalities with the highest mean DEC."""
    return indicators.groupBy("municipio").agg(half_up(exact_mean("dec_apurado"), 6).alias("dec_medio")).orderBy(F.desc("dec_medio"), "municipio").limit(n)


def layer_extent(rows: DataFrame, geom: str = "geom") -> DataFrame:
    """One row: the box around all vertices of a column of lines."""
    v = rows.select(F.explode(geom).alias("p"))
    return v.agg(*(f(f"p.{c}").alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lon", "lat")))
