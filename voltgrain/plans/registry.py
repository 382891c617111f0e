"""Every query of the entry file, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltgrain.functions import columns as C
from voltgrain.functions import crs, geo, wkb
from voltgrain.operators import reports, risk, sinks, spatial
from voltgrain.plans import jobs, landing
from voltgrain.plans.domain import AS_OF, Domain, with_tables
from voltgrain.sources import files
from voltgrain.sources.staging import staging_path

Query = Callable[[SparkSession, str], DataFrame]


def _age(d: str) -> str:
    return f"(year({AS_OF})-year({d})-case when month({d})*100+day({d})>1231 then 1 else 0 end)"


def _half_up(x: str, n: int) -> str:
    return f"cast(round(cast({x} as decimal(18,8)),{n}) as double)"


RECENT = """recent as (select municipio, distribuidora, uf, cast(sum(dec_apurado) as double)/count(dec_apurado) as dec_m, cast(sum(dec_limite) as double)/count(dec_limite) as lim_m,
  sum(case when dec_apurado > dec_limite then 1 else 0 end) as viol from indicators where ano*12+mes >= (select max(ano*12+mes)-11 from indicators) group by 1,2,3),
recent2 as (select *, case when lim_m > 0 then least(dec_m/lim_m, 3e0) else 0e0 end as ratio from recent)"""
NETWORK_AGE = f"net_age as (select municipio, distribuidora, cast(sum({_age('data_implant')}) as double)/count(*) as age from network where data_implant is not null group by 1,2)"
SCORES = f"""{RECENT}, {NETWORK_AGE},
scores as (select i.municipio, i.distribuidora, i.uf, {_half_up("least(ratio/3e0,1e0)*40+least(viol/12e0,1e0)*30+least(coalesce(age,20e0)/40e0,1e0)*30", 2)} as score_risco,
  {_half_up("dec_m", 2)} as dec_medio_12m, {_half_up("ratio", 4)} as ratio_dec, cast(viol as bigint) as meses_violacao, {_half_up("coalesce(age,20e0)", 1)} as idade_media_anos
  from recent2 i left join net_age a on a.municipio=i.municipio and a.distribuidora=i.distribuidora)"""
BEST = "score_risco desc nulls last, uf, municipio, distribuidora"

_T0, _T1 = geo.disc_span("lon1", "lat1", "lon2", "lat2", "r.lon", "r.lat", "500e0")
GAPS = f"""spans as (select m.cod_id, {_T0} as t0, {_T1} as t1 from network m join reclosers r on r.distribuidora=m.distribuidora
  and r.lat between least(m.lat1,m.lat2)-0.01 and greatest(m.lat1,m.lat2)+0.01 and r.lon between least(m.lon1,m.lon2)-0.01 and greatest(m.lon1,m.lon2)+0.01),
ordered as (select cod_id, t0, t1, coalesce(max(t1) over (partition by cod_id order by t0, t1 rows between unbounded preceding and 1 preceding), 0e0) as upto from spans where t0 is not null),
covered as (select cod_id, sum(greatest(0e0, t1-greatest(t0, upto))) as part from ordered group by 1),
exposed as (select m.cod_id, m.distribuidora, m.municipio, m.uf, {geo.planar_length("lon1", "lat1", "lon2", "lat2")}*(1e0-coalesce(c.part,0e0)) as len_m from network m left join covered c on c.cod_id=m.cod_id),
gaps as (select cod_id, distribuidora, municipio, uf, {_half_up("len_m/1000e0", 3)} as comprimento_km, least({_half_up("len_m/1000e0/10e0*100e0", 1)}, 100e0) as score_vulnerabilidade from exposed where len_m > 100)"""
TREND = f"""numbered as (select *, row_number() over (partition by municipio, distribuidora order by ano desc, mes desc) as rn from history),
means as (select municipio, distribuidora, cast(sum(case when rn<=3 then score_risco end) as double)/count(case when rn<=3 then 1 end) as a,
  cast(sum(case when rn>3 then score_risco end) as double)/nullif(count(case when rn>3 then 1 end),0) as b from numbered where rn<=6 group by 1,2),
trend as (select municipio, distribuidora, {_half_up("a", 4)} as media_recente, {_half_up("b", 4)} as media_anterior from means),
trends as (select *, case when media_recente > media_anterior+2 then 'piorando' when media_recente < media_anterior-2 then 'melhorando' else 'estavel' end as tendencia from trend)"""
#: Metres between two points less than 100 km apart by their mean latitude: another way than the operator's, to a millimetre.
MEAN_LATITUDE = """pairs0 as (select t.cod_id, r.cod_id as asset, radians((t.lat+r.lat)/2e0) as p, radians(r.lat-t.lat) as dp, radians(r.lon-t.lon) as dl from transformers t join reclosers r on r.distribuidora=t.distribuidora),
pairs1 as (select *, 0.006739496775478957e0*cos(p)*cos(p) as h, tan(p)*tan(p) as t2 from pairs0),
pairs2 as (select *, 6399593.625864023e0/sqrt(1e0+h) as n from pairs1),
pairs as (select cod_id, asset, sqrt(pow(dl*n*cos(p)*(1e0-pow(dl*sin(p),2)/24e0+(1e0+h-9e0*h*t2)/(24e0*pow(1e0+h,2))*dp*dp),2)
 +pow(dp*n/(1e0+h)*cos(dl/2e0)*(1e0+(1e0-2e0*h)/24e0*pow(dl*cos(p),2)+h*(1e0-t2)/(8e0*pow(1e0+h,2))*dp*dp),2)) as d from pairs2)"""
NEAREST = f"""{MEAN_LATITUDE},
near as (select cod_id, asset, d from (select *, row_number() over (partition by cod_id order by d, asset) as n from pairs where d <= 2000) where n=1)"""


def _scores(d: Domain) -> DataFrame:
    return risk.risk_score(d.indicators, d.network, d.as_of)


def _gaps(d: Domain) -> DataFrame:
    return spatial.protection_gaps(d.network, d.reclosers)


def over(build: Callable[[Domain], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(Domain(spark, sf_dir))


def _profile(d: Domain) -> DataFrame:
    return _profile_columns(reports.municipality_profile(_scores(d), d.network, d.low_voltage, d.transformers, d.reclosers, d.switches, _gaps(d), d.boundaries, d.population, d.history, d.as_of, limits=risk.recent_means(d.indicators)))


def _profile_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_historico", F.coalesce(F.size("historico"), F.lit(0))).drop("historico", "pib_per_capita", "domicilios")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[Domain, jobs.Store]:
    """A store with scores and sums. Gaps are stored of all utilities with another radius, then of one utility after the other
    with the right one, so each job replaces the sums of its own scope."""
    d, store = Domain(spark, sf_dir), jobs.Store(spark, staging_path(spark, "sums"))
    for name, rows in (("rede_mt", d.network), ("rede_bt", d.low_voltage), ("transformadores", d.transformers), ("religadores", d.reclosers), ("chaves", d.switches)):
        store[name].replace_scope(rows, {}, by=["distribuidora"])
        jobs.summarise(store, name, {})
    store["indicadores_continuidade"].append(d.indicators)
    jobs.score(store, d.as_of)
    jobs.gaps(store, radius_m=200.0)
    for (utility,) in reports.utilities(store["rede_mt"].read()).collect():
        jobs.gaps(store, utility=utility)
    return d, store


def _ranking_from_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, store = _stored(spark, sf_dir)
    return reports.risk_ranking_of_sums(store["mapa_risco"].read(), d.boundaries, d.population, store["somas"].read(), d.history, d.as_of, page=2, limit=20)


def _profile_from_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, store = _stored(spark, sf_dir)
    limits = risk.recent_means(store["indicadores_continuidade"].read())
    return _profile_columns(reports.municipality_profile_of_sums(store["mapa_risco"].read(), store["somas"].read(), d.boundaries, d.population, d.history, d.as_of, limits=limits))


def _aging(d: Domain) -> DataFrame:
    return reports.transformer_aging(d.transformers, d.reclosers, d.as_of, n=None).select("cod_id", "potencia_nom", "fabricante", "idade_anos", "vida_util_restante_anos", "status", "score_equipamento", F.col("asset").alias("religador"), C.half_up("distance_m", 0).alias("distancia_m"))


def _write_wide_csv(d: Domain, path: str, where: str = "true") -> None:
    """The indicators as a wide CSV with decimal commas."""
    comma = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.", ",")
    rows = d.indicators.filter(where).select(F.col("distribuidora").alias("Nome Agente"), F.col("municipio").alias("MUNICÍPIO"), F.col("uf").alias("Sig UF"), F.format_string("15/%02d/%d", "mes", "ano").alias("Data Referência"), *(comma(c).alias(n) for c, n in (("dec_apurado", "DEC Apurado"), ("dec_limite", "DEC Limite"), ("fec_apurado", "FEC Apurado"), ("fec_limite", "FEC Limite"))))
    rows.write.option("sep", ";").option("header", True).option("encoding", files.LATIN).csv(path)


def _indicator_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indicators ingested from a wide CSV; a rerun changes nothing."""
    d, path = Domain(spark, sf_dir), staging_path(spark, "wide-csv")
    _write_wide_csv(d, f"{path}/csv")
    store = jobs.Store(spark, f"{path}/store")
    for _ in range(2):
        jobs.ingest_wide_indicators(store, f"{path}/csv")
    return store["indicadores_continuidade"].read()


def _accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ingest of all indicators counts when those of even months are stored already."""
    d, path = Domain(spark, sf_dir), staging_path(spark, "accounting")
    store = jobs.Store(spark, f"{path}/store")
    for name, where in (("even", "mes % 2 = 0"), ("all", "true")):
        _write_wide_csv(d, f"{path}/{name}", where)
        counts = jobs.ingest_wide_indicators(store, f"{path}/{name}")
    return counts


def _append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of the first half of each year stored, then all appended that aren't there."""
    d = Domain(spark, sf_dir)
    store = sinks.Table(spark, staging_path(spark, "append-new"))
    store.append_new(d.indicators.filter("mes <= 6").withColumn("lote", F.lit(1)), jobs.INDICATOR_KEYS)
    store.append_new(d.indicators.withColumn("lote", F.lit(2)), jobs.INDICATOR_KEYS)
    return store.read().groupBy("lote", "ano").agg(F.count(F.lit(1)).alias("n"))


def _append_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers appended, one of them failing: rows written, as what is stored says too."""
    d, path = Domain(spark, sf_dir), staging_path(spark, "layers")
    store = jobs.Store(spark, path)
    layers = {"chaves": d.switches, "religadores": d.reclosers, "subestacoes": d.reclosers.withColumn("geom", F.raise_error(F.lit("unreadable")))}
    counts = sinks.write_layers(layers, lambda name, rows: store[name].append(rows))
    stored = [store[n].read().select(F.lit(n).alias("tabela"), F.lit(counts[n]).cast("long").alias("escritas"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("guardadas"), "cod_id") for n in ("chaves", "religadores")]
    return stored[0].unionByName(stored[1]).withColumn("falhas", F.lit(counts["subestacoes"]).cast("long"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transformers written as a feature collection and read back as landed features."""
    d, path = Domain(spark, sf_dir), staging_path(spark, "features")
    rows = d.transformers.select(F.col("cod_id").alias("COD_ID"), F.col("potencia_nom").alias("POT_NOM"), F.col("fabricante").alias("FAB"), "geom")
    sinks.write_feature_collection(rows, f"{path}/UNSDAT.geojson", kind="Point")
    found = files.read_network_layers(spark, path, "DIST_A", "br")["transformadores"]
    return found.select("cod_id", "potencia_nom", "fabricante", *(C.half_up(f"geom.{c}", 6).alias(c) for c in ("lon", "lat")))


def _long_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indicators ingested from consumer sets and a long CSV; a rerun replaces its own rows."""
    d, path = Domain(spark, sf_dir), staging_path(spark, "long-csv")
    d.indicators.write.parquet(f"{path}/indicators")  # worked out once for the three that follow
    indicators = spark.read.parquet(f"{path}/indicators")
    set_id = F.concat_ws("/", "distribuidora", "municipio")
    indicators.select(set_id.alias("IdeConj"), F.lower("uf").alias("SigUF"), F.lower("municipio").alias("NomMunicipio"), F.col("distribuidora").alias("SigAgente")).distinct().write.option("sep", ";").option("header", True).csv(f"{path}/sets")
    comma = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.", ",")
    long = indicators.select(set_id.alias("IdeConj"), F.format_string("%d%02d", "ano", "mes").alias("AnoMes"), F.explode(F.array(*(F.struct(F.lit(s.upper()).alias("SigIndicador"), comma(f"{s}_apurado").alias("ValApurado"), comma(f"{s}_limite").alias("ValLimite")) for s in ("dec", "fec")))).alias("v")).select("IdeConj", "AnoMes", "v.*")
    long.write.option("sep", ";").option("header", True).csv(f"{path}/values")
    states = [r[0] for r in indicators.select("uf").distinct().collect()]  # a list of states
    store = jobs.Store(spark, f"{path}/store")
    for _ in range(2):
        rows = jobs.ingest_continuity(store, f"{path}/sets", f"{path}/values", states)
    return rows.select("distribuidora", "municipio", "uf", "ano", "mes", *(C.half_up(c, 2).alias(c) for c in files.NUMBERS), "violacao_dec", "violacao_fec")


def _sink_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores stored once, then again for one utility, as a rerun does."""
    d = Domain(spark, sf_dir)
    store = sinks.Table(spark, staging_path(spark, "scores"))
    store.replace_scope(_scores(d), F.lit(True))
    store.replace_scope(risk.risk_score(d.indicators, d.network, d.as_of, utility="DIST_A"), F.col("distribuidora") == "DIST_A")
    return store.read()


def _snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    store = sinks.Table(spark, staging_path(spark, "history"))
    keys = ["municipio", "distribuidora", "ano", "mes"]
    first = d.history.withColumns({c: F.col(c).cast("double") for c in ("score_risco", "dec_medio")})
    store.upsert(first, keys, sinks.SNAPSHOT_UPDATE)
    last = first.select(F.max("ano")).first()[0]
    store.upsert(risk.score_snapshot(_scores(d), last, 12), keys, sinks.SNAPSHOT_UPDATE)
    return store.read()


#: The system of the substations' landed coordinates, and its zone.
UTM_EPSG, UTM_ZONE = 31984, 24


def _landed_features(d: Domain, path: str) -> None:
    """The network's seven layers as files of features, without municipalities: substations in a UTM zone's metres, switches as
    GeoJSON, feeders (two lines each, a little beside the network's) in metres. Substations stand a little beside the reclosers."""
    date = F.date_format("data_implant", "dd/MM/yyyy").alias("DAT_INS")
    land = lambda rows, layer, *more, geom="geom": rows.select(F.col("cod_id").alias("COD_ID"), *(F.col(a).alias(b) for a, b in more), date, F.col(geom).alias("geometry")).write.parquet(f"{path}/{layer}")
    land(d.network, "SSDMT", ("comprimento", "COMP_TREC"))
    land(d.low_voltage, "SSDBT", ("comprimento", "COMP_TREC"))
    land(d.transformers, "UNSDAT", ("potencia_nom", "POT_NOM"), ("fabricante", "FAB"))
    land(d.reclosers, "EQRE")
    east, north = geo.utm("(geom.lon+0.0002e0)", "(geom.lat+0.0002e0)", UTM_ZONE)
    moved = d.reclosers.withColumn("cod_id", F.concat(F.lit("S"), "cod_id")).withColumn("at", F.struct(F.expr(east).alias("lon"), F.expr(north).alias("lat")))
    land(moved, "EQSE", geom="at")
    on_line = lambda t: F.struct(*((F.col("geom")[0][c] + t * (F.col("geom")[1][c] - F.col("geom")[0][c]) + 0.0001).alias(c) for c in ("lon", "lat")))
    two = F.array(F.array(on_line(0.0), on_line(0.3)), F.array(on_line(0.3), on_line(1.0)))
    land(d.network.withColumn("cod_id", F.concat(F.lit("F"), "cod_id")).withColumn("line", two), "CTMT", ("municipio", "COD_SSDMT"), ("comprimento", "COMP_TREC"), geom="line")
    sinks.write_feature_collection(d.switches.select(F.col("cod_id").alias("COD_ID"), F.col("uf").alias("TIP_EQMT"), date, "geom"), f"{path}/EQCHAVE.geojson", kind="Point")


def _network_store(d: Domain, path: str) -> jobs.Store:
    _landed_features(d, f"{path}/features")
    store = jobs.Store(d.spark, f"{path}/store")
    store["ibge_municipios"].append(d.boundaries)
    return store


def _import_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers landed as one utility's, imported, placed in municipalities and scored."""
    d, path = Domain(spark, sf_dir), staging_path(spark, "import")
    store = _network_store(d, path)
    store["indicadores_continuidade"].append(risk.with_violations(d.indicators))
    jobs.import_and_score(store, f"{path}/features", "DIST_A", "br", d.as_of, {"EQSE": UTM_EPSG})
    return store["mapa_risco"].read()


def _ingest_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, path = Domain(spark, sf_dir), staging_path(spark, "network")
    store = _network_store(d, path)
    for _ in range(2):  # a rerun replaces its own rows
        written = jobs.ingest_network(store, f"{path}/features", "DIST_A", "br", {"EQSE": UTM_EPSG})
    return _layer_contents({name: store[name].read() for name in written})


def _layer_contents(rows: dict[str, DataFrame]) -> DataFrame:
    """Every layer's rows in one table."""
    none, out = F.lit(None).cast("string"), None
    for name in sorted(rows):
        extra = {"alimentadores": F.concat_ws("/", "subestacao_id", C.half_up("comprimento_km", 3)), "chaves": F.col("tipo_chave")}.get(name, none)
        some = rows[name].select(F.lit(name).alias("tabela"), "cod_id", "municipio", "uf", "distribuidora", "data_implant", extra.alias("extra"))
        out = some if out is None else out.unionByName(some)
    return out


def _ingest_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven layers of r14_ingest_network out of container files, with binary geometries; substations in a zone's metres, as
    their container says."""
    d, path = Domain(spark, sf_dir), staging_path(spark, "containers")
    store = _network_store(d, path)
    landed = files.read_network_layers(spark, f"{path}/features", "DIST_A", "br")
    layers = {layer: landed[table] for layer, (table, _) in files.LAYERS.items()}
    back = {layer: {c: f for c, f in fields.items() if c in layers[layer].columns} for layer, (_, fields) in files.LAYERS.items()}
    metres = lambda c, name: c * 1000 if name == "comprimento_km" else c
    rows = {layer: df.select(*(metres(F.col(c), c).alias(f) for c, f in back[layer].items()), wkb.binary(F.col("geom"), files.geometry_kind(layer)).alias("geometry")) for layer, df in layers.items()}
    landing.write_containers(rows, f"{path}/containers", {"EQSE": UTM_EPSG})
    jobs.ingest_network(store, f"{path}/containers", "DIST_A", "br")
    return _layer_contents({table: store[table].read() for table, _ in files.LAYERS.values()})


def _stored_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reclosers of one utility are stored; of a layer of many more, said to be another's, those are found that are stored
    already, and the layer is refused."""
    d, path = Domain(spark, sf_dir), staging_path(spark, "elsewhere")
    store = jobs.Store(spark, f"{path}/store")
    store["religadores"].append(d.reclosers.filter("distribuidora = 'DIST_A'"))
    d.reclosers.select(F.col("cod_id").alias("COD_ID"), F.col("geom").alias("geometry")).write.parquet(f"{path}/features/EQRE")
    written = jobs.ingest_network(store, f"{path}/features", "DIST_B", "br")
    found = sinks.stored_elsewhere(d.reclosers, store["religadores"].read(), "cod_id", {"distribuidora": "DIST_B", "uf": "BR"})
    return found.withColumn("escritas", F.lit(written["religadores"]))


def _full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job in order, twice; scores with the snapshot, the gaps and the people of what was stored."""
    d, path = Domain(spark, sf_dir), staging_path(spark, "pipeline")
    _landed_features(d, f"{path}/features")
    _write_offices(d, path)
    set_id = F.concat_ws("/", "distribuidora", "municipio")
    d.indicators.select(set_id.alias("IdeConj"), F.lit("BR").alias("SigUF"), F.col("municipio").alias("NomMunicipio"), F.lit("DIST_A").alias("SigAgente")).distinct().write.option("sep", ";").option("header", True).csv(f"{path}/sets")
    comma = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.", ",")
    d.indicators.select(set_id.alias("IdeConj"), F.format_string("%d%02d", "ano", "mes").alias("AnoMes"), F.explode(F.array(*(F.struct(F.lit(s.upper()).alias("SigIndicador"), comma(f"{s}_apurado").alias("ValApurado"), comma(f"{s}_limite").alias("ValLimite")) for s in ("dec", "fec")))).alias("v")).select("IdeConj", "AnoMes", "v.*").write.option("sep", ";").option("header", True).csv(f"{path}/values")
    store = jobs.Store(spark, f"{path}/store")
    for _ in range(2):
        jobs.full_pipeline(store, geojson=f"{path}/shapes", names=f"{path}/names", population=f"{path}/people", features={"DIST_A": f"{path}/features"}, attributes=f"{path}/sets", indicators=f"{path}/values", uf="br", as_of=d.as_of, year=2001, month=12, epsg={"EQSE": UTM_EPSG})
    gaps = store["gaps_protecao"].read().groupBy("municipio").agg(F.count(F.lit(1)).alias("n_gaps"))
    people = store["ibge_populacao"].read().select(F.col("nome").alias("municipio"), "populacao")
    rows = store["historico_score"].read().select("municipio", "distribuidora", "uf", "ano", "mes").join(gaps, "municipio", "left").join(people, "municipio", "left")
    return rows.join(store["mapa_risco"].read().select("municipio", "meses_violacao"), "municipio").withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0)))


def _write_offices(d: Domain, path: str, per_document: int = 500) -> None:
    """Boundaries, names and population as the offices' JSON documents: some for each state, so that none grows with it."""
    pair = lambda p: F.array(p["lon"], p["lat"])
    shape = F.struct(F.lit("Polygon").alias("type"), F.transform(F.element_at("geom", 1), lambda r: F.transform(r, pair)).alias("coordinates"))
    feature = F.struct(F.struct(F.col("codigo_ibge").alias("codarea")).alias("properties"), shape.alias("geometry"))
    part = F.pmod(F.xxhash64("codigo_ibge"), F.lit(1 + d.n_towns // per_document)).alias("part")
    by_part = d.boundaries.join(d.population, "codigo_ibge").groupBy("uf", part)
    documents = by_part.agg(
        F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("shapes"),
        F.to_json(F.collect_list(F.struct(F.col("codigo_ibge").alias("id"), "nome"))).alias("names"),
        F.to_json(F.array(F.struct(F.array(F.struct(F.collect_list(F.struct(F.struct(F.col("codigo_ibge").alias("id"), "nome").alias("localidade"), F.create_map(F.lit("2022"), F.col("populacao").cast("string")).alias("serie"))).alias("series"))).alias("resultados")))).alias("people"),
    )
    for name in ("shapes", "names", "people"):
        documents.select(name).write.option("maxRecordsPerFile", 1).text(f"{path}/{name}")


def _boundaries_and_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries and population from the offices' documents; a rerun updates its own rows."""
    d, path = Domain(spark, sf_dir), staging_path(spark, "offices")
    _write_offices(d, path)
    store = jobs.Store(spark, f"{path}/store")
    jobs.ingest_boundaries(store, f"{path}/shapes", f"{path}/names", "br")
    for _ in range(2):
        jobs.ingest_population(store, f"{path}/people", "br")
    return store["ibge_populacao"].read().select("codigo_ibge", "nome", "uf", "populacao", "domicilios", C.half_up("area_km2", 4).alias("area_km2"))


#: A system for each remainder of a transformer's number: other datums, other planes.
MANY_SYSTEMS = (31984, 29194, 5880, 29101, 3857, 4618, 22524, 32724)


def _reprojected(d: Domain) -> DataFrame:
    """Transformers' places through the coordinates of many systems and back."""
    rows, out = d.transformers.withColumn("k", F.pmod(F.xxhash64("cod_id"), F.lit(len(MANY_SYSTEMS)))), None
    for k, epsg in enumerate(MANY_SYSTEMS):
        some = rows.filter(F.col("k") == k).withColumn("there", crs.from_degrees(F.col("geom"), epsg))
        back = some.withColumn("back", crs.to_degrees(F.col("there"), dict(some.dtypes)["there"], epsg))
        out = back if out is None else out.unionByName(back)
    return out.select("cod_id", *(C.half_up(f"back.{c}", 6).alias(c) for c in ("lon", "lat")))


def _cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A utility's transformers that stay when a state is cleared."""
    d, path = Domain(spark, sf_dir), staging_path(spark, "cleared")
    store = jobs.Store(spark, path)
    store["ibge_municipios"].append(d.boundaries)
    store["transformadores"].append(d.transformers)
    jobs.clear_state(store, "DIST_A", "nation_7")
    return store["transformadores"].read().select("cod_id", "distribuidora", "uf")


def queries() -> dict[str, Query]:
    return {
        "r1_risk_score": over(_scores),
        "r1_top_risk": over(lambda d: risk.top_risk(_scores(d))),
        "a2_recent_means": over(lambda d: risk.recent_means(d.indicators).select("municipio", "distribuidora", "uf", C.half_up("dec_medio_12m", 4).alias("dec_medio"), C.half_up("dec_limite_medio", 4).alias("limite_medio"), C.half_up("ratio_dec", 4).alias("ratio"), "meses_violacao")),
        "a3_network_age": over(lambda d: risk.network_age(d.network, d.as_of).select("municipio", "distribuidora", C.half_up("idade_media_anos", 4).alias("idade"))),
        "a8_towns_by_state": over(lambda d: reports.towns_by_state(d.indicators)),
        "a9_utilities": over(lambda d: reports.utilities(d.indicators)),
        "k5_violations": over(lambda d: risk.with_violations(d.indicators).groupBy("distribuidora", "ano").agg(F.count_if("violacao_dec").alias("n_dec"), F.count_if("violacao_fec").alias("n_fec"))),
        "k6_unique": over(lambda d: sinks.check_unique(d.indicators, ["distribuidora", "municipio", "ano"])),
        "p_scalar_functions": over(lambda d: d.transformers.select("cod_id", C.title_case(F.lower("municipio")).alias("nome"), C.fold_key("municipio").alias("chave"), C.completed_years("data_implant", d.as_of).alias("idade"), C.equipment_status(C.completed_years("data_implant", d.as_of)).alias("status"), C.remaining_life(C.completed_years("data_implant", d.as_of)).alias("resto"), C.comma_decimal(F.regexp_replace(F.col("potencia_nom").cast("string"), r"\.", ",")).alias("kva"))),
        "p11_risk_bands": over(lambda d: _scores(d).groupBy(C.risk_band("score_risco").alias("faixa")).agg(F.count(F.lit(1)).alias("n"))),
        "l4_worst_mean_dec": over(lambda d: reports.worst_mean_dec(d.indicators)),
        "w2_trend": over(lambda d: risk.trend(d.history)),
        "w3_last_months": over(lambda d: risk.last_months(d.history).withColumns({c: F.col(c).cast("double") for c in ("score_risco", "dec_medio")})),
        "w4_best_utility": over(lambda d: risk.best_utility(_scores(d)).select("municipio", "uf", "distribuidora", "score_risco")),
        "r2_snapshot_upsert": _snapshot_upsert,
        "r3_protection_gaps": over(lambda d: _gaps(d).drop("geom")),
        "r4_gap_report": over(lambda d: reports.gap_report(_gaps(d)).drop("geom")),
        "a10_gap_totals": over(lambda d: reports.gap_totals(_gaps(d))),
        "r5_risk_map": over(lambda d: reports.risk_map(_scores(d), d.boundaries, utility="dist_a").drop("boundary")),
        "r6_risk_ranking": over(lambda d: reports.risk_ranking(_scores(d), d.boundaries, d.population, _gaps(d), d.transformers, d.history, d.as_of, page=2, limit=20)),
        "r7_kpis": over(lambda d: reports.kpis(_scores(d), d.boundaries, d.population, _gaps(d), d.transformers, d.as_of, critical=50)),
        "r8_critical_segments": over(lambda d: reports.critical_segments(d.network, _scores(d), min_score=50).select("cod_id", "distribuidora", "municipio", "comprimento", "score_risco")),
        "r9_transformers_with_risk": over(lambda d: reports.transformers_with_risk(d.transformers, _scores(d), n=None).select("cod_id", "distribuidora", "municipio", "potencia_nom", "fabricante", "score_risco")),
        "r10_municipality_profile": over(_profile),
        "r6_from_sums": _ranking_from_sums,
        "r10_from_sums": _profile_from_sums,
        "r11_transformer_aging": over(_aging),
        "g2_line_length": over(lambda d: d.network.select("cod_id", C.half_up(geo.line_length_m("geom") / 1000, 3).alias("km"))),
        "g3_polygon_area": over(lambda d: d.boundaries.select("codigo_ibge", C.half_up(geo.polygon_area_km2(F.col("geom")), 4).alias("km2"))),
        "g10_assign_municipality": over(lambda d: spatial.assign_municipality(d.transformers, d.boundaries).select("cod_id", "codigo_ibge")),
        "a12_extent": over(lambda d: reports.layer_extent(d.network).select(*(C.half_up(c, 6).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")))),
        "r12_ingest_continuity": _long_csv,
        "r13_ingest_wide_indicators": _indicator_csv,
        "k3_replace_scope": _sink_rerun,
        "r14_ingest_network": _ingest_network,
        "s8_containers": _ingest_containers,
        "r15_boundaries_and_population": _boundaries_and_population,
        "r16_import_and_score": _import_and_score,
        "r17_full_pipeline": _full_pipeline,
        "k1_append_layers": _append_layers,
        "k6_stored_elsewhere": _stored_elsewhere,
        "k2_append_new": _append_new,
        "k7_features": _features,
        "a14_accounting": _accounting,
        "s11_state_scope": over(lambda d: d.indicators.filter(F.col("uf").isin(files.state_scope("nation_1, Nation_7,NATION_12"))).groupBy("uf").agg(F.count(F.lit(1)).alias("n"))),
        "f1_state_map": over(lambda d: reports.risk_map(_scores(d), d.boundaries, uf="nation_7").drop("boundary")),
        "f8_one_town": over(lambda d: reports.transformer_aging(d.transformers, d.reclosers, d.as_of, municipality="Supplier#000000001", n=None).select("cod_id", "idade_anos", "score_equipamento")),
        "f11_with_geometry": over(lambda d: reports.with_geometry(reports.risk_map(_scores(d), d.boundaries.filter("codigo_ibge > '0000005'")), "boundary").drop("boundary")),
        "f12_critical_transformers": over(lambda d: reports.critical_transformers(reports.transformer_aging(d.transformers, d.reclosers, d.as_of, n=None)).select("cod_id", "idade_anos", "score_equipamento")),
        "j14_clear_state": _cleared,
        "g4_lines_near": over(lambda d: spatial.lines_near(d.network, d.reclosers, 500.0).groupBy("point").agg(F.count(F.lit(1)).alias("n"))),
        "g6_nearest_anywhere": over(lambda d: spatial.nearest_asset(d.transformers, d.reclosers, within_m=None).select("cod_id", "asset", C.half_up("distance_m", 0).alias("metros"))),
        "g8_to_wgs84": over(lambda d: d.reclosers.withColumn("at", geo.to_wgs84(F.col("geom"))).select("cod_id", *(C.half_up(f"at.{c}", 6).alias(c) for c in ("lon", "lat")))),
        "g9_reproject": over(_reprojected),
    }


def _area_sql() -> str:
    """Shoelace over a square's projected corners."""
    corner = [("west", "south"), ("west+0.05e0", "south"), ("west+0.05e0", "south+0.05e0"), ("west", "south+0.05e0")]
    xy = [geo.utm(f"({a})", f"({b})") for a, b in corner]
    terms = "+".join(f"({x1}*{y2}-{x2}*{y1})" for (x1, y1), (x2, y2) in zip(xy, xy[1:] + xy[:1], strict=True))
    return f"abs({terms})/2e0/1e6"


def _in_box(lon: str, lat: str) -> str:
    return f"{lon}>=b.west and {lon}<b.west+0.05e0 and {lat}>=b.south and {lat}<b.south+0.05e0"


def _middle(c: str) -> str:
    return f"({c}1+0.5e0*({c}2-{c}1))"


#: Lines as one utility's, in the municipality of their middle (towns are squares side by side).
PLACED = f""", placed as (select n.cod_id, n.data_implant, 'DIST_A' as distribuidora, coalesce(min_by(b.nome, b.codigo_ibge),'') as municipio
 from (select *, {_middle("lon")} as lon, {_middle("lat")} as lat from network) n left join boundaries b on {_in_box('n.lon', 'n.lat')} group by 1, 2)"""


def _in_town(table: str, name: str, rows: str, extra: str = "cast(null as varchar)") -> str:
    """SQL: rows (with lon, lat) of a table in the municipality that holds them."""
    return f"select '{table}' as tabela, t.cod_id, coalesce(min_by(b.nome, b.codigo_ibge),'') as municipio, 'BR' as uf, 'DIST_A' as distribuidora, t.data_implant, {extra} as extra from ({rows}) t left join boundaries b on {_in_box('t.lon', 't.lat')} group by t.cod_id, t.data_implant{', t.uf' if name else ''}"


#: Metres from a recloser to a line of its utility, by the height of the triangle or the nearer end.
NEAR_LINE = """near_line as (select r.cod_id as point, n.cod_id as line, radians(n.lon2-n.lon1)*{1} as vx, radians(n.lat2-n.lat1)*{0} as vy, radians(r.lon-n.lon1)*{1} as wx, radians(r.lat-n.lat1)*{0} as wy
 from network n join reclosers r on r.distribuidora=n.distribuidora and abs(r.lat-n.lat1) < 0.06 and abs(r.lon-n.lon1) < 0.06 where n.lon1<>n.lon2 or n.lat1<>n.lat2),
near_line2 as (select point, line, case when vx*wx+vy*wy <= 0 then sqrt(wx*wx+wy*wy) when vx*wx+vy*wy >= vx*vx+vy*vy then sqrt((wx-vx)*(wx-vx)+(wy-vy)*(wy-vy)) else abs(vx*wy-vy*wx)/sqrt(vx*vx+vy*vy) end as d from near_line)""".format(*geo.curvature("n.lat1"))


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    return found | {"s8_containers": found["r14_ingest_network"], "r6_from_sums": found["r6_risk_ranking"], "r10_from_sums": found["r10_municipality_profile"]}


def _oracle_sql() -> dict[str, str]:
    both = ["indicators", "network"]
    boundary = "left join boundaries b on b.nome_norm = lower(s.municipio) and b.uf = s.uf"
    gap_sum = "(select municipio, distribuidora, cast(sum(cast(comprimento_km as decimal(18,3))) as double) as km from gaps group by 1,2)"
    old_count = f"(select municipio, distribuidora, count(*) as n from transformers where {_age('data_implant')} > 25 group by 1,2)"
    return {
        "r1_risk_score": with_tables(both, f", {SCORES} select * from scores"),
        "r1_top_risk": with_tables(both, f", {SCORES} select municipio, distribuidora, score_risco from scores order by {BEST} limit 5"),
        "a2_recent_means": with_tables(["indicators"], f", {RECENT} select municipio, distribuidora, uf, {_half_up('dec_m', 4)} as dec_medio, {_half_up('lim_m', 4)} as limite_medio, {_half_up('ratio', 4)} as ratio, cast(viol as bigint) as meses_violacao from recent2"),
        "a3_network_age": with_tables(["network"], f", {NETWORK_AGE} select municipio, distribuidora, {_half_up('age', 4)} as idade from net_age"),
        "a8_towns_by_state": with_tables(["indicators"], "select uf, count(distinct municipio) as n from indicators group by 1"),
        "a9_utilities": with_tables(["indicators"], "select distinct distribuidora from indicators"),
        "k5_violations": with_tables(["indicators"], "select distribuidora, ano, cast(sum(case when dec_apurado>dec_limite then 1 else 0 end) as bigint) as n_dec, cast(sum(case when fec_apurado>fec_limite then 1 else 0 end) as bigint) as n_fec from indicators group by 1,2"),
        "k6_unique": with_tables(["indicators"], "select distribuidora, municipio, ano, count(*) as n from indicators group by 1,2,3 having count(*) > 1"),
        "p_scalar_functions": with_tables(["transformers"], f"select cod_id, upper(substr(municipio,1,1))||lower(substr(municipio,2)) as nome, lower(municipio) as chave, {_age('data_implant')} as idade, case when {_age('data_implant')}>25 then 'critico' when {_age('data_implant')}>20 then 'atencao' else 'ok' end as status, greatest(0, 30-{_age('data_implant')}) as resto, potencia_nom as kva from transformers"),
        "p11_risk_bands": with_tables(both, f", {SCORES} select case when score_risco>=80 then 'critico' when score_risco>=60 then 'alto' when score_risco>=40 then 'medio' else 'baixo' end as faixa, count(*) as n from scores group by 1"),
        "l4_worst_mean_dec": with_tables(["indicators"], f"select municipio, {_half_up('cast(sum(dec_apurado) as double)/count(dec_apurado)', 6)} as dec_medio from indicators group by 1 order by 2 desc, 1 limit 5"),
        "w2_trend": with_tables(["history"], f", {TREND} select municipio, distribuidora, media_recente, media_anterior, tendencia from trends"),
        "w3_last_months": with_tables(["history"], f", {TREND} select municipio, distribuidora, uf, ano, mes, cast(score_risco as double) as score_risco, cast(dec_medio as double) as dec_medio, cast(row_number() over (partition by municipio, distribuidora order by ano, mes) as int) as ordem from numbered where rn <= 12"),
        "w4_best_utility": with_tables(both, f", {SCORES} select municipio, uf, distribuidora, score_risco from (select *, row_number() over (partition by municipio, uf order by score_risco desc nulls last, distribuidora) as n from scores) where n=1"),
        "r2_snapshot_upsert": with_tables(["indicators", "network", "history"], f""", {SCORES}, y as (select max(ano) as ano from history)
select coalesce(s.municipio,h.municipio) as municipio, coalesce(s.distribuidora,h.distribuidora) as distribuidora, coalesce(h.uf,s.uf) as uf, coalesce(h.ano,s.ano) as ano, coalesce(h.mes,s.mes) as mes, coalesce(s.score_risco,cast(h.score_risco as double)) as score_risco, coalesce(s.dec_medio_12m,cast(h.dec_medio as double)) as dec_medio
from history h full join (select scores.*, y.ano, 12 as mes from scores, y) s on s.municipio=h.municipio and s.distribuidora=h.distribuidora and s.ano=h.ano and s.mes=h.mes"""),
        "r3_protection_gaps": with_tables(["network", "reclosers"], f", {GAPS} select * from gaps"),
        "r4_gap_report": with_tables(["network", "reclosers"], f", {GAPS} select * from gaps where score_vulnerabilidade >= 30 order by score_vulnerabilidade desc, comprimento_km desc, cod_id limit 200"),
        "a10_gap_totals": with_tables(["network", "reclosers"], f", {GAPS}, t as (select municipio, count(*) as n, sum(cast(comprimento_km as decimal(18,3))) as km from gaps group by 1) select cast(sum(n) as bigint) as n_gaps, {_half_up('sum(km)', 1)} as km_total, (select municipio from t order by km desc, municipio limit 1) as pior_municipio from t"),
        "r5_risk_map": with_tables([*both, "boundaries"], f", {SCORES} select s.*, b.codigo_ibge from scores s {boundary} where s.distribuidora ilike '%dist_a%'"),
        "r6_risk_ranking": with_tables([*both, "reclosers", "transformers", "boundaries", "population", "history"], f""", {SCORES}, {GAPS}, {TREND}
select s.municipio, s.distribuidora, s.uf, s.score_risco, s.dec_medio_12m, s.meses_violacao, s.idade_media_anos, coalesce(p.populacao,0) as populacao, coalesce(g.km,0e0) as km_sem_protecao, coalesce(o.n,0) as n_transformadores_criticos, coalesce(t.tendencia,'estavel') as tendencia,
 cast(row_number() over (order by s.score_risco desc nulls last, s.uf, s.municipio, s.distribuidora) as int) as posicao, (select count(*) from scores) as total, cast(ceil((select count(*) from scores)/20e0) as bigint) as pages
from scores s {boundary} left join population p on p.codigo_ibge=b.codigo_ibge left join {gap_sum} g on g.municipio=s.municipio and g.distribuidora=s.distribuidora left join {old_count} o on o.municipio=s.municipio and o.distribuidora=s.distribuidora left join trends t on t.municipio=s.municipio and t.distribuidora=s.distribuidora
qualify posicao between 21 and 40"""),
        "r7_kpis": with_tables([*both, "reclosers", "transformers", "boundaries", "population"], f""", {SCORES}, {GAPS}
select {_half_up('cast(sum(cast(score_risco as decimal(10,2))) as double)/count(*)', 2)} as score_medio, count(case when score_risco>50 then 1 end) as municipios_criticos, count(distinct case when score_risco>50 then municipio||'/'||uf end) as municipios_distintos,
 {_half_up('cast(sum(cast(dec_medio_12m as decimal(10,2))) as double)/count(dec_medio_12m)', 4)} as dec_medio_geral, cast(sum(meses_violacao) as bigint) as total_meses_violacao,
 (select cast(round(coalesce(sum(p.populacao)*0.37,0),0) as bigint) from scores s join boundaries b on b.nome_norm=lower(s.municipio) and b.uf=s.uf join population p on p.codigo_ibge=b.codigo_ibge where s.score_risco>50) as consumidores_afetados,
 (select {_half_up('coalesce(sum(cast(comprimento_km as decimal(18,3))),0)', 1)} from gaps) as km_rede_sem_protecao, (select count(*) from transformers where {_age('data_implant')} > 25) as transformadores_criticos
from scores"""),
        "r8_critical_segments": with_tables(both, f", {SCORES} select n.cod_id, n.distribuidora, n.municipio, n.comprimento, s.score_risco from network n join scores s on s.municipio=n.municipio and s.distribuidora=n.distribuidora where s.score_risco>=50 order by s.score_risco desc, n.cod_id limit 500"),
        "r9_transformers_with_risk": with_tables([*both, "transformers"], f", {SCORES} select t.cod_id, t.distribuidora, t.municipio, t.potencia_nom, t.fabricante, coalesce(s.score_risco,0e0) as score_risco from transformers t left join scores s on s.municipio=t.municipio and s.distribuidora=t.distribuidora"),
        "r10_municipality_profile": with_tables([*both, "low_voltage", "reclosers", "switches", "transformers", "boundaries", "population", "history"], f""", {SCORES}, {GAPS}, {TREND},
mt as (select municipio, distribuidora, cast(sum(cast(comprimento as decimal(18,4))) as double) as m, cast(sum({_age('data_implant')}) as double)/count({_age('data_implant')}) as age from network group by 1,2),
bt as (select municipio, distribuidora, cast(sum(cast(comprimento as decimal(18,4))) as double) as m from low_voltage group by 1,2),
tr as (select municipio, distribuidora, count(*) as n, sum(cast(potencia_nom as decimal(18,2))) as kva, count(case when {_age('data_implant')}>25 then 1 end) as old from transformers group by 1,2),
re as (select municipio, distribuidora, count(*) as n from reclosers group by 1,2), sw as (select municipio, distribuidora, count(*) as n from switches group by 1,2),
hi as (select municipio, distribuidora, count(*) as n from numbered where rn<=12 group by 1,2),
j as (select s.*, row_number() over (partition by s.municipio, s.uf order by s.score_risco desc nulls last, s.distribuidora) = 1 as melhor, {_half_up('coalesce(i.lim_m,12e0)', 2)} as dec_limite, coalesce(t.tendencia,'estavel') as tendencia, {_half_up('coalesce(mt.m,0)/1000e0', 1)} as comprimento_mt_km, {_half_up('coalesce(bt.m,0)/1000e0', 1)} as comprimento_bt_km,
 coalesce(tr.n,0) as n_transformadores, {_half_up('coalesce(tr.kva,0)', 0)} as potencia_total_kva, {_half_up('coalesce(mt.age,0e0)', 1)} as idade_mt, coalesce(tr.old,0) as transformadores_criticos, coalesce(re.n,0) as n_religadores, coalesce(sw.n,0) as n_chaves, {_half_up('coalesce(g.km,0)', 1)} as km_sem_protecao, p.populacao, p.area_km2, cast(coalesce(hi.n,0) as int) as n_historico
 from scores s join recent2 i on i.municipio=s.municipio and i.distribuidora=s.distribuidora and i.uf=s.uf {boundary} left join population p on p.codigo_ibge=b.codigo_ibge left join mt on mt.municipio=s.municipio and mt.distribuidora=s.distribuidora left join bt on bt.municipio=s.municipio and bt.distribuidora=s.distribuidora
 left join tr on tr.municipio=s.municipio and tr.distribuidora=s.distribuidora left join re on re.municipio=s.municipio and re.distribuidora=s.distribuidora left join sw on sw.municipio=s.municipio and sw.distribuidora=s.distribuidora left join hi on hi.municipio=s.municipio and hi.distribuidora=s.distribuidora left join {gap_sum} g on g.municipio=s.municipio and g.distribuidora=s.distribuidora left join trends t on t.municipio=s.municipio and t.distribuidora=s.distribuidora)
select municipio, distribuidora, uf, score_risco, dec_medio_12m, dec_limite, ratio_dec, meses_violacao, melhor, tendencia, comprimento_mt_km, comprimento_bt_km, n_transformadores, potencia_total_kva, idade_mt as idade_media_anos, transformadores_criticos, n_religadores, n_chaves,
 case when comprimento_mt_km>0 then greatest(0, cast(floor((1-km_sem_protecao/comprimento_mt_km)*100+0.5) as bigint)) end as cobertura_pct, km_sem_protecao, populacao, case when area_km2>0 then cast(floor(populacao/area_km2+0.5) as bigint) end as densidade_hab_km2, n_historico from j"""),
        "r11_transformer_aging": with_tables(["transformers", "reclosers"], f", {NEAREST}, a as (select t.*, {_age('t.data_implant')} as idade, n.asset, n.d from transformers t left join near n on n.cod_id=t.cod_id) select cod_id, potencia_nom, fabricante, cast(idade as int) as idade_anos, greatest(0, 30-cast(idade as int)) as vida_util_restante_anos, case when idade>25 then 'critico' when idade>20 then 'atencao' else 'ok' end as status, {_half_up('least(idade/30e0,1e0)*60+least(coalesce(d,2000e0)/2000e0,1e0)*40', 1)} as score_equipamento, asset as religador, {_half_up('d', 0)} as distancia_m from a"),
        "g2_line_length": with_tables(["network"], f"select cod_id, {_half_up(geo.planar_length('lon1', 'lat1', 'lon2', 'lat2') + '/1000e0', 3)} as km from network"),
        "g3_polygon_area": with_tables(["boundaries"], f"select codigo_ibge, {_half_up(_area_sql(), 4)} as km2 from boundaries"),
        "g10_assign_municipality": with_tables(["transformers", "boundaries"], "select t.cod_id, min(b.codigo_ibge) as codigo_ibge from transformers t join boundaries b on t.lon>=b.west and t.lon<b.west+0.05e0 and t.lat>=b.south and t.lat<b.south+0.05e0 group by 1"),
        "a12_extent": with_tables(["network"], ", ".join(["select " + _half_up("least(min(lon1),min(lon2))", 6) + " as min_lon", _half_up("least(min(lat1),min(lat2))", 6) + " as min_lat", _half_up("greatest(max(lon1),max(lon2))", 6) + " as max_lon", _half_up("greatest(max(lat1),max(lat2))", 6) + " as max_lat from network"])),
        "r12_ingest_continuity": with_tables(["indicators"], "select distribuidora, upper(substr(municipio,1,1))||lower(substr(municipio,2)) as municipio, upper(uf) as uf, ano, mes, cast(dec_apurado as double) as dec_apurado, cast(dec_limite as double) as dec_limite, cast(fec_apurado as double) as fec_apurado, cast(fec_limite as double) as fec_limite, dec_apurado>dec_limite as violacao_dec, fec_apurado>fec_limite as violacao_fec from indicators"),
        "r13_ingest_wide_indicators": with_tables(["indicators"], "select distribuidora, municipio, upper(uf) as uf, ano, mes, cast(dec_apurado as double) as dec_apurado, cast(dec_limite as double) as dec_limite, cast(fec_apurado as double) as fec_apurado, cast(fec_limite as double) as fec_limite, dec_apurado>dec_limite as violacao_dec, fec_apurado>fec_limite as violacao_fec from indicators"),
        "k3_replace_scope": with_tables(both, f", {SCORES} select * from scores"),
        "r14_ingest_network": with_tables(["network", "low_voltage", "transformers", "reclosers", "switches", "boundaries"], " union all ".join([
            _in_town("rede_mt", "", f"select *, {_middle('lon')} as lon, {_middle('lat')} as lat from network"), _in_town("rede_bt", "", f"select *, {_middle('lon')} as lon, {_middle('lat')} as lat from low_voltage"),
            _in_town("transformadores", "", "select * from transformers"), _in_town("religadores", "", "select * from reclosers"), _in_town("chaves", "uf", "select * from switches", "t.uf"),
            _in_town("subestacoes", "", "select 'S'||cod_id as cod_id, data_implant, lon+0.0002e0 as lon, lat+0.0002e0 as lat from reclosers"),
            _in_town("alimentadores", "extra", f"select 'F'||cod_id as cod_id, data_implant, {_middle('lon')}+0.0001e0 as lon, {_middle('lat')}+0.0001e0 as lat, municipio||'/'||cast({_half_up('comprimento/1000e0', 3)} as varchar) as uf from network", "t.uf")])),
        "r15_boundaries_and_population": with_tables(["boundaries", "population"], f"select b.codigo_ibge, b.nome, 'BR' as uf, p.populacao, p.domicilios, {_half_up(_area_sql(), 4)} as area_km2 from boundaries b join population p on p.codigo_ibge=b.codigo_ibge"),
        "r16_import_and_score": with_tables([*both, "boundaries"], f"{PLACED}, {SCORES.replace('from network where', 'from placed where')} select * from scores where distribuidora='DIST_A'"),
        "r17_full_pipeline": with_tables([*both, "reclosers", "boundaries", "population"], f"""{PLACED}, own as (select n.* replace ('DIST_A' as distribuidora, p.municipio as municipio) from network n join placed p on p.cod_id=n.cod_id),
 own_reclosers as (select * replace ('DIST_A' as distribuidora) from reclosers), {GAPS.replace('from network m', 'from own m').replace('join reclosers r', 'join own_reclosers r')},
 ind as (select upper(substr(municipio,1,1))||lower(substr(municipio,2)) as municipio, ano, mes, cast(sum(cast(dec_apurado as decimal(18,6))) as double)/count(*) as d, cast(sum(cast(dec_limite as decimal(18,6))) as double)/count(*) as l from indicators group by 1,2,3),
 viol as (select municipio, cast(sum(case when d > l then 1 else 0 end) as bigint) as meses_violacao from ind where ano*12+mes >= (select max(ano*12+mes)-11 from ind) group by 1)
 select v.municipio, 'DIST_A' as distribuidora, 'BR' as uf, 2001 as ano, 12 as mes, coalesce(g.n,0) as n_gaps, p.populacao, v.meses_violacao from viol v
 left join (select municipio, count(*) as n from gaps group by 1) g on g.municipio=v.municipio left join boundaries b on b.nome=v.municipio left join population p on p.codigo_ibge=b.codigo_ibge"""),
        "k1_append_layers": with_tables(["switches", "reclosers"], "select 'chaves' as tabela, (select count(*) from switches) as escritas, (select count(*) from switches) as guardadas, cod_id, -1 as falhas from switches union all select 'religadores', (select count(*) from reclosers), (select count(*) from reclosers), cod_id, -1 from reclosers"),
        "k6_stored_elsewhere": with_tables(["reclosers"], "select cod_id, -1 as escritas from reclosers where distribuidora='DIST_A'"),
        "k2_append_new": with_tables(["indicators"], "select case when mes <= 6 then 1 else 2 end as lote, ano, count(*) as n from indicators group by 1, 2"),
        "k7_features": with_tables(["transformers"], f"select cod_id, potencia_nom, fabricante, {_half_up('lon', 6)} as lon, {_half_up('lat', 6)} as lat from transformers"),
        "a14_accounting": with_tables(["indicators"], "select count(*) as total, 0 as dropped, count(case when mes % 2 = 0 then 1 end) as existing, count(case when mes % 2 = 1 then 1 end) as new from indicators"),
        "s11_state_scope": with_tables(["indicators"], "select uf, count(*) as n from indicators where uf in ('NATION_1', 'NATION_7', 'NATION_12') group by 1"),
        "f1_state_map": with_tables([*both, "boundaries"], f", {SCORES} select s.*, b.codigo_ibge from scores s {boundary} where s.uf = 'NATION_7'"),
        "f8_one_town": with_tables(["transformers", "reclosers"], f", {NEAREST} select t.cod_id, cast({_age('t.data_implant')} as int) as idade_anos, {_half_up('least(' + _age('t.data_implant') + '/30e0,1e0)*60+least(coalesce(n.d,2000e0)/2000e0,1e0)*40', 1)} as score_equipamento from transformers t left join near n on n.cod_id=t.cod_id where t.municipio='Supplier#000000001'"),
        "f11_with_geometry": with_tables([*both, "boundaries"], f", {SCORES} select s.*, b.codigo_ibge from scores s {boundary} where b.codigo_ibge > '0000005'"),
        "f12_critical_transformers": with_tables(["transformers", "reclosers"], f", {NEAREST} select t.cod_id, cast({_age('t.data_implant')} as int) as idade_anos, {_half_up('least(' + _age('t.data_implant') + '/30e0,1e0)*60+least(coalesce(n.d,2000e0)/2000e0,1e0)*40', 1)} as score_equipamento from transformers t left join near n on n.cod_id=t.cod_id where {_age('t.data_implant')} > 25 order by score_equipamento desc, t.cod_id limit 20"),
        "j14_clear_state": with_tables(["transformers", "boundaries"], "select cod_id, distribuidora, uf from transformers where not (distribuidora='DIST_A' and municipio in (select nome from boundaries where uf='NATION_7'))"),
        "g4_lines_near": with_tables(["network", "reclosers"], f", {NEAR_LINE} select point, count(*) as n from near_line2 where d <= 500 group by 1"),
        "g6_nearest_anywhere": with_tables(["transformers", "reclosers"], f", {NEAREST.replace('where d <= 2000', '')} select cod_id, asset, {_half_up('d', 0)} as metros from near"),
        "g8_to_wgs84": with_tables(["reclosers"], f"select cod_id, {_half_up('lon', 6)} as lon, {_half_up('lat', 6)} as lat from reclosers"),
        "g9_reproject": with_tables(["transformers"], f"select cod_id, {_half_up('lon', 6)} as lon, {_half_up('lat', 6)} as lat from transformers"),
    }
