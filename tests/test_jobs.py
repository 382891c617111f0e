import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from voltgrain.operators import reports, sinks
from voltgrain.plans import jobs
from voltgrain.sources import files

def up():
    return F.lit(date(2024, 1, 1))


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_encodings(spark, tmp_path):
    text = "IdeConj;NomMunicípio\n1;Maceió\n"
    for name, enc in (("u", "utf-8"), ("b", "utf-8-sig"), ("l", "latin-1")):
        rows = files.read_csv_any_encoding(spark, write(tmp_path / name, text, enc))
        assert rows.columns == ["IdeConj", "NomMunicípio"] and rows.first()[1] == "Maceió"


def test_folder_of_mixed_encodings(spark, tmp_path):
    """Each file by its own encoding; quoted line breaks, separators and quotes."""
    at = tmp_path / "mixed"
    at.mkdir()
    write(at / "a.csv", "IdeConj;NomMunicípio\n1;Maceió\n2;\"duas\nlinhas; \"\"é\"\"\"\n", "utf-8-sig")
    write(at / "b.csv", "IdeConj;NomMunicípio\n3;São José\n4;\"Água\nBranca\"\n", "latin-1")
    write(at / "c.csv", "IdeConj;NomMunicípio\n5;plain\n")
    rows = files.read_csv_any_encoding(spark, str(at))
    assert rows.columns == ["IdeConj", "NomMunicípio"]
    assert sorted(map(tuple, rows.collect())) == [("1", "Maceió"), ("2", 'duas\nlinhas; "é"'), ("3", "São José"), ("4", "Água\nBranca"), ("5", "plain")]
    assert files.read_csv_any_encoding(spark, write(tmp_path / "only.csv", "IdeConj;X\n")).count() == 0


def test_headers():
    assert files.normal_header("  Mês (Réf.)  ") == "mes_ref"
    assert files.find_header(["plano", "ano"], ("ano",)) == "ano"
    assert files.find_header(["dec_limite_x", "dec_apurado"], ("dec", "limite")) == "dec_limite_x"
    assert files.state_scope("al, pe") == ["AL", "PE"] and len(files.state_scope("ALL")) == 27


def test_wide_ingest_and_rerun(spark, tmp_path):
    csv = write(tmp_path / "w.csv", "Agente;Município;UF;Competência;DEC Apurado;DEC Limite;FEC Apurado;FEC Limite\nU;Maceió;al;05/03/2023;12,5;10;3;4\nU;Maceió;al;05/03/2023;1;10;3;4\nU;;al;ruim;1;1;1;1\n", "latin-1")
    store = jobs.Store(spark, str(tmp_path / "store"))
    assert tuple(jobs.ingest_wide_indicators(store, csv).first()) == (3, 1, 0, 2)
    assert tuple(jobs.ingest_wide_indicators(store, csv).first()) == (3, 1, 2, 0)
    rows = store["indicadores_continuidade"].read().orderBy("dec_apurado").collect()
    assert [(r["ano"], r["mes"], r["uf"], r["dec_apurado"], r["violacao_dec"]) for r in rows] == [(2023, 3, "AL", 1.0, False), (2023, 3, "AL", 12.5, True)]
    empty = write(tmp_path / "e.csv", "Agente;Município;UF;Ano;Mes\n")
    assert tuple(jobs.ingest_wide_indicators(store, empty).first()) == (0, 0, 0, 0)


def test_table(spark, tmp_path):
    t = sinks.Table(spark, str(tmp_path / "t"))
    assert t.read() is None
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for _ in range(2):
        t.replace_scope(rows, F.lit(True))
    assert t.read().count() == 2
    t.replace_scope(rows.limit(0), F.col("k") == "a")  # an empty result empties its scope
    assert [tuple(r) for r in t.read().collect()] == [("b", 2)]
    t.upsert(spark.createDataFrame([("b", None), ("c", 3)], "k string, v int"), ["k"], {"v": sinks.newer_if_known})
    assert sorted(map(tuple, t.read().collect())) == [("b", 2), ("c", 3)]
    t.append_new(spark.createDataFrame([("c", 9), ("d", 4), ("d", 4)], "k string, v int"), ["k"])
    assert sorted(map(tuple, t.read().collect())) == [("b", 2), ("c", 3), ("d", 4), ("d", 4)]
    assert [tuple(r) for r in sinks.check_unique(t.read(), ["k"]).collect()] == [("d", 2)]
    tables = {"t": t}
    assert sinks.write_layers({"t": rows, "x": rows}, lambda name, some: tables[name].append(some)) == {"t": 2, "x": -1}


def test_parts(spark, tmp_path):
    """Changes leave parts of other scopes alone; older versions stay until they are cleaned."""
    t = sinks.Table(spark, str(tmp_path / "t"))
    part = lambda k, v: spark.createDataFrame([(k, v)], "k string, v int")
    for k in "abc":
        t.replace_scope(part(k, 1), {"k": k})
    before = {p["name"] for p in t._list()[1]}
    t.replace_scope(part("b", 2), {"k": "b"})
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 2), ("c", 1)]
    assert len(before & {p["name"] for p in t._list()[1]}) == 2
    t.upsert(part("c", 5), ["k"], {"v": sinks.newer}, {"k": "c"})
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 2), ("c", 5)]
    assert len(before & {p["name"] for p in t._list()[1]}) == 1
    t.append(part("a", 9))  # says nothing about its rows
    t.replace_scope(part("a", 3), {"k": "a"})
    assert sorted(map(tuple, t.read().collect())) == [("a", 3), ("b", 2), ("c", 5)]
    n, parts = t._list()
    with pytest.raises(RuntimeError, match="another job"):
        t._switch(n, parts)
    t.clean()
    assert len(t._names("lists")) == 1 and len(t._names("parts")) == len(parts)
    assert t.read().count() == 3


def test_scopes_of_many_values(spark, tmp_path):
    """A table in parts by utility and state: lists and bounds of a scope leave other parts' files alone."""
    t = sinks.Table(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(u, s, y) for u in ("A/x", "B", None) for s in ("AL", "PE") for y in range(2000, 2004)], "u string, s string, y int")
    t.replace_scope(rows, {"u": ["A/x", "B"], "s": ["AL", "PE"]}, by=["u", "s"])
    parts = t._list()[1]
    assert len(parts) == 6 and {tuple(p["same"].values()) for p in parts} == {(u, s) for u in ("A/x", "B", None) for s in ("AL", "PE")}
    assert t.read().columns == ["u", "s", "y"] and t.read().count() == 24
    t.replace_scope(rows.filter("u = 'B' and y = 2001"), {"u": ["B", "C"], "s": ["PE"]}, by=["u", "s"])
    now = t._list()[1]
    assert len([p for p in now if p in parts]) == 5 and t.read().count() == 20 + 2
    t.replace_scope(rows.limit(0), {"u": ["A/x"], "s": ["AL"], "y": sinks.Bounds(2002, None)}, by=["u", "s"])
    left = sorted((r["u"], r["s"], r["y"]) for r in t.read().filter("u = 'A/x' and s = 'AL'").collect())
    assert [y for _, _, y in left] == [2000, 2001] and len([p for p in t._list()[1] if p in now]) == len(now) - 1
    t.clean()
    assert t.read().count() == 20


def test_continuity_leaves_others_alone(spark, tmp_path):
    months = "".join(f"{k};2023{m:02d};{sig};12,0;10,0\n" for k in (1, 2) for m in (1, 2) for sig in ("DEC", "FEC"))
    long = write(tmp_path / "i.csv", "IdeConj;AnoMes;SigIndicador;ValApurado;ValLimite\n" + months)
    both = write(tmp_path / "a.csv", "IdeConj;SigUF;NomMunicipio;SigAgente\n1;AL;X;U\n2;AL;Y;V\n")
    one = write(tmp_path / "b.csv", "IdeConj;SigUF;NomMunicipio;SigAgente\n1;AL;X;U\n")
    store = jobs.Store(spark, str(tmp_path / "store"))
    table = store["indicadores_continuidade"]
    jobs.ingest_continuity(store, both, long, "AL")
    before = table._list()[1]
    assert jobs.ingest_continuity(store, one, long, "AL", last=2022).count() == 0
    assert [p for p in table._list()[1] if p in before] == [p for p in before if p["same"]["distribuidora"] == "V"]
    assert sorted((r["distribuidora"], r["mes"]) for r in table.read().collect()) == [("U", 1), ("U", 2), ("V", 1), ("V", 2)]


def test_stored_elsewhere(spark, tmp_path):
    """A second utility's equal cod_id is refused, the same utility's rerun is not; null keys are equal to none."""
    at = tmp_path / "features"
    kind = "COD_ID string, geometry struct<lon:double,lat:double>"
    spark.createDataFrame([("x", (1.0, 2.0)), (None, (1.0, 3.0))], kind).write.parquet(str(at / "EQRE"))
    spark.createDataFrame([("y", (1.0, 2.0))], kind).write.parquet(str(at / "EQSE"))
    store = jobs.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        assert jobs.ingest_network(store, str(at), "A", "AL") == {"religadores": 2, "subestacoes": 1}
    other = tmp_path / "other"
    spark.createDataFrame([("x", (1.0, 2.0)), ("z", (1.0, 3.0))], kind).write.parquet(str(other / "EQRE"))
    spark.createDataFrame([("z", (1.0, 2.0)), (None, None)], kind).write.parquet(str(other / "EQSE"))
    assert jobs.ingest_network(store, str(other), "B", "AL") == {"religadores": -1, "subestacoes": 2}
    assert {r["distribuidora"] for r in store["religadores"].read().collect()} == {"A"}
    stored = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("cod_id"), F.lit("A").alias("u"))
    rows = spark.range(4990, 6000).select(F.concat(F.lit("k"), "id").alias("cod_id"))
    assert {r[0] for r in sinks.stored_elsewhere(rows, stored, "cod_id", {"u": "B"}).collect()} == {f"k{i}" for i in range(4990, 5000)}
    assert sinks.stored_elsewhere(rows, stored, "cod_id", {"u": "A"}).count() == 0


def test_features(spark):
    rows = spark.createDataFrame([("a", [(1.0, 2.0), (3.0, 4.0)]), ("b", None)], "k string, geom array<struct<lon:double,lat:double>>")
    found = [json.loads(r[0]) for r in sinks.to_features(rows).collect()]
    assert found[0] == {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}, "properties": {"k": "a"}}
    assert found[1]["geometry"] is None


@pytest.fixture
def landed(spark, tmp_path):
    square = [[-37.0, -9.5], [-36.9, -9.5], [-36.9, -9.4], [-37.0, -9.4], [-37.0, -9.5]]
    shapes = {"type": "FeatureCollection", "features": [{"properties": {"codarea": "270"}, "geometry": {"type": "Polygon", "coordinates": [square]}}, {"properties": {"codarea": " "}, "geometry": {"type": "Polygon", "coordinates": [square]}}, {"properties": {"codarea": "271"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}}]}
    people = [{"resultados": [{"series": [{"localidade": {"id": "270", "nome": "Maceió"}, "serie": {"2022": "1001"}}, {"localidade": {"id": "271", "nome": "?"}, "serie": {"2022": "..."}}]}]}]
    at = tmp_path / "features"
    line = [(-36.98, -9.45), (-36.95, -9.45)]
    spark.createDataFrame([("s1", "13.8", "CA", 3000.0, "2000-05-01", line), ("s2", None, "CA", 10.0, None, [(5.0, 5.0), (5.1, 5.0)])], "COD_ID string, TEN_NOM string, TIP_CND string, COMP_TREC double, DAT_INS string, geometry array<struct<lon:double,lat:double>>").write.parquet(str(at / "SSDMT"))
    spark.createDataFrame([("r1", "2010-01-01", (-36.98, -9.45))], "COD_ID string, DAT_INS string, geometry struct<lon:double,lat:double>").write.parquet(str(at / "EQRE"))
    spark.createDataFrame([("f1", "s1", 7, 2500.0)], "COD_ID string, COD_SSDMT string, QTD_UC int, COMP_TREC double").withColumn("geometry", F.expr("array(array(named_struct('lon', 0d, 'lat', 0d)))")).write.parquet(str(at / "CTMT"))
    months = "".join(f"1;2023{m:02d};{sig};12,0;10,0\n" for m in range(1, 13) for sig in ("DEC", "FEC")) + "1;202301;XXX;1;1\n9;202301;DEC;1;1\n"
    return {
        "geojson": write(tmp_path / "b.json", json.dumps(shapes)), "names": write(tmp_path / "n.json", json.dumps([{"id": 270, "nome": "Maceió"}])), "population": write(tmp_path / "p.json", json.dumps(people)),
        "features": {"U": str(at)}, "attributes": write(tmp_path / "a.csv", "IdeConj;SigUF;NomMunicipio;SigAgente\n1;AL;MACEIÓ;U\n9;PE;X;U\n", "latin-1"), "indicators": write(tmp_path / "i.csv", "IdeConj;AnoMes;SigIndicador;ValApurado;ValLimite\n" + months),
    }


def test_full_pipeline_and_rerun(spark, tmp_path, landed):
    store = jobs.Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # a rerun gives the same tables
        jobs.full_pipeline(store, **landed, uf="AL", as_of=up(), year=2023, month=12)
        counts = {n: store[n].read().count() for n in jobs.TABLES if store[n].read() is not None}
        assert counts == {"rede_mt": 2, "religadores": 1, "alimentadores": 1, "indicadores_continuidade": 12, "mapa_risco": 1, "historico_score": 1, "gaps_protecao": 2, "ibge_municipios": 2, "ibge_populacao": 2, "somas": 5}
    lines = {r["cod_id"]: r for r in store["rede_mt"].read().collect()}
    assert lines["s1"]["municipio"] == "Maceió" and lines["s2"]["municipio"] == "" and lines["s1"]["data_implant"] == date(2000, 5, 1)
    assert store["alimentadores"].read().first()["comprimento_km"] == 2.5
    found = store["mapa_risco"].read().first()
    assert (found["municipio"], found["meses_violacao"], found["idade_media_anos"]) == ("Maceió", 12, 23.0)
    people = {r["codigo_ibge"]: r for r in store["ibge_populacao"].read().collect()}
    assert (people["270"]["populacao"], people["270"]["domicilios"], people["271"]["populacao"]) == (1001, 350, 0)
    assert people["270"]["area_km2"] == pytest.approx(121, rel=0.03)
    assert {r["nome"] for r in store["ibge_municipios"].read().collect()} == {"Maceió", "Município 271"}


def test_empty_ingest_clears_its_scope(spark, tmp_path, landed):
    store = jobs.Store(spark, str(tmp_path / "store"))
    jobs.ingest_continuity(store, landed["attributes"], landed["indicators"], "AL")
    assert store["indicadores_continuidade"].read().count() == 12
    nothing = write(tmp_path / "none.csv", "IdeConj;AnoMes;SigIndicador;ValApurado;ValLimite\n")
    assert jobs.ingest_continuity(store, landed["attributes"], nothing, "AL").count() == 0
    assert store["indicadores_continuidade"].read().count() == 0


def test_layers_fail_alone(spark, tmp_path):
    """A layer whose cod_id occurs twice is not stored; the others are."""
    at = tmp_path / "features"
    kind = "COD_ID string, geometry struct<lon:double,lat:double>"
    spark.createDataFrame([("a", (1.0, 2.0)), ("a", (1.0, 3.0))], kind).write.parquet(str(at / "EQRE"))
    spark.createDataFrame([("b", (1.0, 2.0))], kind).write.parquet(str(at / "UNSDAT"))
    store = jobs.Store(spark, str(tmp_path / "store"))
    assert jobs.ingest_network(store, str(at), "U", "AL") == {"religadores": -1, "transformadores": 1}
    assert store["religadores"].read() is None


def test_geojson_layers(spark, tmp_path):
    at = tmp_path / "g"
    at.mkdir()
    line = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4.5]]}, "properties": {"cod_id": "x", "COMP_TREC": 2000, "other": None}}
    write(at / "CTMT.geojson", json.dumps(line) + "\n")
    write(at / "SSDMT.geojson", json.dumps(line) + "\n" + json.dumps(line | {"geometry": None}) + "\n")
    found = files.read_network_layers(spark, str(at), "U", "al")
    r = found["alimentadores"].first()
    assert (r["cod_id"], r["comprimento_km"], r["uf"], r["geom"][0][1]["lat"], r["subestacao_id"]) == ("x", 2.0, "AL", 4.5, None)
    assert [r["geom"] is None for r in found["rede_mt"].collect()] == [False, True]


def sums(store, table):
    rows = store["somas"].read().filter(F.col("tabela") == table)
    return {(r["distribuidora"], r["uf"], r["municipio"], r["data_implant"]): (r["n"], r["comprimento"], r["comprimento_km"]) for r in rows.collect()}


def test_sums_follow_their_tables(spark, tmp_path):
    """A job makes the sums of its own scope anew and leaves the files of all others alone; null dates and towns are keys too."""
    store = jobs.Store(spark, str(tmp_path / "store"))
    kind = "cod_id string, municipio string, distribuidora string, uf string, comprimento double, data_implant date, geom array<struct<lon:double,lat:double>>"
    old, line = date(1990, 1, 1), [(-36.98, -9.45), (-36.95, -9.45)]
    rows = [("a", "X", "U", "AL", 2.5, old, line), ("b", "X", "U", "AL", None, old, line), ("c", None, "U", "AL", 1.0, None, line), ("d", "X", "V", "PE", 4.0, old, line)]
    store["rede_mt"].replace_scope(spark.createDataFrame(rows, kind), {}, by=["distribuidora", "uf"])
    store["religadores"].append(spark.createDataFrame([("r", "X", "V", "PE", None, (-36.98, -9.45))], "cod_id string, municipio string, distribuidora string, uf string, data_implant date, geom struct<lon:double,lat:double>"))
    for name in ("rede_mt", "religadores"):
        jobs.summarise(store, name, {})
    assert sums(store, "rede_mt") == {("U", "AL", "X", old): (2, 2.5, None), ("U", "AL", None, None): (1, 1, None), ("V", "PE", "X", old): (1, 4, None)}
    jobs.gaps(store)
    before = sums(store, "gaps_protecao")
    assert {k[:3]: v[0] for k, v in before.items()} == {("U", "AL", "X"): 2, ("U", "AL", None): 1, ("V", "PE", "X"): 1}
    jobs.gaps(store, radius_m=1000.0, utility="V", uf="pe")
    files_of = lambda name, u: {r[0] for r in store[name].read().filter(F.col("distribuidora") == u).select(F.input_file_name()).distinct().collect()}
    kept = {n: files_of(n, "U") for n in ("gaps_protecao", "somas")}
    jobs.gaps(store, radius_m=1500.0, utility="V", uf="pe")
    assert kept["gaps_protecao"] == files_of("gaps_protecao", "U") and kept["somas"] == files_of("somas", "U")
    after = sums(store, "gaps_protecao")
    assert {k: v for k, v in after.items() if k[0] == "U"} == {k: v for k, v in before.items() if k[0] == "U"}
    assert after["V", "PE", "X", None][2] < before["V", "PE", "X", None][2]
    jobs.clear_state(store, "U", "AL")
    assert {k[0] for k in sums(store, "rede_mt")} == {"V"} and {k[0] for k in sums(store, "gaps_protecao")} == {"V"}
    jobs.summarise(store, "chaves", {"uf": "AL"})  # never stored
    assert sums(store, "chaves") == {}


def test_tables_of_municipalities_are_not_broadcast(spark, tmp_path):
    """What has a row for each municipality went to the driver, several tables at once, to be broadcast."""
    scores = spark.createDataFrame([("X", "U", "AL", 50.0, 1.0, 0.5, 2, 10.0)], "municipio string, distribuidora string, uf string, score_risco double, dec_medio_12m double, ratio_dec double, meses_violacao long, idade_media_anos double")
    sums = spark.createDataFrame([("gaps_protecao", "X", "U", "AL", None, 3, None, None, 1.5)], "tabela string, municipio string, distribuidora string, uf string, data_implant date, n long, comprimento decimal(28,4), potencia_nom decimal(28,4), comprimento_km double").withColumn("comprimento_km", F.col("comprimento_km").cast("decimal(28,4)"))
    boundaries = spark.createDataFrame([("1", "X", "x", "AL", None)], "codigo_ibge string, nome string, nome_norm string, uf string, geom string")
    population = spark.createDataFrame([("1", 100, 35, None, 10.0)], "codigo_ibge string, populacao int, domicilios int, pib_per_capita double, area_km2 double")
    history = spark.createDataFrame([("X", "U", "AL", 2001, 12, 50.0, 1.0)], "municipio string, distribuidora string, uf string, ano int, mes int, score_risco double, dec_medio double")
    tables = []
    for i, rows in enumerate((scores, sums, boundaries, population, history)):
        rows.write.parquet(f"{tmp_path}/{i}")  # a stored table's size is known to Spark
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
    scores, sums, boundaries, population, history = tables
    profile = reports.municipality_profile_of_sums(scores, sums, boundaries, population, history, up())
    ranking = reports.risk_ranking_of_sums(scores, boundaries, population, sums, history, up())
    for found in (profile, ranking):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert [(r["populacao"], r["km_sem_protecao"]) for r in found.collect()] == [(100, 1.5)]


def test_score_without_indicators(spark, tmp_path):
    store = jobs.Store(spark, str(tmp_path / "store"))
    jobs.score(store, up())
    assert store["mapa_risco"].read() is None


def test_long_csv_works_indicators_out_once(spark, sf_dir, monkeypatch):
    """Consumer sets, values and states each aggregated all of lineitem."""
    from voltgrain.plans import domain, registry

    before, seen = domain.Domain.__getattr__, []
    monkeypatch.setattr(domain.Domain, "__getattr__", lambda self, name: seen.append(name) or before(self, name))
    assert registry.queries()["r12_ingest_continuity"](spark, sf_dir).columns[:3] == ["distribuidora", "municipio", "uf"]
    assert seen.count("indicators") == 1
