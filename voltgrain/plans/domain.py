"""The model's tables from the general tables orders, lineitem, supplier, nation, customer and part. Each is one SQL text that
both Spark and other engines read; geometries are added to the DataFrames afterwards."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "date '2001-12-31'"
BASE = ("nation", "supplier", "orders", "lineitem", "customer", "part")
UTILITY = "case {k}%3 when 0 then 'DIST_A' when 1 then 'DIST_N' else 'DIST_R' end"
N = "(select count(*) from supplier)"


def _lon(k: str, sk: str, f: int) -> str:
    return f"(-37e0+({sk}%10)*0.05e0+(({k}*{f})%100)*0.0005e0)"


def _lat(k: str, sk: str, f: int) -> str:
    return f"(-9.5e0+floor({sk}/10e0)*0.05e0+(({k}*{f})%100)*0.0005e0)"


def _installed(k: str) -> str:
    return f"case when {k}%17=0 then null else make_date(cast(2001-((s.s_suppkey*7)%35)-({k}%6) as int), cast(1+{k}%12 as int), cast(1+{k}%28 as int)) end"


def _lines(prefix: str, where: str) -> str:
    k, sk = "o.o_orderkey", "s.s_suppkey"
    return f"""select '{prefix}-'||cast(o.o_orderkey as string) as cod_id, s.s_name as municipio, n.n_name as uf, {UTILITY.format(k=k)} as distribuidora,
  cast(100+o.o_totalprice/100.0 as double) as comprimento, {_installed(k)} as data_implant,
  {_lon(k, sk, 37)} as lon1, {_lat(k, sk, 61)} as lat1, {_lon(k, sk, 37)}+(({k}%21)-10)*0.003e0 as lon2, {_lat(k, sk, 61)}+(({k}%13)-6)*0.003e0 as lat2
from orders o join supplier s on s.s_suppkey = o.o_custkey % {N} join nation n on n.n_nationkey=s.s_nationkey where {where}"""


def _points(prefix: str, rows: str, key: str, sk: str, f: int, g: int, where: str, more: str = "") -> str:
    k = f"r.{key}"
    return f"""select '{prefix}-'||cast({k} as string) as cod_id, s.s_name as municipio, n.n_name as uf, {UTILITY.format(k=k)} as distribuidora, {_installed(k)} as data_implant{more},
  {_lon(k, "s.s_suppkey", f)} as lon, {_lat(k, "s.s_suppkey", g)} as lat
from {rows} r join supplier s on s.s_suppkey = cast({sk} as bigint) % {N} join nation n on n.n_nationkey=s.s_nationkey where {where}"""


SQL = {
    "indicators": """select 'DIST_'||l.l_returnflag as distribuidora, s.s_name as municipio, n.n_name as uf,
  cast(year(l.l_shipdate) as int) as ano, cast(month(l.l_shipdate) as int) as mes,
  cast(round(cast(sum(cast(l.l_quantity as decimal(18,2))) as double)/count(*),2) as decimal(10,2)) as dec_apurado,
  cast(8+(max(s.s_suppkey)%5)*8 as decimal(10,2)) as dec_limite,
  cast(round(cast(sum(cast(l.l_discount as decimal(18,2))) as double)*100/count(*),2) as decimal(10,2)) as fec_apurado,
  cast(3+(max(s.s_suppkey)%4)*2 as decimal(10,2)) as fec_limite
from lineitem l join supplier s on s.s_suppkey=l.l_suppkey join nation n on n.n_nationkey=s.s_nationkey
group by 1,2,3,4,5""",
    "network": _lines("MT", "true"),
    "low_voltage": _lines("BT", "o.o_orderstatus='O'"),
    "reclosers": _points("RE", "customer", "c_custkey", "floor(r.c_custkey/25e0)", 41, 67, "r.c_custkey%25=0"),
    "switches": _points("CH", "customer", "c_custkey", "floor(r.c_custkey/11e0)", 41, 67, "r.c_custkey%11=0"),
    "transformers": _points("TR", "part", "p_partkey", "r.p_partkey", 43, 71, "true", ", cast(r.p_size as double) as potencia_nom, r.p_brand as fabricante"),
    "boundaries": """select lpad(cast(s.s_suppkey as string), 7, '0') as codigo_ibge, s.s_name as nome, lower(s.s_name) as nome_norm, n.n_name as uf,
  -37e0+(s.s_suppkey%10)*0.05e0 as west, -9.5e0+floor(s.s_suppkey/10e0)*0.05e0 as south
from supplier s join nation n on n.n_nationkey=s.s_nationkey""",
    "population": """select lpad(cast(s_suppkey as string), 7, '0') as codigo_ibge, cast(5000+(s_suppkey*7919)%200000 as int) as populacao,
  cast(floor((5000+(s_suppkey*7919)%200000)*0.35e0) as int) as domicilios, cast(null as double) as pib_per_capita, cast(20+s_suppkey%90 as double) as area_km2 from supplier""",
    "history": """select municipio, distribuidora, uf, ano, mes, cast(round(cast(least(cast(dec_apurado as double)/cast(dec_limite as double)/3e0, 1e0)*100 as decimal(18,8)), 2) as decimal(10,2)) as score_risco, dec_apurado as dec_medio
from indicators where ano*12+mes > (select max(ano*12+mes) from indicators) - 18""",
}


class Domain:
    """The tables over one folder; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE}

    @functools.cached_property
    def n_towns(self) -> int:
        """What N says; a number, since a subquery in a join's condition may not be ready when Spark broadcasts a side."""
        return self.base["supplier"].count()

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SQL:
            raise AttributeError(name)
        for t, df in self.base.items():
            df.createOrReplaceTempView(t)
        if name == "history":
            self.indicators.createOrReplaceTempView("indicators")
        df = self.spark.sql(SQL[name].replace(N, str(self.n_towns)))
        point = lambda lon, lat: F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat")) if isinstance(lon, str) else F.struct(lon.alias("lon"), lat.alias("lat"))
        if name in ("network", "low_voltage"):
            return df.withColumn("geom", F.array(point("lon1", "lat1"), point("lon2", "lat2"))).drop("lon1", "lat1", "lon2", "lat2")
        if name == "boundaries":
            w, s = F.col("west"), F.col("south")
            e, n = w + 0.05, s + 0.05
            return df.withColumn("geom", F.array(F.array(F.array(point(w, s), point(e, s), point(e, n), point(w, n), point(w, s))))).drop("west", "south")
        if "lon" in df.columns:
            return df.withColumn("geom", point("lon", "lat")).drop("lon", "lat")
        return df

    @property
    def as_of(self):
        return F.expr(AS_OF)


def with_tables(names: list[str], sql: str) -> str:
    """sql after a WITH clause of the tables it needs."""
    need = ["indicators"] if "history" in names else []
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in dict.fromkeys([*need, *names])) + "\n" + sql
