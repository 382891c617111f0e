"""Parquet tables that jobs write: append, append what is new, replace a scope, upsert. A table is a folder of parts; each
change writes new parts and then a list of those that count, so nothing reads what it overwrites, a failed job changes
nothing, and parts that a change doesn't touch stay as they are."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


class Table:
    """A table as a folder: parts/ has the rows, lists/ which parts each version has. A part may say that all its rows have
    some value in a column: changes of other values leave it alone. One writer at a time; of two, the later one fails."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _list(self) -> tuple[int, list[dict]]:
        """The newest version's number and parts; -1 without any."""
        done = [n for n in self._names("lists") if n.endswith(".json")]
        if not done:
            return -1, []
        rows = self.spark.read.text(f"{self.path}/lists/{done[-1]}", wholetext=True).collect()
        return int(done[-1].removesuffix(".json")), json.loads(rows[0][0])

    def _switch(self, n: int, parts: list[dict]) -> None:
        """Make parts the version n: one rename, which fails if there is such a version."""
        new = self._at(f"{self.path}/lists/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if not self._fs.rename(new, self._at(f"{self.path}/lists/{n:010d}.json")):
            raise RuntimeError(f"another job has changed {self.path}")

    def _parts_by(self, rows: DataFrame, by: list[str]) -> list[dict]:
        """Write rows once, a part for each combination of values of a few columns; several tasks share a large one."""
        name, copies = f"parts/{uuid.uuid4().hex}", {f"_by_{c}": F.col(c) for c in by}
        rows.withColumns(copies).hint("rebalance", *map(F.col, copies)).write.partitionBy(*copies).parquet(f"{self.path}/{name}")
        found = [{"name": name, "same": {}}]
        for c in by:
            below = [(p, d) for p in found for d in self._names(p["name"]) if d.startswith(f"_by_{c}=")]
            found = [{"name": f"{p['name']}/{d}", "same": p["same"] | {c: _value(d, rows.schema[c].dataType.typeName())}} for p, d in below]
        return found

    def _part(self, rows: DataFrame, same: dict | None = None) -> dict:
        name = f"parts/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return {"name": name, "same": same or {}}

    def _rows(self, parts: list[dict]) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/{p['name']}" for p in parts)) if parts else None

    def read(self, scope: dict | None = None) -> DataFrame | None:
        """All rows, or those in a scope of columns' values, of the parts that may have them alone. None: nothing was ever stored."""
        parts = self._list()[1]
        if scope is None or not parts:
            return self._rows(parts)
        return self._rows(self._apart(parts, scope)[1] or parts[:1]).filter(scope_column(scope))

    def append(self, rows: DataFrame, same: dict | None = None) -> int:
        """Blind: a rerun adds the rows again. The number of rows, counted as they are written. same: values that all rows have."""
        seen = Observation()
        n, parts = self._list()
        part = self._part(rows.observe(seen, F.count(F.lit(1)).alias("n")), same)
        self._switch(n + 1, [*parts, part])
        return seen.get["n"]

    def append_new(self, rows: DataFrame, keys: list[str]) -> dict[str, int]:
        """Rows whose keys are whole and not stored yet; repeats among the new rows stay. Returns how many rows there were, how many
        dropped for missing keys, already stored, new: counted by the plan that writes, in one pass over the rows."""
        seen = Observation()
        n, parts = self._list()
        new = _counted(rows, self._rows(parts), keys, seen)
        self._switch(n + 1, [*parts, self._part(new)])
        return seen.get

    def _apart(self, parts: list[dict], scope: dict) -> tuple[list[dict], list[dict]]:
        """Parts that can't have a row in a scope, and the others."""
        other = [p for p in parts if any(c in p["same"] and not _among(p["same"][c], v) for c, v in scope.items())]
        return other, [p for p in parts if p not in other]

    def replace_scope(self, rows: DataFrame, scope: Column | dict, by: list[str] | None = None) -> None:
        """Stored rows in scope go, rows come; an empty result empties the scope. A scope of columns' values (one, a list, or a
        Bounds) only rewrites the parts that may have them, and of these not those that have them in all rows. by: columns of few
        values; rows come as a part for each combination, so that later scopes leave most of them alone."""
        n, parts = self._list()
        kept, touched = self._apart(parts, scope) if isinstance(scope, dict) else ([], parts)
        same = {c: v for c, v in scope.items() if not isinstance(v, (list, Bounds))} if isinstance(scope, dict) else {}
        if isinstance(scope, dict):
            touched = [p for p in touched if not scope.keys() <= p["same"].keys()]
            scope = scope_column(scope)
        new = [self._part(self._rows([p]).filter(~F.coalesce(scope, F.lit(False))), p["same"]) for p in touched]
        come = self._parts_by(rows, by) if by else [self._part(rows, same)]
        if not (kept or new or come):  # a table without rows has columns still
            come = [self._part(rows)]
        self._switch(n + 1, [*kept, *new, *come])

    def upsert(self, rows: DataFrame, keys: list[str], update: dict[str, Callable[[Column, Column], Column]], same: dict | None = None) -> None:
        """Rows of new keys come whole. Of stored keys the columns in update become what it makes of old and new value. same:
        values of key columns that all rows have; parts of other values stay."""
        n, parts = self._list()
        kept, touched = self._apart(parts, {c: v for c, v in (same or {}).items() if c in keys})
        old = self._rows(touched)
        if old is None:
            return self._switch(n + 1, [*kept, self._part(rows, same)])
        new = rows.select(*keys, F.struct(*rows.columns).alias("_new"))
        both = old.select(*keys, F.struct(*old.columns).alias("_old")).join(new, keys, "full")

        def value(c: str) -> Column:
            if c in keys:
                return F.col(c)
            then, now = F.col("_old")[c], F.col("_new")[c] if c in rows.columns else F.lit(None)
            changed = update[c](then, now) if c in update else then
            return F.when(F.col("_old").isNull(), now).when(F.col("_new").isNull(), then).otherwise(changed).alias(c)

        one = same if all(p["same"] == (same or {}) for p in touched) else None
        return self._switch(n + 1, [*kept, self._part(both.select(*map(value, old.columns)), one)])

    def clean(self) -> None:
        """Delete parts and lists that the newest version doesn't need; no reader may be at older ones."""
        n, parts = self._list()
        used = {p["name"].split("/")[1] for p in parts}
        for folder, fine in (("parts", used), ("lists", {f"{n:010d}.json"})):
            for name in self._names(folder):
                if name not in fine:
                    self._fs.delete(self._at(f"{self.path}/{folder}/{name}"), True)


class Bounds(NamedTuple):
    """Values from first to last; None: no bound on that side."""

    first: int | None
    last: int | None


def _value(folder: str, kind: str) -> object:
    """What a folder of a partition says."""
    text = unquote(folder.partition("=")[2])
    return None if text == "__HIVE_DEFAULT_PARTITION__" else int(text) if kind in ("byte", "short", "integer", "long") else text


def _among(value: object, of: object) -> bool:
    if isinstance(of, Bounds):
        return value is not None and (of.first is None or value >= of.first) and (of.last is None or value <= of.last)
    return value in of if isinstance(of, list) else value == of


def scope_column(scope: dict) -> Column:
    """Whether a row is in a scope of columns' values."""
    out = F.lit(True)
    for c, v in scope.items():
        if isinstance(v, Bounds):
            for bound, fits in ((v.first, F.col(c) >= F.lit(v.first)), (v.last, F.col(c) <= F.lit(v.last))):
                out = out & fits if bound is not None else out
        elif isinstance(v, list):
            out = out & F.col(c).isin(v)
        else:
            out = out & F.col(c).eqNullSafe(F.lit(v))
    return out


def newer(old: Column, new: Column) -> Column:
    return new


def newer_if_known(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


#: What a snapshot and a population row update of a stored one.
SNAPSHOT_UPDATE = {"score_risco": newer, "dec_medio": newer}
POPULATION_UPDATE = {"populacao": newer, "domicilios": newer, "area_km2": newer_if_known}


def write_layers(layers: dict[str, DataFrame], write: Callable[[str, DataFrame], int]) -> dict[str, int]:
    """Write each layer: rows written, or -1 where that failed, which is logged; one layer's failure doesn't stop the others."""
    counts = {}
    for name, rows in layers.items():
        try:
            counts[name] = write(name, rows)
        except Exception:  # noqa: BLE001
            log.exception("layer %s", name)
            counts[name] = -1
    return counts


def check_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _counted(rows: DataFrame, stored: DataFrame | None, keys: list[str], seen: Observation) -> DataFrame:
    """The rows that are new; what becomes of all is counted as they pass."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    if stored is None:
        rows = rows.withColumn("_old", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(stored.select(*keys).distinct().withColumn("_old", F.lit(True)), keys, "left").select(*rows.columns, "_old")
    old = F.col("_old").isNotNull()
    counts = {"total": F.count(F.lit(1)), "dropped": F.count_if(~whole), "existing": F.count_if(whole & old), "new": F.count_if(whole & ~old)}
    return rows.observe(seen, *(c.alias(n) for n, c in counts.items())).filter(whole & ~old).drop("_old")


#: Words of 64 bits of the filter of keys that is broadcast: 2 MB with their places, however many keys there are.
FILTER_WORDS = 1 << 17


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """A table of at most FILTER_WORDS rows (_at, _bits) in which every key has three bits."""
    return keys.select(*_filter_place(key)).groupBy("_at").agg(F.bit_or("_mask").alias("_bits"))


def _filter_place(key: str) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    bit = lambda n: F.expr(f"shiftleft(1L, cast(shiftright(xxhash64(`{key}`), {n}) & 63 as int))")
    return F.pmod(F.shiftright(h, 32), F.lit(FILTER_WORDS)).alias("_at"), bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12)).alias("_mask")


def stored_elsewhere(rows: DataFrame, stored: DataFrame | None, key: str, scope: dict) -> DataFrame:
    """Keys of rows that a stored row outside of a scope has too. The stored table is read once, its key and the scope's columns
    alone, and not shuffled: a broadcast filter of the new keys, of a fixed size, leaves what may be equal, which is then joined."""
    new = rows.filter(F.col(key).isNotNull()).select(F.col(key)).distinct()
    if stored is None:
        return new.limit(0)
    at, mask = _filter_place(key)
    other = stored.filter(~F.coalesce(scope_column(scope), F.lit(False))).select(F.col(key), at, mask)
    maybe = other.join(F.broadcast(key_filter(new, key)), "_at").filter(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
    return new.join(maybe.select(key), key, "left_semi")


def to_features(rows: DataFrame, geometry: str = "geom", kind: str = "LineString") -> DataFrame:
    """One GeoJSON feature a row (column feature); a null geometry stays null."""
    pair = lambda p: F.array(p["lon"], p["lat"])
    nest = {"Point": pair, "LineString": lambda g: F.transform(g, pair), "MultiLineString": lambda g: F.transform(g, lambda line: F.transform(line, pair)), "MultiPolygon": lambda g: F.transform(g, lambda p: F.transform(p, lambda r: F.transform(r, pair)))}
    g = F.when(F.col(geometry).isNotNull(), F.struct(F.lit(kind).alias("type"), nest[kind](F.col(geometry)).alias("coordinates")))
    rest = [c for c in rows.columns if c != geometry]
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), g.alias("geometry"), F.struct(*rest).alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def write_feature_collection(rows: DataFrame, path: str, geometry: str = "geom", kind: str = "LineString") -> None:
    """A folder of features, one a line."""
    to_features(rows, geometry, kind).write.text(path)
