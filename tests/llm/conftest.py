import os

import duckdb
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, columns with the operators' own names."""
    long = "\n".join(f"line {i} of a very long text that says the same again and again" for i in range(3000))
    some = [(1, None, "s"), (2, "", None), (None, "a b c d e f g", "s"), (None, None, None), (3, " \n\t", "s"), (4, long, "s"), (4, long, "s"), (5, "a b c d e f g", "t"), (5, "another text of this id", "t"), (6, "one", None), (6, "one", None), (7, "\u00a0ÀÉ日本語 \U0001f600 x", "u")]
    df = spark.createDataFrame(some, "doc_id long, text string, source string")
    names = ("quality", "bpe", "score", "block", "id", "mark", "node", "n", "rank", "size", "gone", "seq", "held_out", "target", "at")
    return df.withColumns({c: F.lit(c) for c in names} | {"n_chars": F.length("text"), "_quality": F.lit(1), "_dedup_id": F.lit(1), "_gone": F.lit(1)})


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        at = f"{sf_dir}/{name}"
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    return con


def same(found, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r) for r in found.select(*want.columns).collect()), key=key) == sorted((tuple(r) for r in want.fetchall()), key=key)
