from datetime import date

import pytest
from pyspark.sql import functions as F

from voltgrain.functions import columns as C
from voltgrain.operators import risk


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_numbers(spark):
    rows = [("12,5",), (" 7 ",), ("",), ("n/d",), ("...",), (None,)]
    assert [r[0] for r in values(spark, rows, "x string", C.comma_decimal("x"))] == [12.5, 7.0, None, None, None, None]
    assert values(spark, [("202311",), ("x",)], "x string", C.year_of("x"), C.month_of("x")) == [(2023, 11), (None, None)]


def test_names(spark):
    assert values(spark, [("Maceio\u0301",)], "x string", C.fold_key("x")) == [("maceio",)]
    assert values(spark, [(2e10,), (1.2345e12,), (None,)], "x double", C.half_up("x", 2)) == [(2e10,), (1.2345e12,), (None,)]
    rows = [("olho d'água das SÃO-JOÃO",), ("MACEIÓ",), (None,)]
    assert values(spark, rows, "x string", C.title_case("x"), C.fold_key("x")) == [("Olho D'Água Das São-João", "olho d'agua das sao-joao"), ("Maceió", "maceio"), (None, None)]


@pytest.mark.parametrize("since, as_of, years", [(date(2024, 2, 29), date(2025, 2, 28), 0), (date(2000, 5, 1), date(2020, 5, 1), 20), (date(2000, 5, 2), date(2020, 5, 1), 19), (None, date(2020, 1, 1), None)])
def test_age(spark, since, as_of, years):
    assert values(spark, [(since, as_of)], "a date, b date", C.completed_years("a", "b")) == [(years,)]


def test_status_and_life(spark):
    rows = [(20,), (21,), (25,), (26,), (31,), (None,)]
    assert values(spark, rows, "x int", C.equipment_status("x"), C.remaining_life("x")) == [("ok", 10), ("atencao", 9), ("atencao", 5), ("critico", 4), ("critico", 0), ("ok", 0)]


def test_bands_trend_shares(spark):
    assert [r[0] for r in values(spark, [(80.0,), (60.0,), (40.0,), (39.9,), (None,)], "x double", C.risk_band("x"))] == ["critico", "alto", "medio", "baixo", None]
    assert [r[0] for r in values(spark, [(12.1, 10.0), (12.0, 10.0), (7.9, 10.0), (5.0, None)], "a double, b double", C.trend_label("a", "b"))] == ["piorando", "estavel", "melhorando", "estavel"]
    assert values(spark, [(2.5, 10.0), (11.0, 10.0), (1.0, 0.0)], "a double, b double", C.coverage_pct("a", "b")) == [(75,), (0,), (None,)]
    assert values(spark, [(2.345,), (2.335,), (-2.345,)], "a double", C.half_up("a", 2)) == [(2.35,), (2.34,), (-2.35,)]
    assert values(spark, [(101, 2.0), (5, 0.0)], "a int, b double", C.density("a", "b"), C.households("a")) == [(51, 35), (None, 1)]


INDICATORS = "municipio string, distribuidora string, uf string, ano int, mes int, dec_apurado decimal(10,2), dec_limite decimal(10,2), fec_apurado decimal(10,2), fec_limite decimal(10,2)"


def score(spark, months, installed=None):
    from decimal import Decimal

    d = lambda x: None if x is None else Decimal(x)
    rows = [("A", "U", "AL", 2023, m, d(dec), d(limit), d(1), d(2)) for m, (dec, limit) in enumerate(months, 1)]
    network = spark.createDataFrame([("A", "U", x) for x in installed or []], "municipio string, distribuidora string, data_implant date")
    return risk.risk_score(spark.createDataFrame(rows, INDICATORS), network, F.lit(date(2024, 1, 1))).first()


def test_score_rules(spark):
    assert score(spark, [(None, 10)] * 3)["ratio_dec"] == 3.0  # nothing measured against a limit
    assert score(spark, [(5, None)] * 3)["ratio_dec"] == 0.0
    assert score(spark, [(5, 0)] * 3)["ratio_dec"] == 0.0
    assert score(spark, [(10, 10)])["idade_media_anos"] == 20.0  # no network
    worst = score(spark, [(90, 10)] * 12, [date(1950, 1, 1)])
    assert worst["score_risco"] == 100.0 and worst["meses_violacao"] == 12


@pytest.mark.parametrize("ratio, over, age, low, high", [(2.6, 12, 35, 75, 95), (1.7, 9, 30, 55, 74), (1.1, 6, 22, 35, 54), (0.6, 0, 8, 10, 34)])
def test_profile_ranges(spark, ratio, over, age, low, high):
    months = [(max(10.01, 10 * ratio) if i < over else min(10.0, 10 * ratio * 12 - 10.01 * over) if over else 10 * ratio, 10) for i in range(12)]
    found = score(spark, [(round(a, 2), b) for a, b in months], [date(2024 - age, 1, 1)])
    assert low <= found["score_risco"] <= high


def test_trend_needs_four(spark):
    for n, label in ((3, "estavel"), (4, "piorando"), (6, "piorando")):
        rows = [("A", "U", 2023, m, 10.0 * m, 1.0) for m in range(1, n + 1)]
        found = risk.trend(spark.createDataFrame(rows, "municipio string, distribuidora string, ano int, mes int, score_risco double, dec_medio double")).first()
        assert found["tendencia"] == label


def test_trend_of_rounded_means(spark):
    """Means that differ by 2: the label is that of the four digits shown, not of what lies behind them."""
    cases = ((0.03, 2.04), (6.03, 0.03), (2.01, 8.01), (8.04, 2.04))  # sums of the three months before, and of the last three
    rows = [(f"A{i}", "U", 2023, m, (before if m == 1 else last if m == 4 else 0.0), 1.0) for i, (before, last) in enumerate(cases) for m in range(1, 7)]
    for r in risk.trend(spark.createDataFrame(rows, "municipio string, distribuidora string, ano int, mes int, score_risco double, dec_medio double")).collect():
        a, b = r["media_recente"], r["media_anterior"]
        assert r["tendencia"] == ("piorando" if a > b + 2 else "melhorando" if a < b - 2 else "estavel")
