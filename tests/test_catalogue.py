import math

import duckdb
import pytest

from panelwright.plans.catalogue import CATALOGUE
from panelwright.plans.sql import TABLES, render

SF = "/root/testdata/sf0.001"
ORACLE = CATALOGUE.oracle_sql()
NAMES = "lagged_design asof_gap_lookup rolling_windows cumcorr_topk replay_undo_membership turnover time_underwater total_effect_paths bn_marginal path_probability common_edge_per trailing_window intervention_effect bn_sample ema_utility bh_fdr backtest_summary stationary_bootstrap shd_accuracy eligible_in_window".split()


def plain(rows):
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) + 0.0 if isinstance(v, float) else str(v)
    return sorted((tuple(clean(v) for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    got = CATALOGUE.run(name, spark, SF)
    want = duck.execute(ORACLE[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    rows = plain(got.select(*columns).collect())
    assert rows and rows == plain(tuple(r[i] for i in order) for r in want.fetchall())


def test_every_query_has_an_oracle_of_its_own():
    assert set(CATALOGUE.queries()) == set(ORACLE)


def test_macro_arguments_stand_for_themselves():
    assert render("@idiv(a + b; c - 1)", 0) == "CAST(floor((a + b) / (c - 1)) AS BIGINT)"
    assert render("@idiv(@n(x); 2)", 1) == "CAST(floor((CAST((x) AS BIGINT)) / (2)) AS BIGINT)"


def test_windows_cover_the_calendar(spark):
    from panelwright.operators.windows import panel

    n = CATALOGUE.run("every_nth_row", spark, SF).agg({"r": "max"}).first()[0] + 1
    rows = {r["w"]: (r["lo"], r["hi"]) for r in panel(spark, SF).groupBy("w").agg({"r": "min"}).withColumnRenamed("min(r)", "lo").join(panel(spark, SF).groupBy("w").agg({"r": "max"}).withColumnRenamed("max(r)", "hi"), "w").collect()}
    assert sorted(rows) == list(range(len(rows))) and len(rows) >= (n - 104) // 13 + 1
    assert all(13 * w <= lo and hi < 13 * w + 104 for w, (lo, hi) in rows.items()) and max(hi for _, hi in rows.values()) >= n - 13


def test_cpd_columns_sum_to_one(spark):
    rows = CATALOGUE.run("cpd_k2", spark, SF).groupBy("qty", "disc").sum("p").collect()
    assert all(abs(r[2] - 1) < 1e-4 for r in rows)


def test_shared_views_are_computed_once():
    assert "px" in CATALOGUE.repeated(CATALOGUE.views["panel"]) and "bn" in CATALOGUE.repeated(CATALOGUE.texts["bn_marginal"])
