"""Queries that must read the whole table."""

from tallyspark import catalog

from .compare import SF_DIR, tables


def test_all_orders_are_reconciled(spark):
    want = tables().sql("SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)").fetchall()[0][0]
    assert catalog.QUERIES["cell_reconciliation_all"](spark, SF_DIR).count() == want


def test_every_user_has_up_to_thirty_days(spark):
    want = tables().sql("SELECT SUM(least(n, 30)) FROM (SELECT COUNT(DISTINCT CAST(ts AS DATE)) AS n FROM events GROUP BY user_id)").fetchall()[0][0]
    assert catalog.QUERIES["quality_trend_each"](spark, SF_DIR).count() == want


def test_the_heatmap_shows_the_latest_value_of_all_users(spark):
    want = tables().sql("SELECT event_type, arg_max(value, (ts, event_id)) FROM events WHERE strftime(ts, '%Y%m%d') = '20240105' GROUP BY 1").fetchall()
    got = catalog.QUERIES["category_heatmap_all"](spark, SF_DIR).where("d20240105 is not null").collect()
    assert {r.event_type: float(r.d20240105) for r in got} == {k: float(v) for k, v in want}


def test_all_lines_are_decomposed(spark):
    want = tables().sql("SELECT 2 * COUNT(*) FROM lineitem WHERE l_partkey % 10 <> 0").fetchall()[0][0]
    assert catalog.QUERIES["fact_decomposition_all"](spark, SF_DIR).count() == want
