import numpy as np
from pyspark.sql import functions as F

from factloom.llm import raking

TARGETS = "attribute string, category string, target_share double, min_rows bigint"


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), TARGETS)


def test_shares_follow_targets(gold, spark):
    rng = np.random.default_rng(1)
    rows = [{"domain": ["a", "b"][int(x < 0.8)], "operation": ["u", "v", "w"][int(y * 3)]} for x, y in rng.random((4000, 2))]
    t = targets(spark, ("domain", "a", 0.5, 1), ("domain", "b", 0.5, 1), ("operation", "u", 0.2, 1), ("operation", "v", 0.3, 1), ("operation", "w", 0.5, 1))
    df = gold(*rows)
    sample, report = raking.draw(df, t)
    drawn = sample.join(df, "row_id").groupBy().agg(F.count("*").alias("n"), F.avg((F.col("domain") == "a").cast("int")).alias("a"), F.avg((F.col("operation") == "w").cast("int")).alias("w")).first()
    assert drawn.n == 800 and abs(drawn.a - 0.5) < 0.003 and abs(drawn.w - 0.5) < 0.003
    assert not any(r.short for r in report.collect())
    assert {(r.attribute, r.category): r.sampled for r in report.collect()}[("domain", "a")] == sample.join(df.where("domain = 'a'"), "row_id").count()
    assert {r.row_id for r in sample.collect()} == {r.row_id for r in raking.draw(df.repartition(5), t)[0].collect()}


def test_short_categories_and_minimums(gold, spark):
    rows = [{"domain": " Graph-Swap "}] * 3 + [{"domain": "GRAPH  SWAP"}] * 2 + [{"domain": "other"}] * 200 + [{"domain": None}, {"domain": "unknown"}]
    t = targets(spark, ("domain", "Graph Swap", 0.5, 4), ("domain", "other", 0.5, 2), ("domain", "never", 0.0, 3), (None, "x", 0.1, 1), ("domain", None, 0.1, 1))
    sample, report = raking.draw(gold(*rows), t)
    got = {r.category: r for r in report.collect()}
    assert got["Graph Swap"].available == 5 and got["Graph Swap"].sampled == 5 and got["Graph Swap"].short and got["Graph Swap"].sampled >= 4
    assert not got["other"].short and got["never"].available == 0 and got["never"].sampled == 0 and got["never"].gap == 0
    assert sample.select("row_id").distinct().count() == sample.count()


def test_empty(gold, spark):
    t = targets(spark, ("domain", "a", 1.0, 1))
    sample, report = raking.draw(gold({"domain": "a"}).limit(0), t)
    assert sample.count() == 0 and [(r.available, r.sampled) for r in report.collect()] == [(0, 0)]
    sample, report = raking.draw(gold({"domain": "a"}), t.limit(0))
    assert sample.count() == 0 and report.count() == 0


def test_extra_columns(gold, spark):
    df = gold(*[{"domain": "a"}] * 50).select("*", *[F.lit(0.5).alias(c) for c in ("rate", "key", "c0", "drawn", "a", "c")])
    sample, _ = raking.draw(df, targets(spark, ("domain", "a", 1.0, 20)))
    assert sample.count() >= 20


def test_hot_cell_and_repeated_rows(spark, gold):
    df = gold(*[{"domain": "a"}] * 3000, *[{"domain": "b"}] * 10)
    t = targets(spark, ("domain", "a", 0.9, 1), ("domain", "b", 0.1, 1))
    sample, _ = raking.draw(df.union(df), t, fraction=0.01)
    got = sample.join(df, "row_id").groupBy("domain").count().collect()
    assert {r.domain: r["count"] for r in got} == {"a": 54, "b": 6}


class T:
    attributes = ["p", "q"]
    share = {"p": np.array([0.9, 0.1]), "q": np.array([0.5, 0.5])}


def test_wanted_rows_are_possible():
    cells = raking.DriverCells(np.array([[0, 0], [0, 1], [1, 0], [1, 1], [-1, 0]]), np.array([5.0, 5.0, 100.0, 100.0, 50.0]))
    raking.rake(cells, T, 40)
    assert (cells.want <= cells.rows + 1e-9).all() and cells.want[4] == 0 and (cells.want[:2] > 4.95).all() and abs(cells.want.sum() - 40) < 0.01


def test_what_a_category_lacks_goes_to_the_others():
    assert np.allclose(raking.feasible(np.array([0.5, 0.3, 0.2]), np.array([10.0, 1000.0, 1000.0]), 100), [10, 54, 36])
    assert np.allclose(raking.feasible(np.array([0.5, 0.5]), np.array([3.0, 4.0]), 100), [3, 4])


def test_size_is_kept_and_keys_are_weighted(gold, spark):
    rng = np.random.default_rng(2)
    rows = [{"domain": "abc"[int(x * 3)], "operation": "uv"[int(y < 0.9)]} for x, y in rng.random((3000, 2))] + [{"domain": "rare", "operation": "u"}] * 5
    t = targets(spark, ("domain", "a", 0.3, 1), ("domain", "b", 0.2, 1), ("domain", "c", 0.1, 1), ("domain", "rare", 0.2, 4), ("domain", "none", 0.2, 0), ("operation", "u", 0.5, 1), ("operation", "v", 0.5, 1))
    df = gold(*rows)
    sample, report = raking.draw(df, t, fraction=0.1)
    got = {r.category: r for r in report.collect()}
    n = sample.count()
    assert abs(n - 300.5) <= 1 and got["rare"].sampled == 5 and got["rare"].short and got["none"].short
    assert abs(got["u"].sampled - got["u"].wanted) <= 0.01 * 150 + 1 and not got["a"].short and abs(got["a"].sampled - (n - 5) / 2) <= 3
    counted = sample.join(df, "row_id").groupBy("domain").count().collect()
    assert {r.domain: r["count"] for r in counted} == {c: got[c].sampled for c in ("a", "b", "c", "rare")}


def test_cells_as_a_table_give_the_same(gold, spark):
    rng = np.random.default_rng(4)
    rows = [{"domain": "abcd"[int(x * 4)], "operation": "uvw"[int(y * y * 3)]} for x, y in rng.random((600, 2))]
    t = targets(spark, ("domain", "a", 0.4, 30), ("domain", "b", 0.3, 1), ("domain", "c", 0.2, 1), ("domain", "d", 0.1, 15), ("operation", "u", 0.4, 1), ("operation", "v", 0.3, 1), ("operation", "w", 0.3, 1))
    df = gold(*rows)
    one, two = raking.draw(df, t), raking.draw(df, t, driver_cells=3)
    assert sorted(map(tuple, one[1].collect())) == sorted(map(tuple, two[1].collect()))
    assert {r.row_id for r in one[0].collect()} == {r.row_id for r in two[0].collect()}
