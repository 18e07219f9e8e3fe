import random

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import figures, perturb

T = [["Method", "Score", "Year"], ["Alpha", "12.5 (3)", "2015"], ["Beta", "", None], ["Gamma", "40%", "7", "x"], ["Delta", "MDH1", "0.03"]]
SCHEMA = "id string, table_values array<array<string>>, claim string, table_caption string"


def rows(spark, n=60):
    rng = random.Random(3)
    out = []
    for i in range(n):
        t = [[f"row{j}", str(rng.randint(10, 99)), f"{rng.random():.2f}"] for j in range(rng.randint(1, 5))]
        out.append((str(i), t, f"Table 1 shows that row1 reached {t[0][1]} in the end", "Table 1. A caption with 55 units"))
    return spark.createDataFrame(out, SCHEMA)


def test_numeric_cells(spark):
    df = spark.createDataFrame([("a", T, "", "")], SCHEMA)
    got = [(c.i, c.j, c.raw) for c in df.select(perturb.numeric_cells(F.col("table_values")).alias("c")).first().c]
    assert got == [(1, 1, "12.5"), (1, 1, "3"), (1, 2, "2015"), (3, 1, "40"), (3, 2, "7"), (4, 2, "0.03")]


def test_perturbations_keep_their_promises(spark):
    out = perturb.perturb(rows(spark), ["id"]).collect()
    assert len(out) == 60
    for r in out:
        a, b = r.table_values, r.perturbed_table_values
        differ = [(i, j) for i in range(len(a)) for j in range(len(a[i])) if a[i][j] != b[i][j]]
        if r.operation == "Change the cell values":
            assert len(differ) == 1
        elif r.operation == "Caption adjustments":
            assert not differ and r.perturbed_caption != r.table_caption
        else:
            assert differ and all(j > 0 for _, j in differ)
        if r.operation == "Swap rows or columns":
            assert sorted(map(str, [x[1:] for x in a])) == sorted(map(str, [x[1:] for x in b]))
    assert {r.operation for r in out} == {"Change the cell values", "Caption adjustments", "Swap rows or columns", "Value scaling"}


def test_perturbation_ignores_partitioning(spark):
    key = lambda df: sorted((r.id, r.operation, str(r.perturbed_table_values)) for r in perturb.perturb(df, ["id"]).collect())
    df = rows(spark)
    assert key(df.repartition(1)) == key(df.repartition(7))


def test_redrawn(spark):
    cases = [(0.03, "0.03", "0.03"), (0.4, "0.40", "0.40"), (2015.0, "2015", "2015-2020"), (100.0, "100", "100%"), (99.8, "99.8", "99.8%"), (0.0, "0", "0"), (0.0, "0", "0%"), (1.0, "1", "1"), (-2.0, "-2", "-2 kg"), (12.5, "12.5", None)]
    df = spark.createDataFrame([(i, *c) for i in range(200) for c in cases], "id int, value double, raw string, cell string")
    new = perturb.redrawn(F.col("value"), F.col("raw"), F.coalesce("cell", "raw"), F.col("id"))
    got = df.select("value", "raw", "cell", new.alias("new")).collect()
    assert all(r.new != r.raw for r in got)
    of = lambda raw, cell: [float(r.new.strip("<")) for r in got if (r.raw, r.cell) == (raw, cell)]
    assert all(x >= 0.06 for x in of("0.03", "0.03")) and all(x < 0.05 for x in of("0.40", "0.40"))
    assert all(2000 <= x <= 2030 for x in of("2015", "2015-2020")) and len(set(of("2015", "2015-2020"))) > 20
    assert all(x < 100 for x in of("100", "100%")) and all(x <= 98.8 for x in of("99.8", "99.8%")) and all(1 <= x <= 3 for x in of("0", "0%"))
    assert all(x <= 0 for x in of("-2", "-2 kg"))


def test_row_swap_lists_no_pairs(spark):
    wide = [[f"r{i}", str(i % 97)] for i in range(3000)] + [["x", "1", "2"], ["y", "1", "2"]]
    df = spark.createDataFrame([(1, wide, "As r17 says"), (2, [["long label", "5"], ["other", "5"], ["third", "6"]], "the long label is here"), (3, [["a", "1"], ["b", "1"]], "")], "id int, t array<array<string>>, claim string")
    got = {r.id: r.s for r in df.select("id", perturb.row_swap(F.col("t"), F.col("claim"), F.col("id")).alias("s")).collect()}
    assert wide[got[1].i][1] != wide[got[1].j][1] and not got[1].grounded
    assert (got[2].i, got[2].j, got[2].grounded) == (0, 2, True) and got[3] is None


def test_panels():
    page = np.full((100, 200), 255.0)
    for y in (5, 55):
        for x in (10, 110):
            page[y : y + 40, x : x + 80] = 0
    assert len(figures.detect_panels(page)) == 4
    assert figures.detect_panels(np.full((50, 50), 255.0)) == [(0, 0, 50, 50)]
    page[5:95, 10:190] = 0
    assert len(figures.detect_panels(page)) == 1


def test_swap_figures(spark):
    page = np.full((100, 200, 3), 255, np.uint8)
    page[5:45, 10:90] = 10
    page[5:45, 110:190] = 90
    page[55:95, 10:90] = 30
    page[55:95, 110:190] = 60
    blank = np.full((20, 20, 3), 255, np.uint8)
    boxes = [("north", 0.9, 0.0, 0.0, 5.0, 4.0, 5.0, 4.0, 2.5, 2.0), ("south", 0.9, 8.0, 0.0, 13.0, 4.0, 5.0, 4.0, 10.5, 2.0), ("dim", 0.1, 0.0, 8.0, 5.0, 12.0, 5.0, 4.0, 2.5, 10.0)]
    schema = "image_id string, height int, width int, channels int, data binary, boxes array<struct<text:string,conf:double,x0:double,y0:double,x1:double,y1:double,w:double,h:double,cx:double,cy:double>>"
    df = spark.createDataFrame([("a", 100, 200, 3, page.tobytes(), None), ("b", 20, 20, 3, blank.tobytes(), boxes), ("c", 20, 20, 3, blank.tobytes(), None)], schema)
    got = {r.image_id: r for r in figures.swap_figures(df).collect()}
    assert got["a"].operation == "Graph Swap" and got["b"].operation == "Category Swap" and got["c"].operation is None
    after = np.frombuffer(got["a"].data, np.uint8)
    assert (after != page.ravel()).any() and sorted(np.unique(after)) == [10, 30, 60, 90, 255]
    images = df.select("image_id")
    assert images.count() == 3


def test_wrapping():
    assert figures.wrapped("aa bb cccccc d", 4) == ["aa", "bb", "cccc", "cc d"] and figures.wrapped("aa bb", 5) == ["aa bb"]
    assert figures.wrapped("", 4) == [""]
