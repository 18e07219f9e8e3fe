"""A sample whose category shares follow given targets in several attributes at once.

1. Iterative proportional fitting ("raking") gives every cell, a combination of categories, the weight with which its
   rows are wanted. What a category lacks of rows is spread over the other categories of its attribute first, so that
   a target that can't be met doesn't shrink the sample or the other attributes.
2. A row's key is an exponential variate divided by its cell's weight; the rows with the least keys are drawn. How many
   a cell gives is its weight times its rows, rounded by largest remainder. They are found without sorting a cell: rows
   are counted in BUCKETS buckets, which tells the one where the cell's number is reached, and only that one is ranked.
3. The drawn rows are counted, and categories under their minimum get the next keys of their cells.
4. The report counts the sample and says what is missing.

A cell with a third of all rows is spread over as many tasks as any other. The cells' numbers are fitted on the driver if
there are few, else as a table; the rules are the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import hash_uniform, materialize

#: Most target rows (a small table given by the caller), and most cells that are fitted on the driver.
MOST_TARGETS, DRIVER_CELLS = 10_000, 200_000
#: Rounds of fitting, and the change of all margins, in rows, at which it ends.
ROUNDS, STILL = 500, 1e-3
BUCKETS = 4096


def spelling(value: Column) -> Column:
    """The key of a category: spellings that differ in letter case, outer or repeated spaces, or hyphens for spaces have the same."""
    return F.lower(F.regexp_replace(F.regexp_replace(value, r"[\s -]+", " "), r"^ +| +$", ""))


class Targets:
    """Targets (attribute, category, target_share, min_rows) on the driver. Nulls in attribute or category are left out."""

    def __init__(self, targets: DataFrame) -> None:
        rows = targets.select("attribute", "category", "target_share", "min_rows", spelling(F.col("category")).alias("key")).limit(MOST_TARGETS + 1).collect()
        if len(rows) > MOST_TARGETS:
            raise ValueError(f"more than {MOST_TARGETS} targets")
        self.rows = [r for r in rows if r.attribute is not None and r.category is not None]
        self.attributes = sorted({r.attribute for r in self.rows})
        self.index = {a: {k: i for i, k in enumerate(sorted({r.key for r in self.rows if r.attribute == a}))} for a in self.attributes}
        self.share = {a: np.zeros(len(self.index[a])) for a in self.attributes}
        self.least = {a: np.zeros(len(self.index[a]), int) for a in self.attributes}
        for r in self.rows:
            i = self.index[r.attribute][r.key]
            self.share[r.attribute][i] = max(self.share[r.attribute][i], r.target_share or 0.0)
            self.least[r.attribute][i] = max(self.least[r.attribute][i], r.min_rows or 0)

    def code(self, attribute: str, column: Column) -> Column:
        """The number of the column's category, -1 for null and for what no target names."""
        pairs = [F.lit(x) for kv in self.index[attribute].items() for x in kv]
        return F.coalesce(F.create_map(*pairs)[spelling(column)], F.lit(-1))


class DriverCells:
    """Cells as arrays: category numbers, rows, rows wanted."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray) -> None:
        self.codes, self.rows = codes, rows.astype(float)
        self.ok = (codes >= 0).all(1) if len(codes) else np.zeros(0, bool)
        self.want = np.where(self.ok, self.rows, 0.0)

    def margin(self, a: int, n: int, what: str = "want") -> np.ndarray:
        use = self.codes[:, a] >= 0 if what == "all" else self.ok
        return np.bincount(self.codes[use, a], (self.want if what == "want" else self.rows)[use], n).astype(float)

    def total(self, free: bool = False) -> float:
        return float(self.want[self.want < self.rows].sum() if free else self.want.sum())

    def scale(self, a: int | None, factor: np.ndarray) -> None:
        by = factor[self.codes[self.ok, a]] if a is not None else factor[0]
        self.want[self.ok] = np.minimum(self.want[self.ok] * by, self.rows[self.ok])

    def quotas(self, size: int) -> None:
        take = np.floor(self.want + 1e-9)
        order = np.lexsort((*self.codes.T, take - self.want))
        order = order[(take < self.rows)[order] & self.ok[order]][: max(0, size - int(take.sum()))]
        take[order] += 1
        self.take = take.astype(int)

    def add(self, a: int, k: int, lack: int) -> None:
        """The cells of a category with the most rows left give more, as many as are lacking."""
        mine = np.flatnonzero(self.codes[:, a] == k)
        mine = mine[np.lexsort((*self.codes[mine].T, self.take[mine] - self.rows[mine]))]
        room = self.rows[mine].astype(int) - self.take[mine]
        before = np.cumsum(room) - room
        self.take[mine] += np.clip(lack - before, 0, room)

    def table(self, names: list[str], spark) -> DataFrame:
        rows = [(*map(int, c), int(t), float(w / n)) for c, t, w, n in zip(self.codes, self.take, self.want, self.rows, strict=True) if t > 0]
        made = spark.createDataFrame(rows or [(*[-2] * len(names), 0, 0.0)], ", ".join(f"{n} int" for n in names) + ", take long, weight double")
        return F.broadcast(made)  # one row a cell, at most DRIVER_CELLS


class TableCells:
    """The same with the cells as a table; only margins, one number a category, reach the driver."""

    def __init__(self, cells: DataFrame, names: list[str]) -> None:
        self.names = names
        ok = " and ".join(f"{n} >= 0" for n in names)
        self.cells = materialize(cells.withColumn("ok", F.expr(ok)).withColumn("want", F.expr(f"if({ok}, double(n), 0D)")))

    def margin(self, a: int, n: int, what: str = "want") -> np.ndarray:
        use = self.cells.where(f"{self.names[a]} >= 0" if what == "all" else "ok")
        out = np.zeros(n)
        for r in use.groupBy(F.col(self.names[a]).alias("k")).agg(F.sum("want" if what == "want" else "n").alias("x")).collect():  # one row a category of the targets
            out[r.k] = r.x
        return out

    def total(self, free: bool = False) -> float:
        return float(self.cells.where("want < n" if free else "true").agg(F.sum("want")).first()[0] or 0.0)

    def scale(self, a: int | None, factor: np.ndarray) -> None:
        by = F.element_at(F.array(*[F.lit(float(x)) for x in factor]), F.col(self.names[a]) + 1) if a is not None else F.lit(float(factor[0]))
        self.cells = materialize(self.cells.withColumn("want", F.when(F.col("ok"), F.least(F.col("want") * by, F.col("n").cast("double"))).otherwise(F.col("want"))))

    def quotas(self, size: int) -> None:
        floor = self.cells.withColumn("take", F.floor(F.col("want") + 1e-9))
        spare = max(0, size - int(floor.agg(F.sum("take")).first()[0] or 0))
        more = floor.where("ok and take < n").orderBy(F.col("take") - F.col("want"), *self.names[::-1]).limit(spare).select(*self.names, F.lit(1).alias("more"))
        self.cells = materialize(floor.join(more, self.names, "left").withColumn("take", F.col("take") + F.coalesce("more", F.lit(0))).drop("more"))

    def add(self, a: int, k: int, lack: int) -> None:
        mine = self.cells.where(F.col(self.names[a]) == k).withColumn("room", F.col("n") - F.col("take"))
        upto = F.sum("room").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("room"), *self.names[::-1]).rowsBetween(Window.unboundedPreceding, 0))
        more = mine.withColumn("upto", upto).select(*self.names, F.greatest(F.lit(0), F.least(F.lit(lack) - F.col("upto") + F.col("room"), F.col("room"))).alias("more"))
        self.cells = materialize(self.cells.join(more, self.names, "left").withColumn("take", F.col("take") + F.coalesce("more", F.lit(0))).drop("more"))

    def table(self, names: list[str], spark) -> DataFrame:
        return self.cells.where("take > 0").select(*names, F.col("take").cast("long").alias("take"), (F.col("want") / F.col("n")).alias("weight"))


def feasible(share: np.ndarray, rows: np.ndarray, size: float) -> np.ndarray:
    """Rows wanted of each category of an attribute: share * size, with what some categories lack spread over the others by their shares."""
    want = np.minimum(share * size, rows)
    for _ in range(len(share)):
        left, free = share.sum() * size - want.sum(), want < rows
        if left <= 1e-9 * size or not share[free].sum():
            break
        want = np.where(free, np.minimum(want + left * share / share[free].sum(), rows), want)
    return want


def rake(cells: DriverCells | TableCells, targets: Targets, size: float) -> None:
    """Fit the cells' wanted rows to all margins in turn, none above its rows; then to the size, as far as there are rows."""
    margins = [feasible(targets.share[x], cells.margin(a, len(targets.share[x]), "ok"), size) for a, x in enumerate(targets.attributes)]
    last = None
    for _ in range(ROUNDS):
        now = []
        for a, wanted in enumerate(margins):
            have = cells.margin(a, len(wanted))
            cells.scale(a, np.divide(wanted, have, out=np.ones_like(have), where=have > 0))
            now.append(have)
        if last is not None and max(np.abs(x - y).max(initial=0) for x, y in zip(now, last, strict=True)) < STILL:
            break
        last = now
    for _ in range(50):
        total = cells.total()
        lack, free = size - total, cells.total(free=True)
        if abs(lack) < STILL or lack > 0 and free <= 0:
            break
        cells.scale(None, np.array([1 + lack / free if lack > 0 else size / total]))


def _selected(keyed: DataFrame, quotas: DataFrame, names: list[str]) -> DataFrame:
    """(row_id, weight, cell): the rows of every cell with the least keys, as many as its quota."""
    wanted = keyed.join(quotas, names)
    # 1 - u is the chance of a greater variate: a cell's buckets are even, and in the order of its keys
    key = F.when(F.col("weight") > 0, -F.log1p(-F.col("u")) / F.col("weight")).otherwise(F.lit(float("inf")))
    placed = wanted.withColumn("key", key).withColumn("bucket", F.floor(F.col("u") * BUCKETS).cast("int"))
    counted = placed.groupBy(*names, "take", "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*names).orderBy("bucket"))
    edge = counted.withColumn("upto", upto).where((F.col("upto") >= F.col("take")) & (F.col("upto") - F.col("n") < F.col("take")))
    edge = edge.select(*names, F.col("bucket").alias("edge"), (F.col("take") - F.col("upto") + F.col("n")).alias("left"))
    placed = placed.join(edge, names)
    out = ["row_id", "weight", *names]
    sure = placed.where(F.col("bucket") < F.col("edge")).select(*out)
    last = placed.where(F.col("bucket") == F.col("edge")).withColumn("rank", F.row_number().over(Window.partitionBy(*names).orderBy("key", "u", "row_id")))
    return sure.union(last.where(F.col("rank") <= F.col("left")).select(*out))


def _counted(rows: DataFrame, names: list[str]) -> DataFrame:
    """(a, k, n): how many rows each category (number k of attribute a) has."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.col(n).alias("k")) for i, n in enumerate(names)]))
    return rows.groupBy(*names).agg(F.count("*").alias("n")).select("n", each.alias("x")).groupBy("x.a", "x.k").agg(F.sum("n").alias("n"))


def draw(records: DataFrame, targets: DataFrame, fraction: float = 0.2, seed: int = 5, key: str = "row_id", driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, DataFrame]:
    """The sample (row_id, weight) and the report (attribute, category, target_share, min_rows, available, wanted, sampled, gap, short).

    fraction: size of the sample against all rows; it is met if so many rows have a named category in every attribute.
    weight: the raked inclusion weight of the row's cell. Rows with a null category or one that no target names are drawn
    only to fill a minimum of another attribute. sampled is counted from the sample. short: the sample has less than
    share * size, and no sample could have more, since there are fewer rows; what such a category lacks goes to the
    others of its attribute. Repeated rows count row by row. An empty table gives an empty sample and a report of zeros;
    no targets give an empty sample and report.
    """
    spark = records.sparkSession
    t = Targets(targets)
    report_schema = "attribute string, category string, target_share double, min_rows bigint, available bigint, wanted double, sampled bigint, gap double, short boolean"
    names = [f"c{i}" for i in range(len(t.attributes))]
    coded = records.select(F.col(key).alias("row_id"), *[t.code(a, records[a]).cast("int").alias(n) for a, n in zip(t.attributes, names, strict=True)])
    if not names:
        return coded.select("row_id", F.lit(1.0).alias("weight")).limit(0), spark.createDataFrame([], report_schema)
    grouped = coded.groupBy(*names).agg(F.count("*").alias("n"))
    rows = grouped.limit(driver_cells + 1).collect()
    if len(rows) <= driver_cells:
        rows = sorted(rows)
        cells = DriverCells(np.array([[r[n] for n in names] for r in rows], int).reshape(len(rows), len(names)), np.array([r["n"] for r in rows], float))
    else:
        cells = TableCells(grouped, names)
    available = [cells.margin(a, len(t.share[x]), "all") for a, x in enumerate(t.attributes)]
    total = float(records.count())
    size = total * fraction
    rake(cells, t, size)
    cells.quotas(int(round(cells.total())))
    keyed = coded.withColumn("u", hash_uniform(F.col("row_id"), seed=seed))
    sample = _selected(keyed, cells.table(names, spark), names)
    # minimums are repaired on what was drawn
    drawn = {(r.a, r.k): r.n for r in _counted(sample, names).collect()}  # one row a category of the targets
    lacking = [(a, k, min(int(least), int(available[a][k])) - drawn.get((a, k), 0)) for a, x in enumerate(t.attributes) for k, least in enumerate(t.least[x])]
    if any(lack > 0 for *_, lack in lacking):
        for a, k, lack in lacking:
            if lack > 0:
                cells.add(a, k, lack)
        sample = _selected(keyed, cells.table(names, spark), names)
    known = []
    for r in t.rows:
        a = t.attributes.index(r.attribute)
        k = t.index[r.attribute][r.key]
        share = float(r.target_share or 0.0)
        known.append((a, k, r.attribute, r.category, share, int(r.min_rows or 0), int(available[a][k]), share * size))
    base = spark.createDataFrame(known, "a int, k int, attribute string, category string, target_share double, min_rows bigint, available bigint, wanted double")
    sampled = F.coalesce("n", F.lit(0)).cast("bigint")
    short = (sampled < F.col("wanted")) & (F.col("available") < F.col("wanted"))
    report = base.join(_counted(sample, names), ["a", "k"], "left").select("attribute", "category", "target_share", "min_rows", "available", "wanted", sampled.alias("sampled"), (sampled - F.col("wanted")).alias("gap"), short.alias("short"))
    return sample.select("row_id", "weight"), report
