"""Building a corpus: exclusions, quotas, lookups, file choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.session import cut

#: Preference of figure files by extension, best first (fixed values).
EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".gif")


def search(documents: DataFrame, licences: list[str], phrase: str | None, fields: list[str], n: int, rank: str) -> DataFrame:
    """The first n documents by rank with one of the licences and, if given, the phrase in one of the fields."""
    hits = documents.where(F.col("licence").isin(*licences))
    if phrase:
        found = F.lit(False)
        for f in fields:
            found = found | F.coalesce(F.contains(F.lower(F.col(f)), F.lit(phrase.lower())), F.lit(False))
        hits = hits.where(found)
    return hits.orderBy(rank).limit(n)


def quotas(candidates: DataFrame, targets: list[tuple[str, int]], key: str, bucket: str, rank: str, excluded: DataFrame | None = None) -> DataFrame:
    """The first `target` candidates of each bucket in turn; only kept ids are closed to later buckets.

    One pass a bucket, as many as there are targets: an id beyond the quota of one bucket may still be kept by the next.
    """
    open_rows = candidates.where(F.coalesce(F.col("tables_in_body"), F.lit(0)) > 0) if "tables_in_body" in candidates.columns else candidates
    if excluded is not None:
        open_rows = open_rows.join(excluded.select(key).distinct(), key, "left_anti")
    kept: DataFrame | None = None
    for name, target in targets:
        mine = open_rows.where(F.col(bucket) == name)
        if kept is not None:
            mine = mine.join(kept.select(key), key, "left_anti")
        once = mine.withColumn("_again", F.row_number().over(Window.partitionBy(key).orderBy(rank))).where("_again = 1").drop("_again")
        took = once.orderBy(rank, key).limit(target)
        kept = cut(took if kept is None else kept.union(took))  # at most the targets' rows; without it each plan would hold all earlier ones
    return kept if kept is not None else candidates.limit(0)


def resolve(ids: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """ids with the value a lookup table has for them; ids it doesn't know are left out."""
    return ids.join(lookup.select(key, value).distinct(), key)


def latest_version(keys: DataFrame, name: str = "pmcid", path: str = "key") -> DataFrame:
    """The files of each id's greatest version: keys of the form `<id>.<version>/...`; other keys are left out."""
    versioned = keys.withColumn("version", tx.version_of(F.col(path), F.col(name))).where("version is not null")
    newest = versioned.groupBy(name).agg(F.max("version").alias("version"))
    return versioned.join(newest, [name, "version"])


def best_file(wanted: DataFrame, files: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """For each wanted file name the listed file with the same stem and the best extension; unknown extensions last, then listing order."""
    place = F.array_position(F.array(*[F.lit(e) for e in EXTENSIONS]), tx.extension(F.col("key")))
    listed = files.withColumn("_stem", tx.stem(F.col("key"))).withColumn("_place", F.when(place == 0, len(EXTENSIONS) + 1).otherwise(place))
    joined = wanted.withColumn("_stem", tx.stem(F.col("graphic"))).join(listed, [*by, "_stem"])
    top = Window.partitionBy(*by, "graphic").orderBy("_place", ordinal)
    return joined.withColumn("_n", F.row_number().over(top)).where("_n = 1").drop("_n", "_place", "_stem")
