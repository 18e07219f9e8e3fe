"""A Spark session with the settings this engine is written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive plans, UTC, Arrow. The cluster's own settings win unless given here."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset on a local master (tests) one of our own."""
    import os
    import tempfile

    set_by = spark.conf.get("spark.checkpoint.dir", None)
    if set_by:
        return set_by
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "factloom-checkpoints")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written once into the shared folder and read back: its lineage ends here, and it survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session: they may not share the driver's path."""
    import hashlib
    import io
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_factloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(str(p.relative_to(root.parent)), p.read_bytes())
    name = f"factloom-{hashlib.sha256(content.getvalue()).hexdigest()[:12]}.zip"
    folder = tempfile.mkdtemp(prefix="factloom-")  # on the driver only; Spark sends the file to the executors
    path = os.path.join(folder, name)
    Path(path).write_bytes(content.getvalue())
    sc.addPyFile(path)
    sc._factloom_shipped = True
