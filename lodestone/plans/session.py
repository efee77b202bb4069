"""Session builder and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodestone", cpus: int | None = None, **conf: str) -> SparkSession:
    """Local session for tests and the bench; on a cluster the caller brings its own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only where neither is set (tests on one machine) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(at)
    return at


def materialize(df: DataFrame, what: str = "stage") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    The result has no lineage and survives the loss of executors.  The folder is removed when the
    driver's Python ends, as the returned frame may be read until then.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/lodestone/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _forget_at_exit(spark, at)
    return spark.read.schema(df.schema).parquet(at)


def materialize_by(df: DataFrame, what: str, parts: int, key: str, dealt: bool = False) -> DataFrame:
    """As :func:`materialize`, in ``parts`` buckets by the hash of ``key``, so that joins and groups by it move nothing.

    ``dealt``: ``df`` is in such partitions already.
    """
    spark = df.sparkSession
    name = f"{what}_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/lodestone/{name}"
    # the bucketing is in the catalog only; files there outlive the table
    (df if dealt else df.repartition(parts, key)).write.bucketBy(parts, key).option("path", at).saveAsTable(name)
    _forget_at_exit(spark, at)
    return spark.table(name)


def drop_materialized(spark: SparkSession, df: DataFrame) -> None:
    """Remove a folder that :func:`materialize` or :func:`materialize_by` wrote, once nothing reads it any more."""
    for f in df.inputFiles()[:1]:
        folder = f.rsplit("/", 1)[0]
        if "/lodestone/" in folder:
            name = folder.rsplit("/", 1)[1]
            if "-" not in name:
                spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            _remove(spark, folder)


def _remove(spark: SparkSession, at: str) -> None:
    jvm, sc = spark._jvm, spark._jsc
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(sc.hadoopConfiguration()).delete(path, True)


def _forget_at_exit(spark: SparkSession, at: str) -> None:
    def forget() -> None:
        try:
            _remove(spark, at)
        except Exception:  # the session has ended
            pass

    atexit.register(forget)


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle whose rows are dealt by hand."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    import zipfile
    from pathlib import Path

    here = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="lodestone-code-")) / "lodestone.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)
