"""Session helpers.

On a cluster the session is created by the platform; these helpers only fill in
settings that are unset, so that tests and the bench run on ``local[N]``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "treeline") -> SparkSession:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder
        .master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Read ``spark.checkpoint.dir`` from the session (set by the cluster); only
    when it is unset on a ``local[...]`` master (tests) is a scratch folder
    chosen here. On a cluster an unset folder is an error, never a
    machine-local path.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if current is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local_dir = tempfile.mkdtemp(prefix="treeline-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local_dir)
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


def write_table(df, name: str = "table"):
    """Materialise ``df`` as Parquet in the shared checkpoint folder and read it back.

    This cuts lineage like ``checkpoint()``, but the read-back is a Parquet scan:
    later plans get column pruning and filter pushdown, and a lost executor
    re-reads the files instead of recomputing upstream work.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_bucketed(df, keys: list[str], name: str, buckets: int | None = None):
    """Write ``df`` once as a table bucketed by ``keys`` in the shared checkpoint folder.

    A join on ``keys`` then reads the table where it lies: only the other side is shuffled, into
    as many partitions as there are buckets (at least ``spark.sql.shuffle.partitions``, so
    that Spark keeps them). ``df`` should come from an aggregation by ``keys``: its partitions
    are the buckets, one file each.
    """
    import uuid

    spark = df.sparkSession
    n = max(buckets or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = f"treeline_{name}_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{table}"
    if n != int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(n, *keys)
    df.write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``treeline`` importable in the Python workers (once per application).

    Python stages (the parse, the replays, the tree source) refer to functions
    of this package, so executors need it: the package is zipped once and
    handed to ``addPyFile``, which serves it to every executor.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="treeline-pkg-"), "treeline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, names in os.walk(pkg):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(root, n)
                    zf.write(full, os.path.relpath(full, base))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
