"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(cpus: int | str = "*", app: str = "articlelab",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the
    cluster's own session (``SparkSession.builder.getOrCreate()``)."""
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 1) * 2)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ARTICLELAB_DRIVER_MEM", _driver_memory()))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _driver_memory() -> str:
    """Local-mode heap: 8 GB, or 60% of the machine's memory when smaller."""
    try:
        with open("/proc/meminfo") as f:
            kb = next(int(line.split()[1]) for line in f if line.startswith("MemTotal:"))
        return f"{max(1, min(8, int(kb * 0.6 / 1024 / 1024)))}g"
    except (OSError, StopIteration, ValueError):
        return "4g"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that one
    is used as is. Only a local-mode session (tests, bench) without the
    setting gets a fresh scratch folder of its own.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the folder
        return spark.conf.get(CHECKPOINT_CONF, "")
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            f"{CHECKPOINT_CONF} is not set: iterative jobs need a shared folder")
    folder = tempfile.mkdtemp(prefix="articlelab-ckpt-", dir="/tmp")
    spark.conf.set(CHECKPOINT_CONF, folder)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (for written
    intermediate tables and stream state)."""
    base = ensure_checkpoint_dir(spark)
    import uuid
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark removes an execution's shuffle files when it has ended, not when the
#: driver happens to collect its garbage.
SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, name: str = "table", path: str | None = None, codec: str | None = None, numbers: bool = False):
    """Cut the lineage by writing ``df`` as parquet into the shared
    checkpoint folder and reading it back: one job computes and writes it
    (``Dataset.checkpoint`` would compute the plan twice), and a lost
    executor later re-reads files instead of recomputing the plan. The
    write's own shuffle files go with it: nothing reads them again. ``path``:
    a folder to write over instead of a fresh one. ``codec``: the files' own, if not
    the session's. ``numbers``: mostly numbers that differ, written as they are."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP_CONF, None)
    spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
    try:
        to = df.write.mode("overwrite")
        to = to.option("parquet.enable.dictionary", "false") if numbers else to
        to.parquet(path, compression="none" if numbers else codec)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_CONF)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_CONF, before)
    return spark.read.parquet(path)


class Rounds:
    """The rounds of one table of numbers, in two folders written in turn: a round stays while
    the next is made of it, and the one after that is written over it."""

    def __init__(self, spark: SparkSession, name: str):
        self.paths, self.written = [scratch_path(spark, name) for _ in range(2)], 0

    def write(self, df):
        self.written += 1
        return materialize(df, path=self.paths[self.written % 2], numbers=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``articlelab`` importable in the Python workers (the functions
    run by ``mapInPandas`` refer to its modules): zip the package once per
    application and hand it to ``SparkContext.addPyFile``, which serves it
    to every executor, like ``--py-files``."""
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect: ship as an artifact instead
        sc, app = None, f"connect-{id(spark)}"
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="articlelab-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    zf.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(path)
    else:
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(app)
