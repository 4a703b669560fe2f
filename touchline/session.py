"""Session construction and cluster-safe scratch locations.

On a cluster the session is created by the launcher; ``configure`` only fills
in settings that are unset so a cluster's own choices always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults that matter for these jobs. AQE re-plans joins from runtime sizes
# (broadcast only when a side is measured small), splits skewed partitions and
# coalesces small shuffle outputs.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # 10,000 long texts are tens of MB, held by the JVM and by the Python worker
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "touchline") -> SparkSession:
    """Local/test session. The UI stays off (no server is opened)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    # local runs: one JVM is driver and executors; keep the plan history short
    builder = (builder.config("spark.driver.memory", "8g")
               .config("spark.sql.ui.retainedExecutions", "50")
               .config("spark.ui.retainedJobs", "200").config("spark.ui.retainedStages", "200"))
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Fill unset settings on an existing session (never overrides)."""
    conf = spark.conf
    for key, value in DEFAULT_CONF.items():
        try:
            if conf.get(key, None) is None:
                conf.set(key, value)
        except Exception:  # static conf on a running session
            pass
    # UTC is a semantic requirement (dates of matches), not a tuning knob.
    conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    ship_code(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_code(spark: SparkSession) -> None:
    """Ship this package to the Python workers (as ``--py-files`` would): the
    grouped pandas functions (Elo walks, fits, vector search) are pickled by
    reference and must import ``touchline`` on the executors."""
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    import zipfile

    import touchline

    root = os.path.dirname(os.path.abspath(touchline.__file__))
    out_dir = tempfile.mkdtemp(prefix="touchline-code-")  # driver-side code bundle, served by Spark
    path = os.path.join(out_dir, "touchline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(id(sc))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (distributed) folder; we only create our own when
    the setting is absent, which happens in local tests.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="touchline-ckpt-")
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def snapshot_id(spark: SparkSession, folder: str) -> str:
    """Name of the state of a folder of tables: a hash of its files' paths, sizes
    and times, as the file system lists them."""
    import hashlib

    at, fs = _file_system(spark, folder)
    files = fs.listFiles(at, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr((folder, sorted(seen))).encode()).hexdigest()[:16]


def stored_once(spark: SparkSession, name: str, write) -> str:
    """Path of a stored table under the shared folder, the same for every
    session. ``write(path)`` runs if no session has written it: to a path of its
    own, which is renamed when complete, so readers never see a part of it."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/touchline-tables/{name}"
    at, fs = _file_system(spark, path)
    if not fs.exists(at):
        own = f"{path}-{uuid.uuid4().hex[:12]}"
        write(own)
        fs.mkdirs(at.getParent())
        if not fs.exists(at):
            fs.rename(_file_system(spark, own)[0], at)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)
