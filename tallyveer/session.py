"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. Shuffle parallelism is left to the cluster:
# AQE coalesces from whatever initial number the session carries.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

# Stored bytes of input per shuffle partition. Rows take two to three times that in a shuffle and far more when sorted and summed up.
STORED_PER_PARTITION = 8 << 20

# Upper limits of what adaptive execution reads in one task (joined partitions, and a hot key's partition before it is split).
READ_PER_TASK = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20,
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 32 << 20,
}


def local_session(cores: int = 8, memory: str = "8g", app: str = "tallyveer") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        # small data: keep all cores busy after a shuffle
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # call-site capture costs more than the small queries themselves
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for a while; the caller's own come back afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def byte_count(text: str) -> int:
    """Bytes of a setting such as ``64MB``, ``8m`` or ``1048576b``."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * (" kmgtp".index(unit) if unit else 0)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file, a folder or all that a pattern names, on whatever file system it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(system.getContentSummary(found.getPath()).getLength() for found in system.globStatus(target) or ())


def sized_session(spark: SparkSession, size: int) -> SparkSession:
    """Session for shuffles of ``size`` stored bytes whose tasks do not grow with that size.

    The number of shuffle partitions follows the input, and adaptive execution joins them to small ones. These settings hold for what is read
    through the session returned; the caller's session, whose other settings it takes over as they are now, keeps its own. Where the caller's
    partitions and cores suffice, it is the caller's session itself.
    """
    wanted = -(-size // STORED_PER_PARTITION)
    have = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if wanted <= min(have, spark.sparkContext.defaultParallelism):
        return spark
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.shuffle.partitions", str(max(wanted, have)))
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if (set_to := spark.conf.get(initial, None)) is not None:
        own.conf.set(initial, str(max(wanted, int(set_to))))
    for name, limit in READ_PER_TASK.items():
        own.conf.set(name, f"{min(limit, byte_count(spark.conf.get(name)))}b")
    return own


def share_package(spark: SparkSession) -> None:
    """Name this checkout to Python workers, for functions that run there.

    Executors that do not see it need the package from ``--py-files`` as usual.
    """
    here, known = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(":") if p]
    if here not in paths:
        known["PYTHONPATH"] = ":".join([*paths, here])


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for ``purpose`` under the folder that ``spark.checkpoint.dir`` names.

    Every executor must reach that folder. Where the setting is missing, a session on this machine alone gets a folder of its own, as in
    tests; a cluster's session is refused.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyveer-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, purpose: str, keep: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the work folder and read it back.

    Cuts the lineage: losing an executor later costs a re-read of this table, not another pass over what it came from. The folder's name is
    added to ``keep``, for whoever removes it once its readers are done.
    """
    spark = df.sparkSession
    folder = work_folder(spark, purpose)
    df.write.parquet(folder)
    if keep is not None:
        keep.append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
