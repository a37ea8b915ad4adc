"""Session defaults, lineage cuts and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(app: str = "nascent", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package is tuned for; keyword settings win."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``. A folder of our own is made
    only on a local master with nothing configured, as in tests.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="nascent-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether something lies at ``path``, in whatever store; a store that cannot be asked raises."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place))


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the shared folder once and read it back from there.

    Used for tables that several later steps read. It is computed exactly once, survives
    the loss of executors, and its true size is known to the joins that follow.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fix_partitions(df: DataFrame) -> DataFrame:
    """Cut the lineage and keep the partitions as they are."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_scan(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has cores.

    For processor-heavy text work on small or badly split files. A large scan has many
    splits already and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def attach_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread: str,
    how: str = "inner",
    row_bytes: int = 256,
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
    salts: int = 64,
    null_safe: bool = False,
) -> DataFrame:
    """Join a per-key summary onto the rows it was made from.

    ``small`` is settled and counted first. Below ``limit_bytes`` it is broadcast,
    so the big side is not shuffled. Beyond it both sides are salted: the rows of a
    hot key are spread over ``salts`` partitions by the hash of ``spread``, and the
    summary row is repeated once per salt. With ``null_safe``, null keys are keys.
    """
    small = settle(small)
    if small.count() * row_bytes <= limit_bytes:
        return _join(big, F.broadcast(small), on, how, null_safe)
    salt = F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int")
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return _join(big.withColumn("_salt", salt), repeated, [*on, "_salt"], how, null_safe).drop("_salt")


def _join(big: DataFrame, small: DataFrame, on: list[str], how: str, null_safe: bool) -> DataFrame:
    if not null_safe:
        return big.join(small, on, how)
    renamed = small.toDF(*[f"_on_{c}" if c in on else c for c in small.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return big.join(renamed, same, how).drop(*[f"_on_{c}" for c in on])
