"""Table sinks: create, day-partition replace, replace, append, versions, latest model.

Tables that are loaded by day (``usage_date``, ``ds``, ``prediction_date``) or
version are published through a manifest (``sources.manifest``): a load of any
number of days is one write and one commit.  Tables that are replaced whole are
plain Parquet folders.  Every writer conforms the frame to the declared schema
first, so a write can never change a column type.  Paths are on the shared
storage the cluster uses (for tests: a scratch folder under
``spark.checkpoint.dir``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import conform
from ..session import ensure_checkpoint_dir
from . import manifest


def stage_root(spark: SparkSession) -> str:
    """The application's own folder under the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stage of this application."""
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_stages(spark: SparkSession) -> None:
    """Remove every stage this application wrote; call it when its results are stored or read.

    A stage may be read by the result that a job returns, so jobs cannot do
    this themselves.  An application that died leaves its folder, named after
    its id, for the owner of the checkpoint location.
    """
    fs, p = _fs(spark, stage_root(spark))
    fs.delete(p, True)


def create_table(spark: SparkSession, name: str, schema: T.StructType, path: str,
                 partition_by: tuple[str, ...] = ()) -> None:
    """``CREATE TABLE IF NOT EXISTS ... USING parquet PARTITIONED BY ... LOCATION``."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    part = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet{part} LOCATION '{path}'")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def load_partitions(df: DataFrame, path: str, schema: T.StructType, key: str, values) -> None:
    """Replace the partitions ``values`` of ``key`` by the rows of ``df``: one write, visible in one step.

    A load that fails leaves every day as it was, loads of different days can
    run at once, and of two loads of one day the later commit stands whole.  A
    value without rows ends empty; a row of any other partition fails the load;
    no row is filtered away.
    """
    manifest.publish({manifest.DATA: (df, schema)}, path, key, values)


def append_batch(df: DataFrame, path: str, schema: T.StructType, key: str, value) -> bool:
    """Append rows as the batch ``value`` of ``key``; False, and nothing added, if that batch is there already.

    Different batches may hold the same business keys (overlapping prediction
    windows do): all of their rows stand, as after plain inserts.
    """
    return manifest.publish({manifest.DATA: (df, schema)}, path, key, [value], absent=True)


def read_table(spark: SparkSession, path: str, schema: T.StructType, at: manifest.Snapshot | None = None) -> DataFrame:
    """Read a table back with its declared schema (empty if nothing was written), ``at`` a version or as it is now."""
    if at is not None or manifest.is_published(spark, path):
        return manifest.read(spark, path, schema, at=at).select(*schema.fieldNames())
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def last_value(spark: SparkSession, *paths: str) -> str | None:
    """The greatest partition value for which every table holds rows, from the manifests alone."""
    held = [set(manifest.snapshot(spark, p).values()) for p in paths]
    return max(set.intersection(*held), default=None)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def backfill(df: DataFrame, path: str, schema: T.StructType, key: str) -> None:
    """Load a whole history: every day in one write and one commit; days without rows are gone."""
    manifest.publish({manifest.DATA: (df, schema)}, path, key, whole=True)


def is_loaded(spark: SparkSession, path: str) -> bool:
    """Whether a load was committed, with or without rows, or a table that is replaced whole holds a file."""
    if manifest.is_published(spark, path):
        return bool(manifest.snapshot(spark, path).batches)
    fs, p = _fs(spark, path)
    return fs.exists(p) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(p))


def overwrite_folder(df: DataFrame, target: str, unless_empty: bool = False) -> bool:
    """Replace one folder by the rows of ``df``: write beside, switch, drop the old.

    With ``unless_empty`` the folder stays as it is, and False is returned, if
    ``df`` has no rows; the new files tell, so ``df`` is computed and written once.

    The new files are complete before the old folder moves away, so a failed
    write leaves the folder as it was, writers of other folders share nothing
    with it, and readers miss it only between two renames.  (Spark's own
    overwrite deletes the folder first.)  Names that begin with an underscore
    are hidden from readers.
    """
    spark = df.sparkSession
    parent, _, name = target.rstrip("/").rpartition("/")
    tag = uuid.uuid4().hex[:12]
    beside, aside = f"{parent}/_new-{tag}-{name}", f"{parent}/_old-{tag}-{name}"
    fs, p = _fs(spark, target)
    new, old = _fs(spark, beside)[1], _fs(spark, aside)[1]
    try:
        df.write.mode("overwrite").option("compression", manifest.COMPRESSION).parquet(beside)
        stays = unless_empty and spark.read.schema(df.schema).parquet(beside).isEmpty()
    except Exception:
        fs.delete(new, True)
        raise
    if stays:
        fs.delete(new, True)
        return False
    had = fs.exists(p)
    if had and not fs.rename(p, old):
        raise OSError(f"cannot move {target} away")
    if not fs.rename(new, p):
        raise OSError(f"cannot move the new rows to {target}")
    if had:
        fs.delete(old, True)
    return True


def replace_table(df: DataFrame, path: str, schema: T.StructType, optional: tuple[str, ...] = (),
                  unless_empty: bool = False) -> bool:
    """CREATE OR REPLACE TABLE AS SELECT: cast to the declared schema, replace the folder (see ``overwrite_folder``)."""
    return overwrite_folder(conform(df, schema, optional), path, unless_empty)


def next_version(spark: SparkSession, path: str) -> int:
    """One more than the highest version; 1 for a new table."""
    return 1 + max((int(v) for v in manifest.snapshot(spark, path).batches), default=0)


def replace_partition(df: DataFrame, path: str, schema: T.StructType, key: str, value) -> None:
    """Replace one partition (a model version, a prediction day) by rows that may lack the key: a repeat replaces it."""
    load_partitions(df.withColumn(key, F.lit(value).cast(schema[key].dataType)), path, schema, key, [value])


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of the highest ``version`` per ``keys`` (the ``:latest`` model tag).

    A grouped max joined back; the max per key is one row per key, so the
    join side is the size of the key set.
    """
    top = df.groupBy(*keys).agg(F.max(version).alias(version))
    return df.join(top, [*keys, version], "left_semi")


def latest_per_key(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``order_col`` (dedupe of appends)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order_col).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but computes the plan a single time
    (a reliable RDD checkpoint of an unpersisted plan computes it twice), and
    the files live on the storage the cluster names in ``spark.checkpoint.dir``,
    so a lost executor cannot lose them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if STAGE_PLANS is not None:
        STAGE_PLANS.append((name, df._jdf.queryExecution().executedPlan().toString()))
    df.write.mode("overwrite").option("compression", manifest.COMPRESSION).parquet(path)
    return spark.read.parquet(path)


# (stage, physical plan) of every stage while a list stands here (the plan report sets one)
STAGE_PLANS: list | None = None
