"""Published partitions: a load writes one batch of files, then a manifest names it.

``<path>/<part>/batch=<id>/<key>=<value>/*.parquet`` holds the rows and
``<path>/manifest/v<N>.json`` the batch of every partition value, one line each.
A load of any number of days is one partitioned write; nothing of it is visible
until version N + 1 of the manifest appears, by one rename that fails if that
version exists.  A loser of that race takes the newer version and adds its own
days again, so loads of different days never undo each other and two loads of
one day never mix.  Several parts (the three tables of a model) share one
manifest, so a reader of one version sees them as they were written together.

The rename without overwriting is atomic on HDFS and on stores whose file
context gives that guarantee; in a plain local folder it is a test and a
rename, which this process guards by a lock.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import conform

DATA = "data"
SCHEMA_FOLDER = "batch=schema"
COMPRESSION = "zstd"       # of the Parquet files of tables and stages
KEEP_VERSIONS = 50         # manifests kept for readers that hold an older version
_LOCK = threading.Lock()


@dataclass(frozen=True)
class Snapshot:
    """One version of a manifest: the batch of each partition value ('' for a value without rows)."""

    version: int = 0
    key: str = ""
    batches: dict[str, str] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)        # partitions that each batch was written with

    def values(self) -> list[str]:
        """The partition values that hold rows, in order of their text."""
        return sorted(v for v, b in self.batches.items() if b)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[1:-5]) for n in _names(spark, f"{path}/manifest") if n.startswith("v") and n.endswith(".json"))


def _file(path: str, version: int) -> str:
    return f"{path}/manifest/v{version:012d}.json"


def is_published(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The newest version; reads one small file and no data."""
    versions = _versions(spark, path)
    if not versions:
        return Snapshot()
    fs, p = _fs(spark, _file(path, versions[-1]))
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    lines = [json.loads(x) for x in text.splitlines()]
    return Snapshot(versions[-1], lines[0]["key"], {x["value"]: x["batch"] for x in lines if x["value"]},
                    {x["batch"]: x["size"] for x in lines if x["batch"]})


def _lines(s: Snapshot) -> str:
    # a manifest without partitions keeps one line, which carries the key
    rows = [(v, b, s.sizes.get(b, 0)) for v, b in sorted(s.batches.items())] or [("", "", 0)]
    return "".join(json.dumps({"version": s.version, "key": s.key, "value": v, "batch": b, "size": n}) + "\n" for v, b, n in rows)


def _create_version(spark: SparkSession, path: str, s: Snapshot) -> bool:
    """Make ``s`` the newest version; False if that version exists already."""
    beside = f"{path}/manifest/_new-{uuid.uuid4().hex}"
    fs, p = _fs(spark, beside)
    out = fs.create(p, False)
    out.write(_lines(s).encode())
    out.close()
    return _rename_new(spark, beside, _file(path, s.version))


def _rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename without overwriting; False, and ``source`` deleted, if ``target`` exists."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    fs, p = _fs(spark, source)
    to = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(target))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), sc._jsc.hadoopConfiguration())
    none = sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(p), to, none)
    except Exception as e:
        fs.delete(p, True)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def commit(spark: SparkSession, path: str, key: str, change: dict[str, str], size: int, whole: bool = False,
           absent: bool = False) -> bool:
    """Point the values of ``change`` at their batches in one step; other values stay as the newest version has them.

    ``whole`` drops the values that are not in ``change``.  ``absent`` commits
    only if no value of ``change`` is there yet, and returns False otherwise.
    """
    with _LOCK:
        while True:
            now = snapshot(spark, path)
            if absent and any(v in now.batches for v in change):
                return False
            batches = dict(change) if whole else {**now.batches, **change}
            sizes = {b: n for b, n in now.sizes.items() if b in batches.values()} | {b: size for b in change.values() if b}
            if _create_version(spark, path, Snapshot(now.version + 1, key, batches, sizes)):
                break
        for old in _versions(spark, path)[:-KEEP_VERSIONS]:
            fs, p = _fs(spark, _file(path, old))
            fs.delete(p, False)
    return True


def create(spark: SparkSession, path: str, schema: T.StructType, key: str) -> None:
    """An empty table, unless there is one."""
    _declare(spark, f"{path}/{DATA}", schema, key)
    if not is_published(spark, path):
        commit(spark, path, key, {}, 0)


def _declare(spark: SparkSession, folder: str, schema: T.StructType, key: str) -> None:
    """A file without rows that tells readers by path the columns, also while no day has rows."""
    if SCHEMA_FOLDER not in _names(spark, folder):
        empty = spark.createDataFrame([], T.StructType([f for f in schema.fields if f.name != key]))
        kind = next((f.dataType for f in schema.fields if f.name == key), T.DateType())
        value = "1970-01-01" if isinstance(kind, T.DateType) else "0"
        beside = f"{folder}/_schema-{uuid.uuid4().hex}"        # several first loads may declare at once
        empty.write.parquet(f"{beside}/{key}={value}")
        with _LOCK:
            _rename_new(spark, beside, f"{folder}/{SCHEMA_FOLDER}")


def _write(df: DataFrame, target: str, key: str, one: bool) -> None:
    if not one:
        # ranges of (day, row): neighbouring small days share a task, a large day is dealt to several
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, key, "_row").drop("_row")
    df.write.mode("error").partitionBy(key).option("compression", COMPRESSION).parquet(target)


@dataclass(frozen=True)
class Batch:
    """Written files that no manifest names yet."""

    spark: SparkSession
    path: str
    key: str
    change: dict[str, str]
    size: int
    folders: tuple[str, ...]

    def commit(self, whole: bool = False, absent: bool = False) -> bool:
        try:
            done = commit(self.spark, self.path, self.key, self.change, self.size, whole, absent)
        except Exception:
            self.discard()
            raise
        if not done:
            self.discard()
        return done

    def discard(self) -> None:
        for f in self.folders:
            fs, p = _fs(self.spark, f)
            fs.delete(p, True)


def write_batch(parts: dict[str, tuple[DataFrame, T.StructType]], path: str, key: str, values=None) -> Batch:
    """Write ``parts`` (name -> rows, schema with ``key``) as one batch that nobody sees before it is committed.

    ``values`` are the partitions that this load stands for: a row of another
    one, or without a value, fails the load, and a value without rows becomes
    empty.  Without ``values`` the load stands for those that its rows have.
    """
    spark = next(iter(parts.values()))[0].sparkSession
    name = f"b{time.time_ns():x}-{uuid.uuid4().hex[:8]}"
    targets = {p: f"{path}/{p}/batch={name}" for p in parts}
    batch = Batch(spark, path, key, {}, 0, tuple(targets.values()))
    want = None if values is None else {str(v) for v in values}
    try:
        held = set()
        for p, (_, schema) in parts.items():
            _declare(spark, f"{path}/{p}", schema, key)
        with ThreadPoolExecutor(len(parts)) as pool:          # the parts are independent jobs
            one = want is not None and len(want) == 1
            list(pool.map(lambda p: _write(conform(*parts[p]), targets[p], key, one), parts))
        for p in parts:
            held |= {n.split("=", 1)[1] for n in _names(spark, targets[p]) if n.startswith(f"{key}=")}
        foreign = {v for v in held if v.startswith("__HIVE_DEFAULT")} | (held - want if want is not None else set())
        if foreign:
            stands = f"in {min(want)} .. {max(want)}" if want else "that are not null"
            raise ValueError(f"rows outside {key} {stands}: {', '.join(sorted(foreign)[:5])}")
    except Exception:
        batch.discard()
        raise
    return replace(batch, change={v: name if v in held else "" for v in (held if want is None else want)}, size=len(held))


def publish(parts: dict[str, tuple[DataFrame, T.StructType]], path: str, key: str, values=None, whole: bool = False,
            absent: bool = False) -> bool:
    """``write_batch`` and ``commit`` in one go."""
    return write_batch(parts, path, key, values).commit(whole, absent)


def read(spark: SparkSession, path: str, schema: T.StructType, part: str = DATA, at: Snapshot | None = None) -> DataFrame:
    """Rows of ``part`` at one version, with the key as a column that prunes folders."""
    at = at or snapshot(spark, path)
    full = schema if at.key in schema.fieldNames() else T.StructType([*schema.fields, T.StructField(at.key, T.DateType())])
    live: dict[str, set[str]] = {}
    for v, b in at.batches.items():
        if b:
            live.setdefault(b, set()).add(v)
    if not live:
        return spark.createDataFrame([], full)
    paths, keep = [], F.lit(True)
    for b, values in live.items():
        root = f"{path}/{part}/batch={b}"
        if len(values) < at.sizes[b]:
            old = [n.split("=", 1)[1] for n in _names(spark, root) if n.startswith(f"{at.key}=")]
            old = [v for v in old if v not in values]
            if len(old) > len(values):
                paths += [f"{root}/{at.key}={v}" for v in values]
                continue
            keep = keep & ((F.col("batch") != b) | ~F.col(at.key).isin([F.lit(v).cast(full[at.key].dataType) for v in old]))
        paths.append(root)
    got = spark.read.schema(T.StructType([*full.fields, T.StructField("batch", T.StringType())]))
    return got.option("basePath", f"{path}/{part}").parquet(*paths).where(keep).select(*full.fieldNames())


def sql_live(path: str) -> str:
    """SQL of the newest version's (value, batch) rows that hold rows; small files only."""
    m = f"json.`{path}/manifest`"
    return f"(select value, batch from {m} where version = (select max(version) from {m}) and batch <> '')"


def sql_table(path: str, key: str, part: str = DATA) -> str:
    """SQL of the rows that ``read`` gives: it follows later loads, and the manifest prunes the folders."""
    return (f"(select d.* except (batch) from parquet.`{path}/{part}` d left semi join {sql_live(path)} m "
            f"on m.batch = d.batch and cast(m.value as date) = d.{key})")


def vacuum(spark: SparkSession, path: str, older_than_s: float = 7 * 86_400) -> int:
    """Delete batches that no kept version names and that are older than any running load; returns their number."""
    named = set()
    for v in _versions(spark, path):
        fs, p = _fs(spark, _file(path, v))
        stream = fs.open(p)
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        named |= {json.loads(x)["batch"] for x in text.splitlines()}
    dropped = 0
    for part in _names(spark, path):
        if part == "manifest":
            continue
        fs, p = _fs(spark, f"{path}/{part}")
        for f in fs.listStatus(p):
            name = f.getPath().getName()
            old = f.getModificationTime() / 1000 <= time.time() - older_than_s
            if name.startswith("batch=") and name != SCHEMA_FOLDER and name[6:] not in named and old:
                fs.delete(f.getPath(), True)
                dropped += 1
    return dropped
