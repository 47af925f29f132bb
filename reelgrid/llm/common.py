"""What the operators of this subpackage share: the shared folder, written tables, lookups and batches of texts.

Written tables lie below reelgrid/ in the shared folder and are deleted when the Python driver ends; drop() deletes one
before that.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_shipped: set[str] = set()
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a local one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at the end of the driver."""
    if not _written:
        atexit.register(_drop_all)
    path = f"{shared_dir(spark)}/reelgrid/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def _delete(path: str) -> None:
    spark = _written.pop(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001, PERF203  the session has ended: the folder is its owner's to clear
            return


def drop(df: DataFrame) -> None:
    """Deletes the table of saved() that df reads; nothing may read df afterwards."""
    path = getattr(df, "_saved_at", None)
    if path in _written:
        _delete(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def ready(spark: SparkSession) -> None:
    """Lets the Python workers import this package, and keeps Arrow batches of long texts small: the session's limit of rows a batch is lowered to 512 and stays so, since a plan reads it when it runs."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        if os.path.isdir(top):
            path = os.path.join(tempfile.mkdtemp(prefix="spark-code-"), "reelgrid_code.zip")
            with zipfile.ZipFile(path, "w") as z:
                for folder, _, names in os.walk(top):
                    for n in names:
                        if n.endswith(".py"):
                            full = os.path.join(folder, n)
                            z.write(full, os.path.relpath(full, os.path.dirname(top)))
            sc.addPyFile(path)
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def text_hash() -> Column:
    """Tells rows apart that share a doc_id but not a text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def small(table: DataFrame, limit: int) -> bool:
    """Whether a table has at most limit rows; counts no further than that."""
    return table.limit(limit + 1).count() <= limit


def lookup(big: DataFrame, table: DataFrame, keys: list[str], limit: int = 200_000, salts: int = 64) -> DataFrame:
    """big left-joined to a table with one row per key; nulls match nulls.

    The table is broadcast if a count finds at most limit rows. Otherwise it is repeated once per salt and big is dealt
    by key and salt, so that a key with a third of all rows still spreads over many tasks.
    """
    right = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in table.columns if c not in keys])
    on = None
    for i, k in enumerate(keys):
        one = big[k].eqNullSafe(F.col(f"_k{i}"))
        on = one if on is None else on & one
    drop = [f"_k{i}" for i in range(len(keys))]
    if small(table, limit):
        return big.join(F.broadcast(right), on, "left").drop(*drop)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns[:3]]), F.lit(salts)))
    right = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    on = on & (F.col("_salt") == F.col("_salt2"))
    return salted.join(right, on, "left").drop(*drop, "_salt", "_salt2")


def range_parts(df: DataFrame, rows_each: int) -> list[int]:
    """How many ranges df is cut into: none is given, so that the session's setting holds, unless that many would have more rows than rows_each."""
    n = -(-df.count() // rows_each)
    return [n] if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def runs_of(texts: list, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of together about most characters; a longer text has a range to itself."""
    return runs_by([len(t) if t else 0 for t in texts], most)


def runs_by(sizes: list[int], most: int = 64_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of together about most bytes; a larger row has a range to itself."""
    at, n = 0, 0
    for i, size in enumerate(sizes):
        if i > at and n + size > most:
            yield at, i
            at, n = i, 0
        n += size
    if at < len(sizes):
        yield at, len(sizes)
