"""What the operators of this subpackage share: row keys, shared storage and size-checked broadcasts.

Every operator reads only the columns it names, so extra columns (whatever their names) pass by untouched.
A row is known by ``row_id`` (its doc_id, null as the largest long) and ``row_hash`` (XXH64 of its text):
rows that agree in both have the same text and so the same result.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = (1 << 63) - 1
#: A table is broadcast only if it was counted and is not larger than this.
BROADCAST_BYTES = 24 << 20
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words between ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"

#: While saved() writes. An Arrow batch of texts is held by the JVM and the Python worker of each task, in several copies, so
#: it is smaller than Spark's 64 MB; batches of narrow rows are bounded by their number of rows, as before.
WHILE_SAVED = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
}

_local_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; a temporary one only for a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_folders.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="fieldloom-"))


def give_back() -> None:
    """At the end of a task: return freed memory to the machine. Workers live on and share it with the other stages."""
    import ctypes

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another libc


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


#: Folders of saved() in the innermost temporaries().
_open_scope: ContextVar[list[str] | None] = ContextVar("open_scope", default=None)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables saved inside are deleted at the end, but for those that the frames put into the list read; these belong to
    the scope around this one, if there is one."""
    outer, mine, kept = _open_scope.get(), [], []
    token = _open_scope.set(mine)
    try:
        yield kept
    finally:
        _open_scope.reset(token)
        read = {f.rpartition("/")[0].rpartition("/")[2] for df in kept for f in df.inputFiles()}
        for path in mine:
            if path.rpartition("/")[2] not in read:
                _delete(spark, path)
            elif outer is not None:
                outer.append(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor loses nothing. What it
    shuffled is deleted once it is written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    if (scope := _open_scope.get()) is not None:
        scope.append(path)
    before = {key: spark.conf.get(key, None) for key in WHILE_SAVED}
    for key, value in WHILE_SAVED.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that saved() made, once nothing reads it any more."""
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, name)


def small(df: DataFrame, bytes_per_row: int, more: Column | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A saved table, marked for broadcast if it proves to be small; else it is left to a shuffled join.

    bytes_per_row is what the columns of fixed width take, more what strings and arrays of a row add: both are summed up
    over the whole table.
    """
    added = F.coalesce(F.sum(more), F.lit(0)) if more is not None else F.lit(0)
    rows, held = df.agg(F.count("*"), added.cast("long")).first()
    return F.broadcast(df) if rows * bytes_per_row + held <= limit else df


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """row_id, row_hash, text (null: empty), and more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("row_id"),
        F.xxhash64(text).alias("row_hash"),
        text.alias("text"),
        *more,
    )


def text_rows(docs: DataFrame) -> DataFrame:
    """row_id, row_hash, body (the text in UTF-8; null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    return docs.select(row_id.alias("row_id"), F.xxhash64(text).alias("row_hash"), text.cast("binary").alias("body"))


def with_row_key(docs: DataFrame) -> DataFrame:
    """docs with all its columns and the row key under names that tables don't use."""
    return docs.withColumns(
        {
            "__row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)),
            "__row_hash": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
        }
    )


def without_rows(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs less the rows whose (row_id, row_hash) are in the saved table removed; the columns stay as they are."""
    gone = small(removed.select(F.col("row_id").alias("__row_id"), F.col("row_hash").alias("__row_hash")).distinct(), 40)
    return with_row_key(docs).join(gone, ["__row_id", "__row_hash"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
