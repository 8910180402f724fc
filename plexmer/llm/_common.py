"""Shared folder, materialisation and Arrow helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A note holds the values of 2**NOTE numbers, a character each; up to `NOTES` of them (32 MB) are broadcast.
NOTE, NOTES = 10, 1 << 15
#: Largest value of a note.
MOST_NOTED = 79

#: ASCII white space that separates words, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]+"

#: What a worker process keeps from task to task.
_kept: dict[Hashable, object] = {}


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="plexmer-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, `spark.checkpoint.dir`; a folder of this machine only where none is set and all of Spark runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = _own_folder()
    return folder.rstrip("/")


def workspace(spark: SparkSession, tag: str) -> str:
    """A fresh folder of this run below the shared one."""
    return f"{shared_folder(spark)}/plexmer-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here, and
    lost executors cost no more than the reading task."""
    return materialise_at(df, tag)[0]


def materialise_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As `materialise`; the folder too, for `drop_folder` once all that reads it is written."""
    path = workspace(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def with_row_id(df: DataFrame, tag: str) -> DataFrame:
    """`df` with row_id, a text that tells every row from all others and is the same whenever the result is read.

    Rows of a Parquet table, and of a selection of its columns, are named by file and number in it; others are written first.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() == "Project":
        plan = plan.child()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        df = materialise(df, tag)
    return df.select("*", F.concat_ws("#", F.col("_metadata.row_index"), F.md5(F.col("_metadata.file_path").cast("binary"))).alias("row_id"))


def place(row_id: str) -> tuple[Column, Column]:
    """File and number in it of a row_id."""
    return F.substring_index(row_id, "#", -1), F.substring_index(row_id, "#", 1).cast("bigint")


def with_values(rows: DataFrame, at: tuple[Column, Column], values: DataFrame, tag: str) -> DataFrame:
    """`rows` with _value: what `values` (file, number, value from 0 to `MOST_NOTED`) has for the place `at`, 0 where it has nothing.

    Values of neighbouring numbers are written as one note, so a value costs a byte and `rows`, which may hold
    whole texts, is not shuffled; above `NOTES` notes it is joined like any other table.
    """
    entries = f"array_sort(collect_set((number & {(1 << NOTE) - 1}) * 128 + value))"
    note = F.expr(f"aggregate({entries}, '', (s, e) -> concat(rpad(s, CAST(e DIV 128 AS INT), '0'), chr(48 + e % 128)))")
    notes = materialise(values.groupBy(F.col("file").alias("_file"), F.shiftright("number", NOTE).alias("_nth")).agg(note.alias("_note")), tag)
    file, number = at
    placed = rows.select("*", file.alias("_file"), F.shiftright(number, NOTE).alias("_nth"), number.bitwiseAND(F.lit((1 << NOTE) - 1)).cast("int").alias("_at"))
    joined = placed.join(F.broadcast(notes) if notes.count() <= NOTES else notes, ["_file", "_nth"], "left")
    # past the end of a note, and without one, there is no character
    value = F.greatest(F.lit(0), F.ascii(F.substring(F.coalesce("_note", F.lit("")), F.col("_at") + 1, F.lit(1))) - 48)
    return joined.select(*rows.columns, value.alias("_value"))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of `workspace` through Hadoop's file system interface."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of at most `rows` rows, unless the session has chosen its own size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def kept(name: Hashable, make: Callable[[], object]) -> object:
    """What this worker process keeps under `name`, made where there is nothing yet."""
    if name not in _kept:
        _kept[name] = make()
        forget(name)  # what only the making needed
    return _kept[name]


def forget(but: Hashable = None) -> None:
    """Drop all that this worker process keeps, except under the name `but`, and give freed memory back to the system."""
    for name in [k for k in _kept if k != but]:
        del _kept[name]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: Hashable = None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, such that a worker, which idles beside later steps or runs them, holds nothing of earlier ones but what is kept under the name `keeps`."""

    def leaving(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            forget(keeps)

    return leaving


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup batches sorted by the int64 column `key`, so that no key is cut.

    For keys with a bounded number of rows: one group at most is held besides
    the current batch.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.argmax(keys == keys[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def column(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(name).to_numpy()


def run_bounds(keys: np.ndarray) -> np.ndarray:
    """Start of every run of equal keys, and the length of the array at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
