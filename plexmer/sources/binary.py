"""Binary matrices: one file of fixed-width rows, or a file of identifiers with slices of values beside it.

Little-endian.  Whole: float32 mark, uint64 rows, uint64 columns, 64 bytes a sample name, 64 bytes a group, then rows of uint64 id and a
float32 a sample.  Sliced: another mark, uint64 rows a slice, the same head, then the ids alone; slice i is in `<file>_<i>`.
Files are read by ranges of rows, so tasks share a file; names above 64 bytes of UTF-8 are an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values of the format
WHOLE, SLICED, NAME = 421.21, 233.33, 64


@dataclass
class Head:
    rows: int
    names: list[str]
    groups: list[str]
    #: Rows a slice; 0 for whole files.
    slice_rows: int
    #: Where the first row, or id, begins.
    offset: int

    @property
    def width(self) -> int:
        return 8 + 4 * len(self.names) if not self.slice_rows else 8


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def head_of(path: str) -> Head | None:
    """The head of a binary matrix; None of any other file."""
    system, at = _open(path)
    with system.open_input_file(at) as file:
        start = file.read(28)
        if len(start) < 20:
            return None
        mark = struct.unpack("<f", start[:4])[0]
        sliced = round(mark - SLICED) == 0
        if not sliced and round(mark - WHOLE) != 0:
            return None
        skip = 12 if sliced else 4
        rows, columns = struct.unpack("<QQ", start[skip : skip + 16]) if len(start) >= skip + 16 else (0, 0)
        file.seek(skip + 16)
        cells = [file.read(NAME).rstrip(b"\0").decode() for _ in range(2 * columns)]
        return Head(rows, cells[:columns], cells[columns:], struct.unpack("<Q", start[4:12])[0] if sliced else 0, skip + 16 + 2 * NAME * columns)


def _head_bytes(rows: int, names: list[str], groups: list[str], slice_rows: int) -> bytes:
    cells = [c.encode() for c in (*names, *groups)]
    if any(len(c) > NAME for c in cells):
        raise ValueError(f"names and groups have {NAME} bytes at most")
    mark = struct.pack("<f", WHOLE) if not slice_rows else struct.pack("<fQ", SLICED, slice_rows)
    return mark + struct.pack("<QQ", rows, len(names)) + b"".join(c.ljust(NAME, b"\0") for c in cells)


def _row_type(columns: int) -> np.dtype:
    return np.dtype([("id", "<u8"), ("vals", "<f4", (columns,))])


def write_binary(dense: DataFrame, names: list[str], groups: list[str], path: str, slice_rows: int = 0) -> None:
    """(kmer_id, vals) by rising id at `path`, in slices of `slice_rows` if that is not 0.

    Rows stream through the driver, as the format is one file after all.
    """
    system, at = _open(path)
    count, kind = dense.count(), _row_type(len(names))
    ids, waiting, number = [], [], 0

    def put() -> None:
        nonlocal waiting, number
        with system.open_output_stream(f"{at}_{number}") as part:
            part.write(np.array(waiting, "<f4").tobytes())
        waiting, number = [], number + 1

    with system.open_output_stream(at) as out:
        out.write(_head_bytes(count, names, groups, slice_rows))
        for row in dense.select("kmer_id", "vals").orderBy("kmer_id").toLocalIterator():
            if len(row["vals"]) != len(names):
                raise ValueError(f"row {row['kmer_id']} has {len(row['vals'])} values for {len(names)} samples")
            if not slice_rows:
                out.write(np.array([(row["kmer_id"], row["vals"])], kind).tobytes())
                continue
            ids.append(row["kmer_id"])
            waiting.append(row["vals"])
            if len(waiting) == slice_rows:
                put()
            if len(ids) == 65536:
                out.write(np.array(ids, "<u8").tobytes())
                ids = []
        out.write(np.array(ids, "<u8").tobytes())
        if waiting:
            put()


def _rows(path: str, head: Head, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, values) of rows `first` to `last` - 1, a slice at a time."""
    system, at = _open(path)
    columns = len(head.names)
    with system.open_input_file(at) as file:
        file.seek(head.offset + first * head.width)
        data = file.read((last - first) * head.width)
    if not head.slice_rows:
        rows = np.frombuffer(data, _row_type(columns))
        yield rows["id"].astype(np.int64), rows["vals"]
        return
    ids = np.frombuffer(data, "<u8").astype(np.int64)
    for part in range(first // head.slice_rows, -(-last // head.slice_rows)):
        low, high = max(first, part * head.slice_rows), min(last, (part + 1) * head.slice_rows)
        with system.open_input_file(f"{at}_{part}") as file:
            file.seek((low - part * head.slice_rows) * 4 * columns)
            values = np.frombuffer(file.read((high - low) * 4 * columns), "<f4").reshape(-1, columns)
        yield ids[low - first : high - first], values


def read_binary(spark: SparkSession, path: str, rows_a_task: int = 100_000) -> DataFrame:
    """(row, kmer_id, vals) of a binary matrix of either kind."""
    head = head_of(path)
    if head is None:
        raise ValueError(f"{path} is no binary matrix")
    schema = pa.schema([("row", pa.int64()), ("kmer_id", pa.int64()), ("vals", pa.list_(pa.float64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column("id").to_pylist():
                at = start
                for ids, values in _rows(path, head, start, min(head.rows, start + rows_a_task)):
                    offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * values.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(ids))), pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.float64).ravel()))], schema=schema)
                    at += len(ids)

    tasks = max(1, -(-head.rows // rows_a_task))
    return spark.range(0, head.rows, rows_a_task, tasks).mapInArrow(run, "row bigint, kmer_id bigint, vals array<double>")


def samples_of(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, grp) of a binary matrix."""
    head = head_of(path)
    return spark.createDataFrame([(i, n, g) for i, (n, g) in enumerate(zip(head.names, head.groups, strict=True))], "ord int, name string, grp string")


def row_at(path: str, row: int) -> tuple[int, np.ndarray]:
    """(kmer_id, values) of one row, by its number: two seeks at most."""
    head = head_of(path)
    if not 0 <= row < head.rows:
        raise IndexError(row)
    ids, values = next(_rows(path, head, row, row + 1))
    return int(ids[0]), values[0].astype(float)


def cell_at(path: str, row: int, sample: int) -> float:
    return float(row_at(path, row)[1][sample])


def submatrix(dense: DataFrame, samples: DataFrame, features: DataFrame | None = None, groups: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the listed features (kmer_id) and columns of the listed groups; None takes all.  Samples are numbered anew."""
    kept = [r for r in samples.orderBy("ord").collect() if groups is None or r["grp"] in groups]  # a row a sample
    rows = dense if features is None else dense.join(features.select("kmer_id").distinct(), "kmer_id", "left_semi")
    rows = rows.select("kmer_id", F.array(*(F.get("vals", F.lit(r["ord"])) for r in kept)).alias("vals"))
    return rows, samples.sparkSession.createDataFrame([(i, r["name"], r["grp"]) for i, r in enumerate(kept)], "ord int, name string, grp string")
