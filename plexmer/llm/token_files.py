"""Token ids as Arrow stream files of fixed-size lists.

Ids of all documents in ascending doc_id order form one stream.  A file holds a
range of doc_ids: record batches of `ids: fixed_size_list<uint16 or uint32, WIDTH>`
(two bytes where the vocabulary allows it) and `mask: fixed_size_list<bool, WIDTH>`
(true: an id, false: padding of the file's last sequence), in Arrow's file format, so any sequence is reached by its number and
mapped without copying.  Beside it lies an index file (doc_id, start, n_tokens,
start counted from the file's first id).  Files are written under a name of the
task's attempt and listed in a manifest; only listed files are read.

Defined cases: null text is an empty document (its end id alone); null doc_ids
come first; rows with equal doc_id are ordered by text; other columns are
ignored; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, small_batches, workspace
from ._ranges import bucket_of, id_splitters
from ._tokens import default_tokenizer, encoder

WIDTH = 2048
#: Sequences in a record batch.
BATCH = 256
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "bucket int, path string, documents bigint, tokens bigint, sequences bigint"


def ids_schema(width: int, ids: int) -> pa.Schema:
    """Columns of a file for a vocabulary of `ids` ids."""
    return pa.schema([("ids", pa.list_(pa.uint16() if ids <= 1 << 16 else pa.uint32(), width)), ("mask", pa.list_(pa.bool_(), width))])


class StreamFile:
    """Writer of one file and its index; memory is one record batch."""

    def __init__(self, folder: str, width: int, ids: int = 1 << 32) -> None:
        self.system, root = fs.FileSystem.from_uri(folder)
        self.system.create_dir(root, recursive=True)
        self.path, self.width, self.schema = f"{root}/{uuid.uuid4().hex}.arrow", width, ids_schema(width, ids)
        self.out = self.system.open_output_stream(self.path)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.waiting, self.held, self.tokens, self.sequences, self.index = [], 0, 0, 0, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.index.append((doc_id, self.tokens, n))
        self.tokens += n
        self.held += n
        self.waiting.append(ids)
        if self.held >= self.width * BATCH:
            self._write(self.held // self.width * self.width)

    def _write(self, count: int) -> None:
        flat = np.frombuffer(b"".join(self.waiting), "<u4")
        ids, rest = flat[:count], flat[count:]
        mask = np.ones(-(-len(ids) // self.width) * self.width, bool)
        mask[len(ids) :] = False
        ids = np.concatenate((ids, np.zeros(len(mask) - len(ids), "<u4"))).astype(self.schema.field("ids").type.value_type.to_pandas_dtype())
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.width) for x in (ids, mask)]
        self.writer.write_table(pa.Table.from_arrays(lists, schema=self.schema), max_chunksize=BATCH)
        self.sequences += len(mask) // self.width
        self.waiting, self.held = [rest.tobytes()], len(rest)

    def close(self) -> tuple[str, int, int, int]:
        if self.held:
            self._write(self.held)
        self.writer.close()
        self.out.close()
        with self.system.open_output_stream(f"{self.path}.index") as out, pa.ipc.new_file(out, INDEX) as index:
            columns = list(zip(*self.index, strict=True)) or [[], [], []]
            index.write_table(pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=INDEX))
        return self.path, len(self.index), self.tokens, self.sequences


def sequence(reader: pa.ipc.RecordBatchFileReader, number: int, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of one sequence of an open file; ids are not copied when the file is mapped (bits of the mask are unpacked)."""
    got = reader.get_batch(number // batch)
    ids, mask = (got.column(i).slice(number % batch, 1).flatten() for i in (0, 1))
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def _write(folder: str, tokenizer: str, end: bytes, width: int):
    schema = pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("sequences", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at, to_ids = None, None, encoder(tokenizer, "byte")

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (at, *file.close()), strict=True))], schema=schema)

        for batch in batches:
            for bucket, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text")), strict=True):
                if bucket != at:
                    if file:
                        yield close()
                    file, at = StreamFile(folder, width, to_ids.ids), bucket
                file.add(doc_id, to_ids(text or "") + end)
        if file:
            yield close()

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, width: int = WIDTH, files: int | None = None) -> DataFrame:
    """Write all rows of `docs` (doc_id, text) below `folder`; the manifest (MANIFEST and first: ids of all files before)."""
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or default_tokenizer("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files = files or 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cut = id_splitters(rows, "doc_id", files)
    placed = rows.withColumn("bucket", bucket_of(F.col("doc_id"), cut)).repartition("bucket").sortWithinPartitions("bucket", "doc_id", "text")
    written = placed.mapInArrow(_write(folder, path, end_id.to_bytes(4, "little"), width), MANIFEST)
    # a row a file: one table file holds them all, not one for each writing task
    manifest = materialise(written.repartition(1), "manifest")
    # a row a file, at most `files`: the ids before each are summed over the manifest, not over documents
    before = F.sum("tokens").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("first", F.coalesce(before, F.lit(0)).cast("bigint"))


def _read(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with system.open_input_file(f"{path}.index") as file:
                    index = pa.ipc.open_file(file).read_all()
                with system.open_input_file(path) as file:
                    reader = pa.ipc.open_file(file)
                    at, base, have = 0, 0, np.zeros(0, "<u4")
                    out: list[tuple] = []
                    for doc_id, start, n in zip(*(index.column(c).to_pylist() for c in INDEX.names), strict=True):
                        while base + len(have) < start + n:
                            got = reader.get_batch(at)
                            ids = got.column("ids").flatten().to_numpy()[: got.column("mask").flatten().true_count].astype("<u4")
                            have, base, at = np.concatenate((have[start - base :], ids)), start, at + 1
                        out.append((doc_id, first + start, n, have[start - base : start - base + n].tobytes()))
                        if len(out) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (packed) of every document, read from the files."""
    spark = manifest.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return manifest.select("path", "first").repartition(width, "path").mapInArrow(_read(folder), "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_files_folder(spark: SparkSession) -> str:
    return workspace(spark, "tokens")
