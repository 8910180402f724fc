"""Harmonic packing of documents into fixed-size sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of more than
``capacity / (k + 1)`` and at most ``capacity / k`` tokens.  Every bin of class k is filled by a
fixed number of documents: k whole ones and the head of one more, which always reaches the
end, as k + 1 pieces of the class are longer than the capacity (k pieces that
fill it exactly need no head).  The cut-off tail is a shorter piece, and goes to
the class of its own length.  Documents of at least the capacity give whole sequences first.
So a sequence costs one cut, needs no padding, and a bin never waits for a piece that fits.

Every worker fills its own bins: no shuffle.  What its open bins hold at the end, less than the
capacity for each class (some 90 classes at 2048), is strung together into full sequences,
and the last rest is cut at powers of two.  The number of a sequence is made of the partition's number
and a running one, so a task that is run again gives the same rows.

Defined cases: null text is an empty document of one token (the end id); a very
long document has many whole sequences; repeated rows are packed one by one; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, small_batches
from ._tokens import default_tokenizer, encoder

CAPACITY = 2048
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint"


#: A piece: doc_id, start, ids of the piece, tokens of its document.
Piece = tuple[int | None, int, bytes, int]


def tokens(piece: Piece) -> int:
    return len(piece[2]) // 4


def split(piece: Piece, size: int) -> tuple[Piece, Piece]:
    """A piece's first `size` tokens at most, and the rest."""
    doc_id, start, ids, total = piece
    size = min(size, len(ids) // 4)
    return (doc_id, start, ids[: 4 * size], total), (doc_id, start + size, ids[4 * size :], total)


class HarmonicBins:
    """The open bins of one worker, one for each class."""

    def __init__(self, capacity: int, first_sequence: int) -> None:
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list[Piece]] = {}

    def put(self, doc_id: int | None, ids: bytes) -> Iterator[list[tuple]]:
        """The sequences that a document fills: each a list of (piece, sequence, offset, sequence length)."""
        total, whole = len(ids) // 4, len(ids) // 4 // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            yield self._close([(doc_id, start, ids[4 * start : 4 * (start + self.capacity)], total)])
        piece = (doc_id, whole, ids[4 * whole :], total)
        while size := tokens(piece):
            k = self.capacity // size
            waiting = self.open.setdefault(k, [])
            room = self.capacity - sum(map(tokens, waiting))
            if size < room:
                waiting.append(piece)
                return
            head, piece = split(piece, room)
            yield self._close([*waiting, head])
            self.open[k] = []

    def _close(self, pieces: list[Piece]) -> list[tuple]:
        sequence, self.next = self.next, self.next + 1
        length, at, out = sum(map(tokens, pieces)), 0, []
        for p in pieces:
            out.append((p, sequence, at, length))
            at += tokens(p)
        return out

    def finish(self) -> Iterator[list[tuple]]:
        """The open bins strung together: full sequences, then one for each binary digit of the rest."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(map(tokens, left))
        sizes = [self.capacity] * (total // self.capacity) + [1 << i for i in range(self.capacity.bit_length() - 2, -1, -1) if total % self.capacity >> i & 1]
        left.reverse()
        for size in sizes:
            pieces = []
            while size:
                head, tail = split(left.pop(), size)
                pieces.append(head)
                size -= tokens(head)
                if tokens(tail):
                    left.append(tail)
            yield self._close(pieces)


def _pack(encode: Callable[[], Callable[[str], bytes]], end: bytes, capacity: int):
    schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length")])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        full = [(doc_id, start, len(ids) // 4, ids, total, sequence, offset, length) for (doc_id, start, ids, total), sequence, offset, length in done]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*full, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, to_ids = HarmonicBins(capacity, TaskContext.get().partitionId() << 33), encode()
        done: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for closed in bins.put(doc_id, to_ids(text or "") + end):
                    done += closed
            if len(done) > 2000:
                yield rows(done)
                done = []
        for closed in bins.finish():
            done += closed
        if done:
            yield rows(done)

    return run


def harmonic_pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece (see SCHEMA; ids: packed little-endian unsigned 32-bit) for all rows of `docs` (doc_id, text)."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_pack(lambda: encoder(path, "word"), end_id.to_bytes(4, "little"), capacity), (path, "word")), SCHEMA)
