"""Cleaning of reads: quality, adapters, clipping, length; expressions and one vectorised pass, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Adapters by kit.
ADAPTERS = {"illumina": "AGATCGGAAGAGC", "nextera": "CTGTCTCTTATA", "small_rna": "TGGAATTCTCGG"}


def quality_end(qual: str, cutoff: int = 20, base: int = 33) -> int:
    """Length kept: where the sum of (cutoff - quality) from the 3' end is largest, up to its first negative value."""
    total = np.cumsum(cutoff - (np.frombuffer(qual.encode("latin-1"), np.uint8)[::-1].astype(int) - base))
    stop = np.flatnonzero(total < 0)
    total = total[: stop[0]] if len(stop) else total
    return len(qual) - (int(np.argmax(total)) + 1 if len(total) and total.max() > 0 else 0)


def adapter_start(seq: str, adapter: str, error: float = 0.1, overlap: int = 1) -> int:
    """Where the adapter, or a beginning of it at the read's end, first matches with at most `error` of its letters wrong."""
    for i in range(len(seq) - overlap + 1):
        part = seq[i : i + len(adapter)]
        if sum(a != b for a, b in zip(part, adapter)) <= int(error * len(part)):
            return i
    return len(seq)


def detect_adapter(reads: DataFrame, default: str = "illumina") -> str:
    """The kit whose adapter most reads hold; all reads are counted, in one pass."""
    row = reads.agg(*(F.sum(F.col("seq").contains(a).cast("bigint")).alias(name) for name, a in ADAPTERS.items())).first()
    best = max(ADAPTERS, key=lambda name: row[name] or 0)
    return best if row[best] else default


def trim(reads: DataFrame, adapter: str | None = None, cutoff: int = 20, clip5: int = 0, clip3: int = 0) -> DataFrame:
    """(seq, qual, ...) with clipped ends, low quality and adapter gone; other columns stay.  Null reads become empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seq, qual = [], []
            for s, q in zip(frame["seq"].fillna(""), frame["qual"].fillna(""), strict=True):
                end = quality_end(q, cutoff)
                end = adapter_start(s[:end], adapter) if adapter else end
                seq.append(s[:end])
                qual.append(q[:end])
            yield frame.assign(seq=seq, qual=qual)

    cut = reads.mapInPandas(run, reads.schema)
    keep = F.greatest(F.lit(0), F.length("seq") - clip5 - clip3)
    return cut.withColumns({"seq": F.col("seq").substr(F.lit(clip5 + 1), keep), "qual": F.col("qual").substr(F.lit(clip5 + 1), keep)}) if clip5 or clip3 else cut


def long_enough(reads: DataFrame, shortest: int = 20, by: list[str] | None = None) -> DataFrame:
    """Reads of at least `shortest` letters; with `by` (the columns that pair mates), all mates must be."""
    if not by:
        return reads.where(F.length("seq") >= shortest)
    short = reads.where(F.coalesce(F.length("seq"), F.lit(0)) < shortest).select(*by).distinct()
    return reads.join(short, by, "left_anti")


def position_quality(reads: DataFrame, base: int = 33) -> DataFrame:
    """(pos, mean quality, n) of all reads."""
    cells = reads.select(F.posexplode(F.split("qual", "")).alias("pos", "letter")).where("letter <> ''")
    return cells.groupBy("pos").agg((F.avg(F.ascii("letter")) - base).alias("quality"), F.count("*").alias("n"))
