"""Running head lists: each bound's best k-mers by views so far, without a row for each k-mer and bound."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Bin of what has no iteration, after all others.
LATE = 1 << 53


def best(entries: dict[int, int], top: int) -> dict[int, int]:
    """The `top` k-mers by views; ties go to the smaller k-mer."""
    return dict(heapq.nsmallest(top, entries.items(), key=lambda x: (-x[1], x[0])))


def _scan(top: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The head list after each bin of one run and span, from (run, span, bin, kmer_id, nview); bins of null came before the span."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        carried = frame["bin"].isna()
        held: dict[int, int] = {}
        for k, n in zip(frame["kmer_id"][carried], frame["nview"][carried]):
            held[k] = max(n, held.get(k, 0))
        held, out = best(held, top), []
        for bin, rows in frame[~carried].groupby("bin"):
            held = best(held | dict(zip(rows["kmer_id"], rows["nview"])), top)  # a later count is never smaller
            out += [(int(bin), k, n) for k, n in held.items()]
        return pd.DataFrame(out, columns=["bin", "kmer_id", "nview"]).assign(run=frame["run"].iloc[0])[["run", "bin", "kmer_id", "nview"]]

    return run


def views(individuals: DataFrame, step: int, run: str | None = None) -> DataFrame:
    """(run, bin, kmer_id, n): views by bins of `step` iterations, the first one open below; those without an iteration are in bin `LATE`."""
    bin = F.greatest(F.ceil(F.col("iter") / step).cast("bigint"), F.lit(1))
    bin = F.when(F.col("iter").isNull(), F.lit(LATE)).otherwise(bin).cast("bigint")
    rows = individuals.select((F.col(run) if run else F.lit(0)).alias("run"), bin.alias("bin"), F.explode("kmers").alias("kmer_id"))
    return rows.groupBy("run", "kmer_id", "bin").agg(F.count("*").alias("n"))


def final(heads: DataFrame) -> DataFrame:
    """(run, kmer_id) of each run's last head list."""
    last = heads.groupBy("run").agg(F.max(F.struct("bin")).alias("l")).select("run", F.col("l.bin").alias("bin"))
    return heads.join(F.broadcast(last), ["run", "bin"]).select("run", "kmer_id")


def _kept(df: DataFrame) -> DataFrame:
    """`df`, found once: in the checkpoint folder, or with the executors where none is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def running_heads(views: DataFrame, top: int) -> DataFrame:
    """(run, bin, kmer_id, n), n views of a k-mer in a bin from 1 -> (run, bin, kmer_id, nview), the `top` k-mers after every bin that a run has.

    Views only add up, so a k-mer enters a head list only in a bin that views it, and only as one of the best `top` of those the
    bin views: no other row is kept.  Spans of about the square root of all bins are then gone through side by side.  The best of
    all spans before, by their last counts, are where a span starts: the `top` of a whole are among the `top` of its parts.
    """
    order = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("nview"), "kmer_id"))
    running = views.select("run", "kmer_id", "bin", F.sum("n").over(Window.partitionBy("run", "kmer_id").orderBy("bin")).alias("nview"))
    events = _kept(running.withColumn("r", order("run", "bin")).where(F.col("r") <= top).select("run", "bin", "kmer_id", "nview"))
    width = max(1, math.isqrt(events.where(F.col("bin") < LATE).agg(F.max("bin")).first()[0] or 1))
    events = events.select("run", F.expr(f"(bin - 1) DIV {width}").alias("span"), "bin", "kmer_id", "nview")
    summary = events.groupBy("run", "span", "kmer_id").agg(F.max("nview").alias("nview")).withColumn("r", order("run", "span")).where(F.col("r") <= top).drop("r")
    later = events.select("run", F.col("span").alias("to")).distinct()  # about `width` rows a run
    carried = summary.join(F.broadcast(later), "run").where("span < to").select("run", F.col("to").alias("span"), F.lit(None).cast("bigint").alias("bin"), "kmer_id", "nview")
    run_type = views.schema["run"].dataType.simpleString()
    return events.unionByName(carried).groupBy("run", "span").applyInPandas(_scan(top), f"run {run_type}, bin bigint, kmer_id bigint, nview bigint")
