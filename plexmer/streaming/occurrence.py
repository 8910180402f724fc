"""Running occurrence counters over a stream of individuals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.runs import occurrences


def running_occurrences(individuals: DataFrame) -> DataFrame:
    """The batch operator on a stream (kmers, score): write it in update or complete mode; state is a row a k-mer."""
    return occurrences(individuals)
