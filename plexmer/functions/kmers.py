"""K-mer expressions: extraction, canonical form, base-4 identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters of the digits 0 to 3, and complements.
DIGIT_LETTERS = "ACTG"
COMPLEMENT = ("ACGT", "TGCA")
#: Longest k whose identifiers fit a bigint.
LONGEST = 31
#: Windows that are cut from one piece of a long sequence.
PIECE = 256


def kmers(seq: Column, k: int) -> Column:
    """All windows of k letters; empty for shorter sequences; windows never hold other letters than ACGT."""
    if not 1 <= k <= LONGEST:
        raise ValueError(f"k must be from 1 to {LONGEST}")
    # substring() counts from the start of its text, so long sequences are cut into short overlapping pieces first
    runs = F.filter(F.split(seq, "[^ACGT]+"), lambda s: F.length(s) >= k)
    pieces = F.flatten(F.transform(runs, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - k + 1, F.lit(PIECE)), lambda i: F.substring(s, i, F.lit(PIECE + k - 1)))))
    return F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - k + 1), lambda i: F.substring(p, i, F.lit(k)))))


def reverse_complement(kmer: Column) -> Column:
    return F.reverse(F.translate(kmer, *COMPLEMENT))


def canonical(kmer: Column) -> Column:
    """The lesser, by letters, of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def encode(kmer: Column) -> Column:
    """Base-4 number of a k-mer; a letter outside A, C, T counts as G."""
    return F.conv(F.translate(F.regexp_replace(kmer, "[^ACT]", "G"), DIGIT_LETTERS, "0123"), 4, 10).cast("bigint")


def decode(number: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0"), "0123", DIGIT_LETTERS)


def fold_text(text: Column) -> Column:
    """Any text as a DNA sequence: its letters a to z, each folded to one of four."""
    folded = "".join("ACTG"[i % 4] for i in range(26))
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", folded)
