"""Substring dedup by repeated-phrase automata.

A word is removed when it lies in a window of `window` words whose word sequence
also starts anywhere else in the corpus.  Steps:

1. one pass writes each text's words count, content key and *anchors*: in every
   window the leftmost smallest hash of `gram` consecutive words.  Equal windows
   choose the same anchor, so a window recurs only if its anchor's gram does.
   Texts with equal word sequences are one class from here on: all their windows
   recur;
2. grams that occur at least twice are found in one sorted pass over the distinct grams of each
   `UNIT` rows, so a gram of many texts is few rows;
3. around each of their occurrences the stretch of words whose windows chose it is written out.  The hashes (128 bits) of its windows are
   counted over all stretches, with sums before the shuffle; the windows counted twice or more are confirmed, and the first
   stretch that holds one gives its words.  Neighbouring windows that occur in the same places everywhere (told by a
   64-bit sum over their places) are merged into one phrase, others are phrases of their own, so that a text which
   holds a part of a passage is found as well;
4. phrases are dealt to shards by their anchor's gram, `PHRASES` to an automaton, and each shard's are compiled into
   Aho-Corasick automata over words (pyahocorasick).  All stretches are streamed through the automata of their gram's shard,
   which decide, word by word, where each phrase occurs.  A shard with many stretches is
   streamed in several tasks, each with the automaton; one with too many phrases has several automata, which all its stretches pass;
5. the windows found mark the words to remove.

A text without a recurring gram holds no phrase, so only the others are streamed.  Windows are judged on the input, never on what is
left.

Defined cases: null or wordless texts have no words and keep the digest of the empty
text; texts shorter than a window lose nothing; very long texts are read whole; repeated rows are repeats of one
another; null doc_ids are kept as they are; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import column, drop_folder, materialise, materialise_at, run_bounds, shuffle_width, small_batches
from ._words import mix, rolling_hashes, slices, word_hashes, word_spans

WINDOW = 35
GRAM = 10
#: Rows of the scan, by their numbers, for which a gram is counted at once; a power of two.
UNIT = 1024
#: Phrases of an automaton, at most about (60 MB).
PHRASES = 20_000
#: Stretches streamed by a task through one automaton, about.
STRETCHES = 20_000
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of each window's anchor, hash of the gram at every position)."""
    grams = rolling_hashes(words, gram)
    if len(words) < window:
        return np.zeros(0, np.int64), grams
    near = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    return np.arange(len(near)) + near.argmin(axis=1), grams


def _word_hashes(array: pa.Array) -> Iterator[np.ndarray]:
    for _, raw, offs in slices(array):
        starts, ends, first = word_spans(raw, offs)
        hashes = word_hashes(raw, starts, ends, lower=False)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield hashes[a:b]


def joined(text: str | None) -> bytes:
    return b" ".join((text or "").encode().split())


def _scan(window: int, gram: int):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int64()), ("key", pa.binary()), ("grams", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])

    def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else [], kind))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, grams, places = [], [], []
            for words in _word_hashes(batch.column("text")):
                at, hashes = anchors(words, window, gram)
                at = at[np.flatnonzero(np.diff(at, prepend=-1))]
                sizes.append(len(words))
                # of neighbouring anchors with one gram two tell that it recurs; the others are found again from them
                again = np.concatenate(([False], (np.diff(at) == 1) & (hashes[at[1:]] == hashes[at[:-1]]))) if len(at) else np.zeros(0, bool)
                at = at[~(again & np.concatenate(([False], again[:-1])))]
                grams.append(hashes[at].view(np.int64))
                places.append(at.astype(np.int32))
            keys = [hashlib.sha256(joined(t)).digest() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists(grams, pa.int64()), lists(places, pa.int32())], schema=schema)

    return run


def _unit_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams of each unit in a batch, with their numbers."""
    schema = pa.schema([("gram", pa.int64()), ("unit", pa.int64()), ("n", pa.int32())])
    for batch in batches:
        lists = batch.column("grams")
        gram = lists.flatten().to_numpy(zero_copy_only=False)
        unit = np.repeat(column(batch, "unit"), np.diff(lists.offsets.to_numpy()))
        if len(gram):
            order = np.lexsort((gram, unit))
            gram, unit = gram[order], unit[order]
            at = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (unit[1:] != unit[:-1]))))
            yield pa.RecordBatch.from_arrays([pa.array(gram[at]), pa.array(unit[at]), pa.array(np.diff(np.append(at, len(gram))).astype(np.int32))], schema=schema)


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram -> gram and unit of those whose gram occurs at least twice; one row is held between batches."""
    held, seen = None, False  # the last row, and whether the one before it was equal
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([held, batch] if held is not None else [batch])
        grams = column(table, "gram")
        same = grams[1:] == grams[:-1]
        keep = np.concatenate(([seen if held is not None else False], same)) | np.concatenate((same, [False])) | (column(table, "n") > 1)
        found = keep.copy()
        found[-1] = False  # decided with the next row
        if found.any():
            yield from table.filter(pa.array(found)).select(["gram", "unit"]).combine_chunks().to_batches()
        seen = bool(keep[-1])
        held = batch.slice(batch.num_rows - 1)
    if held is not None and seen:
        yield held.select(["gram", "unit"])


def _wanted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by unit, first the grams that recur in it (rid null), then its texts -> places of recurring grams in each text."""
    schema = pa.schema([("cid", pa.int64()), ("places", pa.list_(pa.int32()))])
    unit, grams = None, np.zeros(0, np.int64)
    for batch in batches:
        bounds = run_bounds(column(batch, "unit"))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            if part.column("rid")[0].as_py() is None:
                unit, grams = part.column("unit")[0].as_py(), part.column("grams")[0].values.to_numpy(zero_copy_only=False)
                part = part.slice(1)
            if not part.num_rows or part.column("unit")[0].as_py() != unit:
                continue
            places = part.column("places")
            found = np.isin(part.column("grams").flatten().to_numpy(zero_copy_only=False), grams)
            ends = np.concatenate(([0], np.cumsum(found)))[places.offsets.to_numpy() - places.offsets[0].as_py()]
            some = np.flatnonzero(np.diff(ends))
            if len(some):
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places.flatten().to_numpy(zero_copy_only=False)[found]))
                yield pa.RecordBatch.from_arrays([part.column("rid").take(some), lists.take(some)], schema=schema)


def _stretches(window: int, gram: int):
    schema = pa.schema([("gram", pa.int64()), ("cid", pa.int64()), ("start", pa.int32()), ("words", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for cid, text, wanted, words in zip(batch.column("cid").to_pylist(), batch.column("text").to_pylist(), batch.column("places").to_pylist(), _word_hashes(batch.column("text")), strict=True):
                at, grams = anchors(words, window, gram)
                pieces = text.encode().split()
                chosen = np.zeros(len(grams) + 1, bool)
                chosen[at] = True
                done = -1
                for place in wanted:
                    if place <= done:
                        continue
                    # neighbouring anchors of one gram (a text that repeats a word) share a stretch
                    done = place
                    while chosen[done + 1] and grams[done + 1] == grams[place]:
                        done += 1
                    low, high = np.searchsorted(at, place), np.searchsorted(at, done, "right")
                    if high > low:
                        out.append((int(grams[place].view(np.int64)), cid, int(low), b" ".join(pieces[low : high - 1 + window]).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _turned(marks: np.ndarray, by: np.ndarray) -> np.ndarray:
    """64-bit marks turned left by so many bits."""
    by = (by % 64).astype(np.uint64)
    return (marks << by) | (marks >> (np.uint64(63) - by) >> np.uint64(1))


def window_hashes(array: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of every window of the texts: the text's number, the window's in it, and two 64-bit hashes; some texts at a time."""
    for at, raw, offs in slices(array):
        starts, ends, first = word_spans(raw, offs)
        words = word_hashes(raw, starts, ends, lower=False)
        counts = np.maximum(np.diff(first) - window + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = first[:-1][text] + within
        yield at + text, within, rolling_hashes(words, window)[place], rolling_hashes(mix(words), window)[place]


def _windows(window: int):
    """Distinct windows of a batch of stretches, with their numbers, the least stretch that holds each, and a sum (exclusive or) over their places."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()), ("sid", pa.int64()), ("places", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "sid")
            for text, within, h1, h2 in window_hashes(batch.column("words"), window):
                if not len(text):
                    continue
                order = np.lexsort((h2, h1))
                h1, h2, sid = h1[order], h2[order], ids[text[order]]
                places = _turned(mix(sid.astype(np.uint64) + np.uint64(1)), within[order])
                at = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
                yield pa.RecordBatch.from_arrays([pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), pa.array(np.diff(np.append(at, len(h1))).astype(np.int32)), pa.array(np.minimum.reduceat(sid, at)), pa.array(np.bitwise_xor.reduceat(places, at).view(np.int64))], schema=schema)

    return run


def merged(h1: np.ndarray, known: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, last) window of each phrase among a stretch's windows with these hashes; `known`: number and sum of places of the confirmed ones."""
    out: list[tuple[int, int]] = []
    before = None
    for i, h in enumerate(h1.tolist()):
        now = known.pop(h, None)  # a window that comes again is a phrase already
        if now and before and out[-1][1] == i - 1 and now[0] == before[0] and now[1] == (before[1] << 1 | before[1] >> 63) & 0xFFFFFFFFFFFFFFFF:
            out[-1] = (out[-1][0], i)
        elif now:
            out.append((i, i))
        before = now
    return out


def _phrases(window: int):
    """Stretches with the windows they are to give (hash, number, sum of places) -> the words of the phrases these make."""
    schema = pa.schema([("gram", pa.int64()), ("words", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            grams, texts, wanted = (batch.column(c).to_pylist() for c in ("gram", "words", "windows"))
            for text, _, h1, _ in window_hashes(batch.column("words"), window):
                bounds = run_bounds(text)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    i = int(text[a])
                    words, known = texts[i].encode().split(), {w["h"] & 0xFFFFFFFFFFFFFFFF: (w["n"], w["places"] & 0xFFFFFFFFFFFFFFFF) for w in wanted[i]}
                    out += [(grams[i], b" ".join(words[x : y + window]).decode()) for x, y in merged(h1[a:b], known)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


class Phrases:
    """An Aho-Corasick automaton over words; the words of its phrases are numbered."""

    def __init__(self, phrases: Iterable[list[bytes]]) -> None:
        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for words in phrases:
            self.automaton.add_word(tuple(self.number.setdefault(w, len(self.number) + 1) for w in words), len(words))
        self.automaton.make_automaton()

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Where the phrases occur in a text: first word and one past the last."""
        return [(end - n + 1, end + 1) for end, n in self.automaton.iter(tuple(self.number.get(w, 0) for w in words))]


def _located(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by cell (shard, automaton, task), first its phrases (cid null), then stretches -> words of texts that phrases cover, first and one past the last.  One automaton is held."""
    schema = pa.schema([("cid", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
    at, waiting, automaton = None, [], None
    for batch in batches:
        out = []
        for cell, cid, start, text in zip(*(batch.column(c).to_pylist() for c in ("cell", "cid", "start", "words")), strict=True):
            if cell != at:
                at, waiting, automaton = cell, [], None
            words = text.encode().split()
            if cid is None:
                waiting.append(words)
                continue
            if waiting:
                automaton, waiting = Phrases(waiting), []
            found = automaton.spans(words) if automaton else []
            if found:
                out.append((cid, [start + a for a, _ in found], [start + b for _, b in found]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _removed():
    schema = pa.schema([("cid", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cid, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("cid", "text", "starts", "ends")), strict=True):
                words = text.encode().split()
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, np.array(starts), 1)
                np.add.at(step, np.array(ends), -1)
                cover = np.cumsum(step[:-1]) > 0
                bounds = run_bounds(cover)
                spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(bounds[:-1], bounds[1:], strict=True) if cover[a]]
                kept = b" ".join(w for w, c in zip(words, cover.tolist(), strict=True) if not c)
                out.append((cid, spans, int(cover.sum()), hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _streamed(phrases: DataFrame, stretches: DataFrame, width: int) -> DataFrame:
    """(cid, starts, ends) of the phrases (gram, words) in the stretches (gram, cid, start, words)."""
    shards = max(width, -(-2 * phrases.count() // PHRASES))
    shard = F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard")
    size = lambda rows, name, most: rows.select(shard).groupBy("shard").agg(F.ceil(F.count("*") / most).alias(name))
    # a row a shard: how many automata it has, and how many tasks stream through each
    cells = materialise(size(phrases, "automata", PHRASES).join(size(stretches, "tasks", STRETCHES), "shard"), "shards")
    cell = F.xxhash64("shard", "automaton", "task").alias("cell")
    known = phrases.select(shard, "words").join(cells, "shard").withColumn("automaton", F.pmod(F.xxhash64("words"), "automata")).withColumn("task", F.explode(F.expr("sequence(0L, tasks - 1)")))
    texts = stretches.select(shard, "cid", "start", "words").join(cells, "shard").withColumn("automaton", F.explode(F.expr("sequence(0L, automata - 1)"))).withColumn("task", F.pmod(F.xxhash64("cid", "start"), "tasks"))
    rows = known.select(cell, F.lit(None).cast("bigint").alias("cid"), F.lit(0).alias("start"), "words").unionByName(texts.select(cell, "cid", "start", "words"))
    return rows.repartition(width, "cell").sortWithinPartitions("cell", F.col("cid").asc_nulls_first()).mapInArrow(_located, "cid bigint, starts array<int>, ends array<int>")


def repeated_phrases(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed words, by number), kept_sha256 for every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    width = shuffle_width(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    scanned = rows.mapInArrow(_scan(window, gram), "doc_id bigint, mark bigint, n_words bigint, key binary, grams array<bigint>, places array<int>")
    scanned = materialise(scanned.withColumn("rid", F.monotonically_increasing_id()), "scan")
    classes = materialise(scanned.where(F.col("n_words") >= window).groupBy("key").agg(F.min("rid").alias("cid"), F.count("*").alias("copies")), "classes")

    unit = F.expr(f"rid DIV {UNIT}").alias("unit")
    first, first_at = materialise_at(scanned.join(classes.select(F.col("cid").alias("rid")), "rid", "left_semi").select(unit, "rid", "doc_id", "mark", "grams", "places"), "first")
    counted = first.select("unit", "grams").mapInArrow(_unit_grams, "gram bigint, unit bigint, n int")
    repeated = counted.repartition(width, "gram").sortWithinPartitions("gram").mapInArrow(_repeated, "gram bigint, unit bigint")
    recurring = repeated.groupBy("unit").agg(F.collect_set("gram").alias("grams"))  # grams of UNIT rows
    both = recurring.select("unit", F.lit(None).cast("bigint").alias("rid"), "grams", F.expr("CAST(array() AS ARRAY<INT>)").alias("places")).unionByName(first.select("unit", "rid", "grams", "places"))
    wanted = both.repartition(width, "unit").sortWithinPartitions("unit", F.col("rid").asc_nulls_first()).mapInArrow(_wanted, "cid bigint, places array<int>").join(first.select(F.col("rid").alias("cid"), "doc_id", F.col("mark").alias("own")), "cid")

    texts = rows.withColumnRenamed("doc_id", "id").join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("mark") == F.col("own")))
    texts = materialise(texts.select("cid", "text", "places"), "candidates")
    drop_folder(spark, first_at)
    stretches = texts.mapInArrow(_stretches(window, gram), "gram bigint, cid bigint, start int, words string")
    stretches, stretches_at = materialise_at(stretches.withColumn("sid", F.monotonically_increasing_id()), "stretches")
    counted = stretches.select("sid", "words").mapInArrow(_windows(window), "h1 bigint, h2 bigint, n int, sid bigint, places bigint").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("sid").alias("sid"), F.bit_xor("places").alias("places"))
    confirmed = counted.where("n > 1").groupBy("sid").agg(F.collect_list(F.struct(F.col("h1").alias("h"), "n", "places")).alias("windows"))  # windows of one stretch
    phrases, phrases_at = materialise_at(stretches.select("sid", "gram", "words").join(confirmed, "sid").select("gram", "words", "windows").mapInArrow(_phrases(window), "gram bigint, words string"), "phrases")
    found = materialise(_streamed(phrases, stretches, width), "found")
    drop_folder(spark, stretches_at)
    drop_folder(spark, phrases_at)
    found = found.groupBy("cid").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    removed = texts.select("cid", "text").join(found, "cid").mapInArrow(_removed(), "cid bigint, spans array<struct<first: int, last: int>>, n_removed bigint, kept_sha256 string")
    removed = removed.dropDuplicates(["cid"])

    named = classes.select("key", "cid", "copies").join(removed, "cid", "left").drop("cid")
    whole = F.col("copies") > 1
    every = F.expr("array(named_struct('first', 0, 'last', CAST(n_words - 1 AS INT)))")
    return scanned.select("doc_id", "n_words", "key").join(named, "key", "left").select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, every).otherwise(F.coalesce("spans", F.expr("CAST(array() AS ARRAY<STRUCT<first: INT, last: INT>>)"))).alias("spans"),
        F.when(whole, F.lit(EMPTY_SHA256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256"),
    )
