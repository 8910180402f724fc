"""Toxicity by maximum-scoring segments.

Words, and word beginnings, get log-odds between toxic and other labelled training documents, with a
Dirichlet prior that follows the overall word frequencies (Monroe, Colaresi and
Quinn, 2008).  Words whose log-odds are `Z_MIN` standard errors or more from 0 score them: positive for words that lean to the toxic
side, negative for those that lean to the other.  A piece of text has the log-odds of its word or beginning
that says most; if these are positive, its n-th occurrence in a text adds 1 / n**2 of them; and every word pays `PENALTY`, so that scores of
other text fall.  All maximal scoring segments of a text are found in one linear scan (Ruzzo and Tompa, 1999).

The best segment of n background words follows an extreme-value law
``P(S >= x) = 1 - exp(-K n exp(-lambda x))`` (Karlin and Altschul, 1990).  lambda and K are fitted by maximum likelihood to the best
segments of training documents that are not toxic: those of one fold, under log-odds learnt without that
fold.  Segments whose expected number by chance is below `SIGNIFICANT` are toxic passages, and
their log-odds against chance add up to a document's evidence.  A logistic curve
fitted on training rows turns evidence into a score from 0 to 1.

Only rows whose ``crc32(doc_id as text) mod 5`` is not 0 teach, `TRAINING_ROWS` at most; labels, lang, source and
doc_id are never inputs of a score.  The log-odds are those of words of these rows, so their number is bounded with them.

Defined cases: null or empty text has no evidence and scores like any text without
it; very long texts are read whole; null labels teach nothing, conflicting labels of one document count as toxic; rows that repeat a doc_id are
scored one by one, and each teaches; null doc_ids are scored and teach nothing;
without training rows of both labels every score is 0; where no row is in the calibration fold, or none there has a
scoring word, lambda is 1 and K is 1 over its words; other columns are ignored but those asked for; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import lean, materialise, small_batches

#: Words of one worker's counter before it is passed on.
COUNTER_WORDS = 200_000
#: Standard errors that the log-odds of a scoring word are from 0, at least.
Z_MIN = 3.0
#: What every word pays at least.
PENALTY = 0.5
#: The fold of training rows that lambda and K are fitted to.
CALIBRATION = 4
#: Strength of the prior, in documents' worth of words.
PRIOR = 200.0
#: Expected number of chance segments below which a segment is significant.
SIGNIFICANT = 0.05
#: Labelled rows that teach, at most: those lowest by a hash of their id.  The bound also makes their broadcast safe.
TRAINING_ROWS = 20_000


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each word, by label and whether they are for calibration; the word null counts documents, the empty one their words."""
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int32()), ("apart", pa.bool_()), ("n", pa.int64())])

    def out(counts: Counter) -> pa.RecordBatch:
        columns = [*zip(*counts, strict=True), list(counts.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    counts: Counter = Counter()
    for batch in batches:
        for text, toxic, apart in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "apart")), strict=True):
            words = chunks(text)
            counts[None, toxic, apart] += 1
            counts["", toxic, apart] += len(words)
            counts.update([(f, toxic, apart) for f in {f for w in {*words} for f in features(w)}])
        if len(counts) > COUNTER_WORDS:
            yield out(counts)
            counts = Counter()
    if counts:
        yield out(counts)


_STRIP = "\"'.,;:!?()[]{}<>*#%&$|-_"
#: Lengths of word beginnings that count as features, for languages that inflect and compound.
STEMS = (3, 4, 5, 6)


def chunks(text: str | None) -> list[bytes]:
    """Lower-case pieces between ASCII white space."""
    return (text or "").lower().encode().split()


def features(chunk: bytes) -> list[str]:
    """A piece's word without surrounding punctuation, and its beginnings, marked with a star."""
    word = chunk.decode().strip(_STRIP)
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)] if word else []


class Scores(dict):
    """Log-odds of a piece: those of its features that are furthest from 0, 0 for none; remembers what it has seen."""

    def __init__(self, model: dict[str, float], most: int = 150_000) -> None:
        self.model, self.most = model, most

    def __missing__(self, chunk: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        score = self[chunk] = max((self.model[f] for f in features(chunk) if f in self.model), key=abs, default=0.0)
        return score

    def hits(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(place, score) of the words that score; the n-th occurrence of one with a positive score has 1 / n**2 of it."""
        out, seen = [], {}
        for i, s in enumerate(map(self.__getitem__, words)):
            if s > 0:
                n = seen[words[i]] = seen.get(words[i], 0) + 1
                out.append((i, s / (n * n)))
            elif s:
                out.append((i, s))
        return out


def log_odds(toxic: Column, other: Column, n1: float, n0: float) -> Column:
    """Log-odds of a word in that many of n1 toxic and n0 other documents, 0 where they are not significant."""
    prior = F.lit(PRIOR) * (toxic + other) / F.lit(n1 + n0)
    a, b = toxic + prior, other + prior
    odds = F.log(a / F.greatest(F.lit(n1 + PRIOR) - a, F.lit(0.5))) - F.log(b / F.greatest(F.lit(n0 + PRIOR) - b, F.lit(0.5)))
    return F.when(F.abs(odds) >= Z_MIN * F.sqrt(1 / a + 1 / b), odds).otherwise(0.0)


def learn_words(train: DataFrame) -> tuple[dict[str, float], dict[str, float], float]:
    """(log-odds of words, those learnt without the calibration fold, what every word pays) from `train` (text, toxic, apart)."""
    column = lambda toxic, apart: F.sum(F.expr(f"IF(toxic = {toxic} AND apart = {apart}, n, 0L)"))
    counts = train.mapInArrow(lean(_count), "word string, toxic int, apart boolean, n bigint").groupBy("word").agg(column(1, False).alias("y1"), column(0, False).alias("y0"), column(1, True).alias("z1"), column(0, True).alias("z0"))
    counts = materialise(counts, "words")
    totals = {r["word"]: r for r in counts.where("word IS NULL OR word = ''").collect()}
    docs = totals.get(None)
    if docs is None or not docs["y1"] + docs["z1"] or not docs["y0"] + docs["z0"]:
        return {}, {}, PENALTY
    y1, y0, z1, z0 = (F.col(c) for c in ("y1", "y0", "z1", "z0"))
    whole = log_odds(y1 + z1, y0 + z0, docs["y1"] + docs["z1"], docs["y0"] + docs["z0"])
    apart = log_odds(y1, y0, docs["y1"], docs["y0"]) if docs["y1"] and docs["y0"] else whole
    # a word needs several documents to keep log-odds, so these are few beside the words of the training rows
    found = counts.where("word <> ''").select("word", (y0 + z0).alias("other"), whole.alias("whole"), F.when(y1 + y0 > 0, apart).otherwise(0.0).alias("apart")).where("whole <> 0 OR apart <> 0").collect()
    chance = sum(r["other"] * max(0.0, r["whole"]) for r in found) / max(1, totals[""]["y0"] + totals[""]["z0"])
    return {r["word"]: r["whole"] for r in found if r["whole"]}, {r["word"]: r["apart"] for r in found if r["apart"]}, max(PENALTY, 2 * chance)


def maximal_segments(hits: list[tuple[int, float]], penalty: float) -> list[tuple[float, int, int]]:
    """Ruzzo-Tompa over sparse hits (position, score); every word pays `penalty`.

    (score, first word, one past the last word) of every maximal scoring segment, in order; linear time.
    """
    stack: list[tuple[float, float, int, int]] = []  # cumulated score before and after, first and end position
    total, at = 0.0, 0
    for position, score in hits:
        total -= penalty * (position - at)
        left, total, at = total, total + score - penalty, position + 1
        if total <= left:
            continue
        first, right = position, total
        while True:
            # the nearest segment before that starts lower, looking back past those that start no lower
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, at))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(r - l, a, b) for l, r, a, b in stack]


def extreme_values(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """lambda and K of ``P(S < x) = exp(-K n exp(-lambda x))`` by maximum likelihood, from best scores and numbers of words; a score of 0 stands for none above it."""
    seen, words = best > 0, np.maximum(words, 1).astype(float)
    n = int(seen.sum())
    if not n:
        return 1.0, 1 / max(1.0, float(words.sum()))
    rate = lambda lam: n / float((words * np.exp(-lam * best)).sum())  # the best K for a lambda
    likelihood = lambda lam: n * (math.log(lam) + math.log(rate(lam))) - lam * float(best[seen].sum())
    low, high = math.log(0.01), math.log(50.0)
    for _ in range(60):  # golden sections; the likelihood has one peak
        a, b = high - (high - low) * 0.618, low + (high - low) * 0.618
        low, high = (low, b) if likelihood(math.exp(a)) > likelihood(math.exp(b)) else (a, high)
    lam = math.exp((low + high) / 2)
    return lam, rate(lam)


def _best(model: dict[str, float], penalty: float):
    schema = pa.schema([("best", pa.float64()), ("words", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for batch in batches:
            texts = [chunks(t) for t in batch.column("text").to_pylist()]
            best = [max((s for s, _, _ in maximal_segments(scores.hits(words), penalty)), default=0.0) for words in texts]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return run


def _evidence(model: dict[str, float], penalty: float, lam: float, k: float, also: tuple[str, ...] = ()):
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in also), ("evidence", pa.float64()), ("passages", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("log_odds", pa.float64())])))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for batch in batches:
            evidence, passages = [], []
            for text in batch.column("text").to_pylist():
                tokens = chunks(text)
                total, found = 0.0, []
                for score, first, end in maximal_segments(scores.hits(tokens), penalty):
                    chance = k * len(tokens) * math.exp(-lam * score)
                    if chance < SIGNIFICANT:
                        total -= math.log(max(-math.expm1(-chance), 1e-300))
                        found.append({"first": first, "last": end - 1, "log_odds": score})
                evidence.append(total)
                passages.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c).cast(pa.string()) for c in also), pa.array(evidence), pa.array(passages, schema.field("passages").type)], schema=schema)

    return run


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's method, slightly regularised."""
    a, b = 0.0, 0.0
    design = np.stack((np.ones_like(x), x), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        h = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(h, design.T @ (y - p) - 1e-3 * np.array([a, b]))
        a, b = a + float(step[0]), b + float(step[1])
        if abs(step).max() < 1e-9:
            break
    return a, b


def toxicity(docs: DataFrame, labels: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, passages for every row of `docs` (doc_id, text), and its text columns `also`; `labels`: doc_id, toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *also)
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.where(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    marks = F.broadcast(materialise(marks, "training"))  # TRAINING_ROWS pairs of numbers at most
    train = rows.join(marks, "doc_id").select("text", "toxic", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == CALIBRATION).alias("apart"))
    model, apart, penalty = learn_words(train)
    held = fold(F.col("doc_id")) == 0
    if not model:
        return rows.select("doc_id", *also, held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("evidence"), F.expr("CAST(array() AS ARRAY<STRUCT<first: INT, last: INT, log_odds: DOUBLE>>)").alias("passages"))
    # at most TRAINING_ROWS pairs of numbers
    sample = train.where("apart AND toxic = 0").select("text").mapInArrow(lean(_best(apart, penalty)), "best double, words bigint").collect()
    lam, k = extreme_values(np.array([r["best"] for r in sample]), np.array([r["words"] for r in sample]))
    scored = rows.mapInArrow(lean(_evidence(model, penalty, lam, k, also)), f"doc_id bigint, {''.join(c + ' string, ' for c in also)}evidence double, passages array<struct<first: int, last: int, log_odds: double>>")
    scored = materialise(scored, "evidence")
    sample = scored.join(marks, "doc_id").select("evidence", "toxic").collect()
    a, b = _curve(np.log1p(np.array([r["evidence"] for r in sample])), np.array([float(r["toxic"]) for r in sample]))
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p("evidence"))))
    return scored.select("doc_id", *also, held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "evidence", "passages")
