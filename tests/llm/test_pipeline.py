"""The pipeline, stage by stage, against plain versions on a small table with planted toxic documents and copies."""

import collections
import random
import re
import weakref

import corpus_pipeline
import pyarrow as pa
from plexmer.llm import _common, _tokens, mixture, ngram_join, packing


def table(spark, folder):
    rng = random.Random(8)
    words, bad = [f"w{i}" for i in range(500)], [f"vile{i}" for i in range(12)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    texts, toxic = [prose(rng.randint(5, 150)) for _ in range(260)], [0] * 260
    for _ in range(90):
        base = prose(60)
        base[20:40] = [rng.choice(bad) for _ in range(20)]
        texts.append(base)
        toxic.append(1)
    for i in range(0, 60, 3):  # exact copies but for white space, and near ones
        texts.append(texts[i])
        near = list(texts[i + 1])
        near[len(near) // 2] = "other"
        texts.append(near)
        toxic += [0, 0]
    rows = [(i, rng.choice([" ", "  ", "\n"]).join(t), "en", f"src{rng.randrange(4)}", 0) for i, t in enumerate(texts)] + [(9000, None, "en", None, 0), (9001, "", "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{folder}/labels.parquet")
    return {r[0]: r[1] for r in rows}, {i for i, t in enumerate(toxic) if t}


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_stages(spark, tmp_path):
    sf = f"file://{tmp_path}"
    texts, toxic = table(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        tables[name] = docs
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: collections.Counter(r["doc_id"] for r in t.select("doc_id").collect()) for name, t in tables.items()}

    clean = set(ids["toxicity"])
    assert len(clean & toxic) <= 0.05 * len(toxic) and len(set(texts) - toxic - clean) <= 0.02 * len(texts)

    first = {}
    for i in sorted(clean):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", texts[i] or ""), i)
    assert ids["exact_dedup"] == collections.Counter(first.values())

    kept = sorted(first.values())
    sets, least = {i: shingles(texts[i]) for i in kept}, {i: i for i in kept}
    links = [(a, b) for a in kept for b in kept if a < b and sets[a] & sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in kept:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if all(least[a] == least[b] for a, b in links):
            break
    assert links and ids["ngram_jaccard_join"] == collections.Counter(i for i in kept if least[i] == i)

    plan = {r["doc_id"]: r for r in mixture.mix(tables["ngram_jaccard_join"]).collect()}
    assert ids["mixture"] == collections.Counter({i: r["copies"] for i, r in plan.items() if r["copies"]})
    taken = collections.Counter()
    for r in plan.values():
        taken[r["source"], r["target"]] += r["taken"]
    assert all(abs(n - target) <= 60 for (_, target), n in taken.items())

    pieces = tables["packing"].collect()
    assert set(ids["packing"]) == set(ids["mixture"])
    counted = collections.Counter()
    for r in pieces:
        counted[r["doc_id"]] += r["length"]
    total = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert all(counted[i] == n * total[i] for i, n in ids["mixture"].items())
    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    again = corpus_pipeline.run(spark, sf).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in again} == set(ids["packing"])


def test_rows_are_decided_one_by_one(spark, tmp_path):
    sf = f"file://{tmp_path}"
    texts, toxic = table(spark, sf)
    schema, bad, fine = "doc_id bigint, text string", texts[min(toxic)], texts[10] + " own"
    got = lambda stage, rows: collections.Counter((r["doc_id"], " ".join((r["text"] or "").split())) for r in stage(spark, spark.createDataFrame(rows, schema).repartition(3), sf).collect())
    count = lambda rows: collections.Counter((i, " ".join(t.split())) for i, t in rows)

    known = list(texts.items())
    mixed = got(corpus_pipeline.drop_toxic, known + [(None, bad), (None, fine), (min(toxic), fine), (None, fine)])
    assert mixed[None, " ".join(bad.split())] == 0 and mixed[None, " ".join(fine.split())] == 2 and mixed[min(toxic), " ".join(fine.split())] == 1

    rows = [(1, "a b"), (1, "a b"), (2, "a  b"), (2, "q"), (None, "x y"), (None, "x  y"), (None, "z"), (None, "q")]
    assert got(corpus_pipeline.drop_copies, rows) == count([(1, "a b"), (2, "q"), (None, "x y"), (None, "z")])

    long = lambda mark: [f"{mark}{i}" for i in range(80)]
    a, b, c, d = (long(x) for x in "abcd")
    near = lambda t: " ".join([*t[:-1], "other"])
    rows = [(1, " ".join(a)), (1, near(a)), (5, " ".join(b)), (5, " ".join(c)), (None, " ".join(d)), (None, near(d)), (6, near(b)), (None, near(c)), (None, "")]
    kept = got(corpus_pipeline.drop_near_copies, rows)
    assert sum(kept.values()) == 5 and sum(n for (i, _), n in kept.items() if i is None) == 2 and sum(n for (i, _), n in kept.items() if i == 5) == 2 and kept[None, ""] == 1


def test_texts_are_not_shuffled_to_drop_or_repeat_rows(spark, tmp_path, monkeypatch):
    sf = f"file://{tmp_path}"
    table(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if what is decided were large
    try:
        rows = corpus_pipeline.with_row_id(docs, "rows")
        assert "SortMergeJoin" not in plan(corpus_pipeline.without(rows, rows.where("doc_id % 7 = 0")))
        assert "SortMergeJoin" not in plan(mixture.apply_mix(docs))
        edges, whole = [], []
        monkeypatch.setattr(ngram_join, "components", lambda df, tag, f=ngram_join.components: (edges.append(plan(df)), f(df, tag))[1])
        monkeypatch.setattr(ngram_join, "materialise", lambda df, tag, f=ngram_join.materialise: (whole.append(plan(df)) if tag == "whole" else None, f(df, tag))[1])
        ngram_join.ngram_jaccard_join(docs).count()
        assert "SortMergeJoin" not in edges[0]  # pools of the rows that stand for a class
        assert "BroadcastHashJoin" in whole[0]  # texts of no member stay where they are
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_values_of_places(spark, monkeypatch):
    rng = random.Random(1)
    numbers = [*rng.sample(range(5000), 600), 0, 1023, 1024, *((7 << 33) + i for i in range(0, 3000, 61))]
    values = {(f, n): rng.randrange(80) for f in "ab" for n in numbers if rng.random() < 0.7}
    rows = [(f, n) for f in "abc" for n in [*numbers, 6000]]
    given = spark.createDataFrame([(*at, x) for at, x in values.items()], "file string, number bigint, value int")
    places = spark.createDataFrame(rows, "f string, n bigint")
    for most in (_common.NOTES, 0):  # broadcast, and too many notes for that
        monkeypatch.setattr(_common, "NOTES", most)
        got = _common.with_values(places, (places["f"], places["n"]), given, "values").collect()
        assert collections.Counter(map(tuple, got)) == collections.Counter((f, n, values.get((f, n), 0)) for f, n in rows)


def test_workers_keep_nothing_of_earlier_steps(spark, tmp_path, monkeypatch):
    sf = f"file://{tmp_path}"
    table(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps, given = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema: (steps.append(f), given(df, f, schema))[1])
    monkeypatch.setattr(packing, "TaskContext", type("Here", (), {"get": staticmethod(lambda: type("", (), {"partitionId": staticmethod(lambda: 0)}))}))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", None], "toxic": pa.array([0, 1], pa.int32()), "apart": [False, True]})
    path = _tokens.default_tokenizer("word_bpe_49k.json")

    def packed():  # as in a worker
        list(steps[0]([batch]))
        return weakref.ref(_tokens.encoder(path, "word"))

    packing.harmonic_pack(docs)
    encoder = packed()
    assert encoder() is packed()() is not None  # the next task of the same operator finds it
    corpus_pipeline.drop_toxic(spark, docs, sf)
    ngram_join.ngram_jaccard_join(docs)
    assert len(steps) >= 6
    list(steps[1]([batch]))  # one of toxicity
    assert encoder() is None
    encoder = packed()
    list(next(f for f in steps[4:])([batch.select(["doc_id", "text"])]))  # one of ngram_jaccard_join
    assert encoder() is None
