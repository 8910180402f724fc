"""Each operator on a table with nulls, empty, long and repeated texts, and on an empty table, against brute force."""

import collections
import hashlib
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plexmer.llm import _tokens, _words, mixture, ngram_join, packing, syncmers, token_files, toxicity, warc
from plexmer.llm._common import shared_folder, workspace
from plexmer.llm._graph import components
from plexmer.llm.content_sort import content_sort_dedup
from plexmer.llm.html_text import extract_main_text, main_text
from plexmer.llm.repeated_phrases import repeated_phrases

repeated_phrases_module = sys.modules["plexmer.llm.repeated_phrases"]

SCHEMA = "doc_id bigint, text string, lang string, source string, norm string, bucket int"


def table():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(400)] + ["é", "Ça,", "x y", "it's", "Wort###"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, texts = prose(60), [None, "", " \t\n", "a", "a b", "A  B", "word " * 300, prose(9000)]
    base = prose(120).split(" ")
    for _ in range(12):  # near copies
        copy = base[:]
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = "new" + rng.choice(words)
        texts.append(rng.choice([" ", "  ", "\n"]).join(copy))
    texts += [prose(30) + " " + passage + " " + prose(20) for _ in range(6)] + [prose(rng.randint(1, 200)) for _ in range(30)]
    texts += texts[8:12] * 3 + [texts[7]]
    rows = [(i, t, "en", rng.choice(["s1", "s2", "s3", None]), "clash", 3) for i, t in enumerate(texts)]
    return rows + [rows[20], rows[20], (None, texts[9], None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_hashes_do_not_depend_on_place():
    import pyarrow as pa

    for texts in (["a bc", "bc a", None, "", "  a"], ["bc"], ["é bc\n\ta"]):
        for (_, raw, offs) in _words.slices(pa.array(texts, pa.string())):
            starts, ends, first = _words.word_spans(raw, offs)
            hashes = _words.word_hashes(raw, starts, ends, lower=False)
            assert [b - a for a, b in zip(first[:-1], first[1:])] == [len(words_of(t)) for t in texts]
            assert len({bytes(raw[s:e]) for s, e in zip(starts, ends)}) == len(set(hashes.tolist()))
    x = _words.mix(np.arange(50, dtype=np.uint64))
    assert (_words.rolling_hashes(x, 7)[5:20] == _words.rolling_hashes(x[5:26], 7)).all()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Space

    session = lambda master, folder: Space(conf=Space(get=lambda key, default: folder), sparkContext=Space(master=master))
    assert shared_folder(session("yarn", "hdfs://x/y/")) == "hdfs://x/y" and shared_folder(session("local[2]", None)).startswith("file:")
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master, None))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 3), (200, 201), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 1, 200: 200, 201: 200}


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_ngram_join(spark, docs, rows, empty, n, num, den, monkeypatch):
    def shingles(text):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))
    root = lambda i: i if parent[i] == i else root(parent[i])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = collections.Counter((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(rows))
    got = collections.Counter(map(tuple, ngram_join.ngram_jaccard_join(docs, n, num, den).collect()))
    assert got == want
    for most, hubs in ((200, 1), (60, 2)):  # blocks cut into chunks
        monkeypatch.setattr(ngram_join, "HUBS", hubs)
        monkeypatch.setattr(ngram_join, "SECOND", 1)
        split = ngram_join.ngram_jaccard_join(docs, n, num, den, block_tokens=most)
        assert collections.Counter(map(tuple, split.collect())) == want
    assert ngram_join.ngram_jaccard_join(empty, n, num, den).count() == 0


def test_counts_of_streamed_tokens(monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNT_CAP", 4)
    for sizes in ([9], [1, 9, 1], [4, 5, 2, 12, 1, 1, 6], [3, 17, 8]):
        tokens = np.repeat(np.arange(len(sizes)), sizes)
        want = [(t, i, min(sizes[t], 4)) for i, t in enumerate(tokens.tolist()) if sizes[t] > 1]
        for rows in range(1, len(tokens) + 1):  # ends at every batch boundary
            whole = pa.RecordBatch.from_pydict({"token": tokens, "cid": np.arange(len(tokens)), **{c: np.zeros(len(tokens), np.int32) for c in ("n", "slack", "ext")}})
            got = ngram_join._counted(whole.slice(i, rows) for i in range(0, len(tokens), rows))
            assert [(r["token"], r["cid"], r["df"]) for b in got for r in b.to_pylist()] == want


def connected(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    return root


def test_candidates_stream(monkeypatch):
    rng = np.random.default_rng(3)
    for trial in range(20):
        sizes = rng.integers(1, 60, 5)
        token = np.repeat(np.arange(len(sizes)), sizes)
        n = np.concatenate([np.sort(rng.integers(10, 10 + 5 * (trial + 1), k)) for k in sizes]).astype(np.int32)
        pos = (rng.random(len(n)) * (n - -(-4 * n // 5) + 1)).astype(np.int32)
        cid = np.arange(len(n))
        whole = pa.RecordBatch.from_pydict({"token": token, "cid": cid, "n": n, "pos": pos})
        rest = n - pos
        pairs = [(i, j) for i in cid for j in cid[i + 1 :] if token[i] == token[j] and 5 * n[i] >= 4 * n[j] and min(rest[i], rest[j]) >= ngram_join.overlap_needed(int(n[i]), int(n[j]), 4, 5)]
        results = []
        for rows in (1, 7, len(n)):
            got = [(r["a"], r["b"]) for b in ngram_join._candidates(4, 5)(whole.slice(i, rows) for i in range(0, len(n), rows)) for r in b.to_pylist()]
            root = connected(got)
            assert all(root(i) == root(j) for i, j in pairs) and all(token[i] == token[j] for i, j in got) and len(got) < len(n)
            assert all((n[i], pos[i]) == (n[j], pos[j]) or (min(i, j), max(i, j)) in pairs for i, j in got)
            results.append(set(got))
        assert results[0] == results[1] == results[2]


def test_prefix_tree():
    rng = np.random.default_rng(0)
    for trial in range(60):
        base = rng.integers(0, 2**63, 40).astype(np.uint64)
        keep = 0.9 if trial % 2 else 0.5
        sets = [np.unique(np.concatenate((base[rng.random(40) < keep], rng.integers(0, 2**63, rng.integers(1, 9)).astype(np.uint64)))) for _ in range(20)]
        sets = list({s.tobytes(): s for s in [*sets, *(s[:9] for s in sets[:3])]}.values())
        tree = ngram_join.PrefixTree(sets)
        linked = lambda s, o: 10 * len(np.intersect1d(s, o)) >= 8 * len(np.union1d(s, o))
        pairs = [(i, j) for i, s in enumerate(sets) for j, o in enumerate(sets) if linked(s, o)]
        for i in range(len(sets)):
            assert sorted(tree.links(i, 8, 10)[0].tolist()) == [j for k, j in pairs if k == i]
        want, label = connected(pairs), rng.integers(0, len(sets), len(sets))
        got = connected(ngram_join.match_block(list(range(len(sets))), sets, 8, 10))
        assert all((want(i) == want(j)) == (got(i) == got(j)) for i in range(len(sets)) for j in range(i))
        known = [(i, j) for i in range(len(sets)) for j in range(i) if label[i] == label[j]]
        want, got = connected(pairs + known), connected(ngram_join.match_block(list(range(len(sets))), sets, 8, 10, label) + known)
        assert all((want(i) == want(j)) == (got(i) == got(j)) for i in range(len(sets)) for j in range(i))


def test_a_tree_of_many_near_copies_is_walked_once():
    rng = np.random.default_rng(1)
    base, sets = rng.integers(0, 2**63, 300).astype(np.uint64), []
    for _ in range(4000):
        copy = base.copy()
        copy[rng.integers(0, 300, 5)] = rng.integers(0, 2**63, 5).astype(np.uint64)
        sets.append(np.unique(copy))
    seen = []
    walk = ngram_join.PrefixTree.links
    try:
        ngram_join.PrefixTree.links = lambda *a: (seen.append(r[1]) or r) if (r := walk(*a)) else r
        links = ngram_join.match_block(list(range(4000)), sets, 9, 10)
    finally:
        ngram_join.PrefixTree.links = walk
    assert len(links) == 3999 and sum(seen) < 20 * 4000


def test_content_sort(spark, docs, rows, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = collections.Counter((r[0], min((i for i in groups[norm(r[1])] if i is not None), default=None), len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    got = content_sort_dedup(docs).collect()
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert content_sort_dedup(empty).count() == 0


def test_content_sort_joins_a_group_over_ranges(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("IF(id % 3 = 0, 'same text', concat('same text ', id))").alias("text"))
    got = content_sort_dedup(many).where("group_size > 1").collect()
    assert len(got) == 1000 and {(r["keep_id"], r["group_size"]) for r in got} == {(0, 1000)} and sum(r["kept"] for r in got) == 1


@pytest.mark.parametrize("small", [False, True])
def test_repeated_phrases(spark, docs, rows, empty, small, monkeypatch):
    if small:  # shards of several automata and tasks, units of two rows
        for name, n in (("PHRASES", 7), ("STRETCHES", 2), ("UNIT", 2)):
            monkeypatch.setattr(repeated_phrases_module, name, n)
    n = 35
    windows = collections.Counter(tuple(w[i : i + n]) for w in (words_of(r[1]) for r in rows) for i in range(len(w) - n + 1))
    want = collections.Counter()
    for r in rows:
        w = words_of(r[1])
        cover = [False] * len(w)
        for i in range(len(w) - n + 1):
            if windows[tuple(w[i : i + n])] > 1:
                cover[i : i + n] = [True] * n
        want[r[0], len(w), sum(cover), hashlib.sha256(" ".join(x for x, c in zip(w, cover) if not c).encode()).hexdigest()] += 1
    got = repeated_phrases(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert all(sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_removed"] for r in got)
    assert repeated_phrases(empty).count() == 0


def test_automata():
    rng = random.Random(4)
    for _ in range(300):
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        phrases = {tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(3)) for _ in range(rng.randint(1, 9))}
        assert repeated_phrases_module.Phrases(map(list, phrases)).spans(text) == [(i, i + 3) for i in range(38) if tuple(text[i : i + 3]) in phrases]


def test_windows_that_occur_in_the_same_places_are_merged():
    rng = random.Random(8)
    for _ in range(300):
        base = "".join(rng.choice("ab") for _ in range(30))
        texts = [base[(a := rng.randrange(20)) : a + rng.randint(4, 12)] for _ in range(rng.randint(2, 5))]
        stretches, window = [" ".join(t) for t in texts], 4
        batch = pa.RecordBatch.from_pydict({"sid": pa.array(range(len(texts)), pa.int64()), "words": stretches})
        rows = [r for b in repeated_phrases_module._windows(window)([batch]) for r in b.to_pylist() if r["n"] > 1]
        wanted = [[{"h": r["h1"], "n": r["n"], "places": r["places"]} for r in rows if r["sid"] == i] for i in range(len(texts))]
        whole = pa.RecordBatch.from_pydict({"gram": pa.array([0] * len(texts), pa.int64()), "words": stretches, "windows": pa.array(wanted, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32()), ("places", pa.int64())])))})
        phrases = [r["words"].replace(" ", "") for b in repeated_phrases_module._phrases(window)([whole]) for r in b.to_pylist()]
        count = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
        for t in texts:  # phrases cover in each text just what windows that occur twice cover
            want = {i + j for i in range(len(t) - window + 1) if count[t[i : i + window]] > 1 for j in range(window)}
            got = {i + j for p in phrases for i in range(len(t) - len(p) + 1) if t.startswith(p, i) for j in range(len(p))}
            assert got == want, (texts, phrases)


def test_a_phrase_is_found_by_the_automaton_alone(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"x{i} " + " ".join(f"w{j}" for j in range(40))) for i in range(3)], "doc_id bigint, text string")
    assert {r["n_removed"] for r in repeated_phrases(frame).collect()} == {40}
    located = repeated_phrases_module._streamed
    monkeypatch.setattr(repeated_phrases_module, "_streamed", lambda phrases, stretches, width: located(phrases.limit(0), stretches, width))
    assert {r["n_removed"] for r in repeated_phrases(frame).collect()} == {0}


def test_repeated_phrases_keep_line_separators(spark):
    base = " ".join(f"w{i}" for i in range(40))
    ends = ["\u0085", "\u2028", "\u2029"]
    rows = [(i, f"{base} {end}") for i, end in enumerate(ends)] + [(9, f"x {base}")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in repeated_phrases(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: (41, 40), 1: (41, 40), 2: (41, 40), 9: (41, 40)}


def test_packing_and_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    ids = lambda name, end: {(r[0], r[1]): [*Tokenizer.from_file(token_files.default_tokenizer(name)).encode(r[1] or "", add_special_tokens=False).ids, end] for r in rows}
    want, got = ids("word_bpe_49k.json", 1), packing.harmonic_pack(docs).collect()
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"]))
    for parts in sequences.values():
        ends = [0]
        for offset, length, _ in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] == parts[0][2] <= 2048 and ends[-1] & (ends[-1] - 1) == 0
    pieces = collections.Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in got if r["doc_id"] is not None)
    total = sum(n * len(b) // 4 for (_, _, b), n in pieces.items())
    assert total == sum(len(want[r[0], r[1]]) for r in rows if r[0] is not None)
    for (doc_id, start, piece) in pieces:
        text = next(r[1] for r in rows if r[0] == doc_id)
        assert want[doc_id, text][start : start + len(piece) // 4] == np.frombuffer(piece, "<u4").tolist()

    want, folder = ids("byte_bpe_50k.json", 2), workspace(spark, "test")
    got = token_files.read_token_files(token_files.write_token_files(docs, folder, files=3), folder).orderBy("start").collect()
    at = 0
    for r, row in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (row[0], at, want[row[0], row[1]])
        at += r["n_tokens"]
    assert packing.harmonic_pack(empty).count() == 0
    folder = workspace(spark, "test")
    assert token_files.read_token_files(token_files.write_token_files(empty, folder), folder).count() == 0


def test_token_files_manifest_is_one_file(spark, docs):
    key, folder = "spark.sql.adaptive.coalescePartitions.enabled", workspace(spark, "test")
    spark.conf.set(key, "false")
    try:
        manifest = token_files.write_token_files(docs, folder, files=12)
        assert manifest.select("path").distinct().count() > 4 and len(manifest.inputFiles()) == 1
        got = [(r["start"], r["n_tokens"]) for r in token_files.read_token_files(manifest, folder).orderBy("start").collect()]
    finally:
        spark.conf.unset(key)
    assert [start for start, _ in got] == np.cumsum([0, *(n for _, n in got[:-1])]).tolist() and len(got) == docs.count()


def test_harmonic_bins():
    rng, size = random.Random(6), packing.tokens
    for capacity, count in ((64, 0), (64, 1), (64, 300), (256, 400)):
        bins, closed, want = packing.HarmonicBins(capacity, 0), [], []
        for i in range(count):
            n = rng.choice((rng.randint(1, 5), rng.randint(1, capacity // 2), capacity // rng.randint(1, 8), rng.randint(1, 4 * capacity)))
            want.append(n)
            closed += bins.put(i, np.arange(n, dtype="<u4").tobytes())
        in_time = len(closed)
        for sequence in closed:  # k whole pieces of class k and a head, or a whole sequence
            k = capacity // max(size(p) for p, *_ in sequence[:-1]) if len(sequence) > 1 else 0
            assert k in (0, len(sequence), len(sequence) - 1) and all(capacity // size(p) == k for p, *_ in sequence[:-1])
            assert sum(size(p) for p, *_ in sequence) == capacity
        assert sum(size(p) for b in bins.open.values() for p in b) < capacity * max(1, len(bins.open))
        closed += bins.finish()
        got = collections.defaultdict(list)
        for sequence in closed[in_time:]:
            assert (n := sequence[0][3]) == sum(size(p) for p, *_ in sequence) <= capacity and n & (n - 1) == 0
        for sequence in closed:
            assert [x[2] for x in sequence] == np.cumsum([0, *(size(p) for p, *_ in sequence[:-1])]).tolist()
            for p, *_ in sequence:
                (doc, start, ids, total), n = p, size(p)
                assert np.frombuffer(ids, "<u4").tolist() == list(range(start, start + n))
                got[doc].append((start, n))
                assert total == want[doc]
        for doc, n in enumerate(want):
            ends = np.cumsum([0, *(m for _, m in sorted(got[doc]))])
            assert [start for start, _ in sorted(got[doc])] == ends[:-1].tolist() and ends[-1] == n
        assert sum(map(len, got.values())) <= count + len(closed)  # a cut a sequence


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_ids_of_random_strings(name, kind):
    from tokenizers import Tokenizer

    path, rng = token_files.default_tokenizer(name), random.Random(9)
    tokenizer, encode = Tokenizer.from_file(path), _tokens.encoder(path, kind)
    parts = ["a", "B", "the", "'s", "'LL", "it's", "é", "É", "ß", "e\u0301", "İ", "1", "42", "###", "&&&", "$", ".", ",", "-", "_", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "漢字", "🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endof", "text|>", "\0"]
    for _ in range(100):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(1000)]
        for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(encode(text), "<u4").tolist() == want.ids, repr(text)


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_words_are_remembered_once(name, kind, monkeypatch):
    from tokenizers import Tokenizer

    path, rng = token_files.default_tokenizer(name), random.Random(4)
    words = sorted({"".join(rng.choice("abcdeéß") for _ in range(8)) for _ in range(2000)})
    texts = [" " + " ".join(words), " " + " ".join(w + rng.choice([".", "", "***"]) for w in words), " ".join(w.title() + rng.choice(["!", ""]) for w in words)] * 2
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for limit in (_tokens.REMEMBERED, 100):  # the second starts afresh again and again
        monkeypatch.setattr(_tokens, "REMEMBERED", limit)
        encode = _tokens.Encoder(path, kind)
        held = lambda: len(encode.memory) + sum(len(x) for x in vars(encode.memory).values() if isinstance(x, dict))  # noqa: B023, E731
        assert np.frombuffer(encode(texts[0]), "<u4").tolist() == want[0]
        assert held() <= min(len(words), limit)
        assert [np.frombuffer(encode(text), "<u4").tolist() for text in texts] == want
        assert limit > 100 or held() <= 2 * limit


def test_mixture_reads_rounds_once(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', CAST(1 + pow(id % 40, 2) AS INT))").alias("text"), F.expr("concat('s', id % 4)").alias("source"))
    for plan in (mixture.mix(docs), mixture.apply_mix(docs)):  # the driver compiles the plan: it holds the meetings of no round
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Relation [") <= 2 and text.count("Join ") <= 1 and "Union" not in text


def test_mixture(spark, docs, rows, empty):
    for sizes in ([10, 10, 10], [1, 1, 28], [5], [0, 0], [100, 1, 1, 1, 900, 3, 0, 50]):
        # the plain rule: share by weight, stop at three times the size, share the excess anew
        want, open_ = [3.0 * n for n in sizes], set(range(len(sizes)))
        while open_:
            left, weight = sum(sizes) - sum(want[i] for i in range(len(sizes)) if i not in open_), sum(1 + i % 3 for i in open_)
            above = {i for i in open_ if left * (1 + i % 3) / weight > 3 * sizes[i]}
            if not above:
                for i in open_:
                    want[i] = left * (1 + i % 3) / weight
                break
            open_ -= above
        names = ["", "A", "B", "a", "ab", "z", "é", "漢"][: len(sizes) - 1] + [None]  # code points in UTF-8 order, null last
        frame = spark.createDataFrame([(n, size, 1) for n, size in zip(names, sizes)], "source string, size bigint, n bigint")
        table = {r["source"]: r["target"] for r in mixture.with_targets(mixture.ranked_sources(frame)).collect()}
        assert [table[n] for n in names] == pytest.approx(want)
    got = mixture.mix(docs).collect()
    assert collections.Counter((r["doc_id"], r["source"], r["size"]) for r in got) == collections.Counter((r[0], r[3], len(words_of(r[1]))) for r in rows)
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in got)
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, mixture.mix(docs.repartition(7)).collect()))
    assert mixture.apply_mix(docs).count() == sum(r["copies"] for r in got) and mixture.apply_mix(docs).columns == docs.columns
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 20 + CAST(id % 50 AS INT))").alias("text"), F.expr("concat('s', id % 3)").alias("source"))
    for r in mixture.mix(many).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.001)
    # sources of few documents, one of which holds half of the words: near the target, and each document gets its due on average
    uneven = spark.range(300 * 20).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', IF(id % 20 = 0, 380, 10 + CAST(id % 20 AS INT)))").alias("text"), F.expr("concat('s', id DIV 20)").alias("source"))
    mixed = mixture.mix(uneven).toPandas()
    by_source = mixed.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by_source["taken"] - by_source["target"]).abs() <= 30).all()
    assert (mixed.groupby("source")["size"].count() == 20).all()
    mixed["due"], mixed["large"] = mixed["target"] / mixed["source_size"], mixed["size"] == 380
    for _, part in mixed.groupby([mixed["due"].round(6), "large"]):
        assert part["copies"].mean() == pytest.approx(part["due"].iloc[0], abs=0.2)
    # a hundred thousand equal rows are rounded one by one
    equal = spark.range(100_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"), F.expr("IF(id % 4 = 0, 's', 't')").alias("source"))
    for r in mixture.mix(equal).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect():
        assert abs(r["taken"] - r["target"]) <= 3 and r["n"] in (25_000, 75_000)
    assert mixture.apply_mix(equal).count() == mixture.mix(equal).agg(F.sum("copies")).first()[0]
    assert mixture.mix(empty).count() == 0


def test_meetings(spark):
    """Blocks of documents against a plain version of their meetings, with the same random numbers."""
    rng, blocks = random.Random(3), []
    for b in range(300):
        sizes = sorted(rng.randint(0, 50) for _ in range(rng.randint(1, 12)))
        blocks.append((b, [(rng.randrange(size) if size else 0, size, rng.randrange(1 << 40), (i, size, 0)) for i, size in enumerate(sizes)]))
    frame = spark.createDataFrame(blocks, "b int, items array<struct<m: bigint, c: bigint, h: bigint, row: struct<doc_id: bigint, size: bigint, nth: bigint>>>")
    for r in frame.select("b", "items", F.expr(mixture._PIVOT).alias("r")).collect():
        held, out = None, {}
        for m, c, h, row in r["items"]:
            if m == 0 or held is None:
                held, out = (held, {**out, row[0]: 0}) if m == 0 else ([m, c, row[0]], out)
                continue
            to_held, to_next = min(held[1] - held[0], m), min(held[0], c - m)
            d = to_held if h % (to_held + to_next) < to_next else -to_next
            pair = [[held[0] + d, held[1], held[2]], [m - d, c, row[0]]]
            out |= {x[2]: int(x[0] == x[1]) for x in pair if x[0] in (0, x[1])}
            held = next((x for x in pair if x[0] not in (0, x[1])), None)
        got = r["r"]["held"]
        assert {o["row"]["doc_id"]: o["one"] for o in r["r"]["out"]} == out and (got and [got["m"], got["c"], got["row"]["doc_id"]]) == held
        # the sum of words due is kept
        assert sum(x[0] for x in r["items"]) == sum(x[1] * out.get(x[3][0], 0) for x in r["items"]) + (held[0] if held else 0)


def test_syncmers(spark, docs, rows, empty):
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in syncmers.syncmer_fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for row, after in zip(order, order[1:] + order[:1]):
        text, next_text = row[1] or "", after[1] or ""
        edited = text[: len(text) - len(text) // 2] + next_text[: len(text) // 2]
        r = got[row[0], len(text), hashlib.sha256(edited.encode()).hexdigest()]
        assert 0 <= r["near_edited"] <= 1 and (text != edited or r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"])
    assert syncmers.syncmer_fingerprints(empty).count() == 0
    hashes = spark.range(1).select(syncmers.anchors("'p q r s t u v w x y z a b c d'").alias("a"), syncmers.anchors("'q r s t u v w x y z a b'").alias("b")).first()
    assert set(hashes["b"]) <= set(hashes["a"])  # free of context


def plain_anchors(text, k=5, s=2):
    """[(hash, place)] of the closed syncmers by the definition, one k-mer at a time."""
    import xxhash

    def chained(parts):
        seed = 42
        for part in parts:
            seed = xxhash.xxh64_intdigest(part, seed)
        return seed

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words, found = words_of(text), []
    for i in range(len(words) - k + 1):
        inner = [signed(chained(w.encode() for w in words[i + j : i + j + s])) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            cover = sorted({*range(0, k - s + 1, s), k - s})
            found.append((chained((inner[j] & (1 << 64) - 1).to_bytes(8, "little") for j in cover) >> 32, i))
    return found or ([(chained([" ".join(words).encode()]) >> 32, 0)] if words else [])


def test_syncmers_against_a_plain_version(spark, docs, rows):
    written = lambda found: "".join(f"{h:08X}{i:08X}" for h, i in found)

    def near(a, b):
        a, b = (collections.Counter(h for h, _ in x) for x in (a, b))
        return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0

    got = collections.Counter((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in syncmers.syncmer_fingerprints(docs).collect())
    order, want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), collections.Counter()
    for row, after in zip(order, order[1:] + order[:1]):
        text, next_text = row[1] or "", after[1] or ""
        own, other, edited = (plain_anchors(t) for t in (text, next_text, text[: len(text) - len(text) // 2] + next_text[: len(text) // 2]))
        want[row[0], written(own), written(edited), round(near(own, edited), 9), round(near(own, other), 9)] += 1
    assert got == want
    texts = spark.createDataFrame([(r[1],) for r in rows if r[1] and len(r[1]) < 3000], "t string")
    for k, s in ((3, 1), (7, 3), (6, 4)):
        for r in texts.select("t", syncmers.placed("t", k, s).alias("a")).collect():
            assert [(x >> 32 & 0xFFFFFFFF, x & 0xFFFFFFFF) for x in r["a"]] == plain_anchors(r["t"], k, s)


def test_syncmers_of_short_texts(spark):
    texts = [" ".join(f"{i}x{j}" for j in range(n)) for n in (1, 4, 5, 6, 7) for i in range(20)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, "")], "doc_id bigint, text string")
    got = syncmers.syncmer_fingerprints(frame).where("doc_id < 1000").collect()
    assert all(r["fingerprint"] for r in got) and all(r["near_next"] == 0 for r in got)


def test_syncmers_locate_a_passage_in_long_texts(spark):
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, a, b = prose(150), prose(9000), prose(9000)
    a[4000:4000], b[700:700] = passage, passage
    frame = spark.createDataFrame([(" ".join(a), " ".join(b), "p q r s t u v p q r s t u v", "p q r s t u v")], "a string, b string, c string, d string")
    r = frame.select(*(syncmers.placed(c).alias(c) for c in "abcd")).select("*", syncmers.matches("a", "b").alias("found"), syncmers.likeness("a", "b").alias("near"), syncmers.likeness("a", "a").alias("same"), syncmers.likeness("c", "d").alias("twice")).first()
    pairs = [(x["a"], x["b"]) for x in r["found"] if x["a"] - x["b"] == 3300]
    assert len(pairs) > 40 and all(4000 <= x <= 4145 for x, _ in pairs) and len(r["found"]) - len(pairs) <= 2
    hashes = [collections.Counter(x >> 32 for x in r[c]) for c in "abcd"]
    share = lambda x, y: sum((x & y).values()) / sum((x | y).values())
    assert r["near"] == pytest.approx(share(*hashes[:2])) and r["same"] == 1 and r["twice"] == pytest.approx(share(*hashes[2:]))
    assert [x & 0x7FFFFFFF for x in r["a"]] == sorted(x & 0x7FFFFFFF for x in r["a"])


def plain_segments(score):
    """All maximal scoring segments by their definition: the best segment, and those of what is left on both sides of it."""
    best = max(((sum(score[a:b]), a - b, a, b) for a in range(len(score)) for b in range(a + 1, len(score) + 1)), default=(0,))
    if best[0] <= 1e-12:
        return []
    _, _, a, b = best
    return [*plain_segments(score[:a]), (best[0], a, b), *((s, x + b, y + b) for s, x, y in plain_segments(score[b:]))]


def test_maximal_segments():
    rng = random.Random(2)
    for _ in range(400):
        hits = sorted({rng.randrange(30): rng.uniform(-2, 3) for _ in range(rng.randint(1, 12))}.items())
        found = toxicity.maximal_segments(hits, 0.4)
        want = plain_segments([dict(hits).get(i, 0.0) - 0.4 for i in range(30)])
        assert [(a, b) for _, a, b in found] == [(a, b) for _, a, b in want] and [s for s, _, _ in found] == pytest.approx([s for s, _, _ in want])


def test_extreme_values():
    rng = np.random.default_rng(5)
    words = rng.integers(20, 2000, 20_000)
    best = np.log(0.01 * words / -np.log(rng.random(len(words)))) / 1.7
    lam, k = toxicity.extreme_values(np.maximum(best, 0), words)
    assert lam == pytest.approx(1.7, rel=0.05) and k == pytest.approx(0.01, rel=0.1)
    assert toxicity.extreme_values(np.zeros(3), np.ones(3)) == (1.0, 1 / 3) and toxicity.extreme_values(np.zeros(0), np.zeros(0))[0] == 1.0


def test_scores_of_words():
    scores = toxicity.Scores({"vile": 2.0, "vil*": 0.5, "kind": -1.0, "kin*": 0.3})
    words = toxicity.chunks("Vile kind vile, kin VILE! village")
    assert scores.hits(words) == [(0, 2.0), (1, -1.0), (2, 2.0), (4, 2.0), (5, 0.5)]
    assert scores.hits(toxicity.chunks("vile vile x vile")) == [(0, 2.0), (1, 0.5), (3, pytest.approx(2 / 9))]


def test_toxicity(spark, empty):
    rng = random.Random(1)
    fine, foul = [f"w{i}" for i in range(200)], ["vile", "nasty", "foul"]
    rows = []
    for i in range(400):
        w = [rng.choice(fine) for _ in range(60)]
        if i % 5 == 0:
            w[20:26] = [rng.choice(foul) for _ in range(6)]
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame([*((i, t) for i, t, _ in rows), (None, None), (1000, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([*((i, y) for i, _, y in rows), (None, 1), (3, None)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 402 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(held) > 40 and sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) >= 0.97 * len(held)
    assert toxicity.toxicity(docs, labels.limit(0)).where("score <> 0").count() == 0
    odd = spark.createDataFrame([(1, "vile nasty foul", "clash", 0.5), (1, "vile nasty foul", "other", 0.5), (2, "w1 " * 200_000, None, None)], "doc_id bigint, text string, toxic string, score double")
    assert sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(odd, labels).collect())[0][0] == 1 and toxicity.toxicity(odd.unionByName(docs, True), labels).count() == 405
    assert toxicity.toxicity(empty, labels).count() == 0


def test_warc(spark):
    long = "<p>" + "ä" * 200 + "</p>"
    rows = [(3, "http://a/ b\n", long), (1, None, long), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (6, "v", "y" * 3_000_000), (6, "v", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string").repartition(2)
    folder = workspace(spark, "test")
    got = warc.read_warc(warc.normalise_warc(warc.write_warc(pages, f"{folder}/whole"), f"{folder}/records"), folder).collect()
    kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got)
    size = lambda h: len((h or "").encode())
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    assert kinds == collections.Counter((i, "revisit" if h == long and i != 1 else "response", 1 if h == long and i != 1 else None, size(h), digest(h)) for i, _, h in rows)
    names, refers = [], set()  # identifiers are unique, and those referred to exist
    for at in {(r["path"]) for r in got}:
        with pa.OSFile(at) as file:
            for headers, _ in (x for data in warc.inflated(file.read) for x in cutter.feed(data)) if (cutter := warc.RecordCutter()) else ():
                names.append(headers["warc-record-id"])
                refers |= {headers.get("warc-refers-to")} - {None}
    assert len(names) == len(set(names)) == len(rows) and refers and refers <= set(names)
    none = pages.limit(0)
    folder = workspace(spark, "test")
    assert warc.read_warc(warc.normalise_warc(warc.write_warc(none, f"{folder}/whole"), f"{folder}/records"), folder).count() == 0


def test_main_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><aside>More</aside>
    <article><h1>Title &amp; more</h1><p>First   <b>bold</b>\ntext that goes on for a while.<p>Second &lt;one&gt;.<p>Ok.<form>Mail <input></form>
    <script>var a = "</p>";</script><p>Third paragraph with some more words in it.</p></article>
    <section id="comments"><p>I liked it a lot, really, more than anything else.</p></section><footer>(c)</footer></body></html>"""
    assert main_text(page) == "Title & more\nFirst bold text that goes on for a while.\nSecond <one>.\nOk.\nThird paragraph with some more words in it."
    assert [main_text(x) for x in (None, "", "<p></p>", "plain  text", "<p>a<b>b")] == ["", "", "", "plain text", "ab"]
    frame = spark.createDataFrame([(1, "u", page, "t"), (None, None, None, None)], "page_id bigint, url string, html string, text string")
    assert {r["page_id"]: len(r["text"]) for r in extract_main_text(frame).collect()} == {1: len(main_text(page)), None: 0}
    assert extract_main_text(frame.limit(0)).count() == 0


def test_main_text_of_nested_articles():
    long = lambda w, n: " ".join([w] * n)
    page = lambda body: main_text(f"<html><body><nav><a href=x>Home</a></nav>{body}<footer>(c)</footer></body></html>")
    parts = [f"<h1>Title</h1><p>{long('lead', 8)}</p>", f"<div class=body><p>{long('one', 150)}</p><p>{long('two', 150)}</p></div>", f"<p>{long('closing', 6)}</p>"]
    whole = "\n".join(["Title", long("lead", 8), long("one", 150), long("two", 150), long("closing", 6)])
    assert page(f"<article>{''.join(parts)}</article>") == page(f"<main>{parts[0]}<article>{parts[1]}</article>{parts[2]}</main>") == whole
    assert page(f"<article><section><p>{long('a', 460)}</p></section><section><p>{long('b', 40)}</p></section></article>") == long("a", 460) + "\n" + long("b", 40)
    assert page(f"<article><blockquote><p>{long('said', 200)}</p></blockquote><p>{long('then', 9)}</p></article>") == long("said", 200) + "\n" + long("then", 9)
    assert page(f"<div class=page><p>{long('first', 30)}</p><div><p>{long('more', 400)}</p></div><p>{long('last', 30)}</p></div>") == "\n".join([long("first", 30), long("more", 400), long("last", 30)])
