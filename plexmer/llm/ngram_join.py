"""N-gram Jaccard join by prefix trees.

Every text becomes the set of its distinct n-word shingles (64-bit hashes).  Two
texts link when ``intersection / union >= num / den``.  Steps:

1. one pass writes each text's set size, a 128-bit key of its set and a *pool* of
   its shingles; equal sets are one class from here on;
2. pool shingles are counted over all classes; the order of prefixes is
   (in the pool, by rising count, up to `COUNT_CAP`, then by hash), then (outside it, by hash).  By the prefix
   principle two linked sets share a shingle among the first
   ``n - ceil(t n) + 1`` of this order, so a class without a repeated shingle
   there has no partner;
3. classes that share a prefix shingle, and pass the length and position bounds,
   are chained into blocks (connected components of the candidates).  A shingle's rows stream by, by
   rising size; one row for each size and position is held, as others of the same are linked to it;
4. a block is one subtree below the root of the prefix tree of all sets, as sets of different blocks share no
   candidate; it holds whole sets in the block's order: shingles of more sets first, then by hash.  Every set walks it
   from the root: overlaps are shared along common paths, and a subtree is cut where the overlap so far and
   the range of lengths that remain below it cannot reach what the join asks, or where all of its
   sets are in the walking set's component already;
5. the links found give the components.

Blocks above `block_tokens` shingles are matched in chunks, each of them with the same `HUBS` sets of the
block.  What is then not in the block's largest component is matched, piece by piece, against all of
the block, so no task holds an unbounded group, no link is lost, and a large group of near copies costs about its size.

Defined cases: null or wordless texts have an empty set, link with nothing and are
their own component (their doc_id); texts with fewer words than `n` have one
shingle, the whole sequence; very long texts are read whole; repeated rows stay separate rows of one component; a
null doc_id counts only where no other id is in the component; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NOTE, NOTES, column, lean, materialise, run_bounds, shuffle_width, small_batches, whole_groups, with_values
from ._graph import components
from ._words import shingle_set, slices, word_hashes, word_spans

#: Shingles whose top four bits are below this are in the pool (sixteenths of all).
POOL = 3
#: Counts above this are equal in the order of prefixes, so that the rows of a shingle can be passed on before its last.
COUNT_CAP = 1 << 16
#: Sets of a large block that all of its chunks hold.
HUBS = 8
#: Slots for each member's id, and of all at most, in the filter of texts that are read again.
SLOTS, MOST_SLOTS = 8, NOTES << NOTE
#: Cells of the second pass over large blocks hold so many times `block_tokens` of each side.
SECOND = 10


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def overlap_needed(n: np.ndarray | int, m: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """Least intersection of linked sets of sizes n and m."""
    return -(-num * (n + m) // (num + den))


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    for _, raw, offs in slices(batch.column("text")):
        starts, ends, first = word_spans(raw, offs)
        hashes = word_hashes(raw, starts, ends, lower=True)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield shingle_set(hashes[a:b], n)


def set_key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _signatures(n: int, num: int, den: int, pool: int, also: tuple[str, ...] = ()):
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in also), ("n_shingles", pa.int32()), ("key", pa.binary()), ("slack", pa.int32()), ("pool", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, slack, pools = [], [], [], []
            for s in _sets(batch, n):
                inside = s[(s >> np.uint64(60)) < pool]
                p = prefix_length(len(s), num, den)
                slack.append(len(inside) - p)
                if len(inside) < p:
                    inside = np.concatenate((inside, s[(s >> np.uint64(60)) >= pool][: p - len(inside)]))
                sizes.append(len(s))
                keys.append(set_key(s))
                pools.append(inside.view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in pools]))).astype(np.int32)
            flat = pa.array(np.concatenate(pools) if pools else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c).cast(pa.string()) for c in also), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(slack, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), flat)], schema=schema)

    return run


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token -> the rows of tokens that occur at least twice, with the count (COUNT_CAP at most)."""
    schema = pa.schema([("token", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("slack", pa.int32()), ("ext", pa.int32()), ("df", pa.int32())])
    held: list[pa.RecordBatch] = []  # rows of the last token, COUNT_CAP at most
    token, streaming = None, False

    def out(parts: list[pa.RecordBatch], counts: np.ndarray) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        keep = counts >= 2
        return pa.RecordBatch.from_arrays([*(pa.array(column(table, c)[keep]) for c in schema.names[:-1]), pa.array(counts[keep].astype(np.int32))], schema=schema)

    def flush() -> Iterator[pa.RecordBatch]:
        size = sum(b.num_rows for b in held)
        if size and (streaming or size > 1):  # a streamed token may end where nothing is held
            yield out(held, np.full(size, COUNT_CAP if streaming else min(size, COUNT_CAP)))
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = column(batch, "token")
        bounds = run_bounds(tokens)
        at = 0
        if token is not None and tokens[0] == token:
            at = int(bounds[1])
            held.append(batch.slice(0, at))
            if sum(b.num_rows for b in held) > COUNT_CAP:
                streaming = True
                yield from flush()
            if at == batch.num_rows:
                continue
        yield from flush()
        last = int(bounds[-2])
        if last > at:
            sizes = np.diff(bounds)
            counts = np.repeat(sizes, sizes)[at:last]
            yield out([batch.slice(at, last - at)], np.minimum(counts, COUNT_CAP))
        held.append(batch.slice(last))
        token, streaming = tokens[-1], False
    yield from flush()


def _prefixes(pool: int, num: int, den: int):
    """Rows of whole classes -> those of their prefix, with the position in the global order."""
    schema = pa.schema([("token", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cid"):
            cid, token, n, slack, ext, df = (column(table, c) for c in ("cid", "token", "n", "slack", "ext", "df"))
            order = np.lexsort((token.view(np.uint64), df, ext, cid))
            cid, token, n, slack, ext = cid[order], token[order], n[order].astype(np.int64), slack[order].astype(np.int64), ext[order].astype(np.int64)
            bounds = run_bounds(cid)
            rank = np.arange(len(cid)) - np.repeat(bounds[:-1], np.diff(bounds))
            inside = ext < 0
            repeated = np.repeat(np.add.reduceat(inside, bounds[:-1]), np.diff(bounds))
            prefix = n - -(-num * n // den) + 1
            pos = np.where(inside, prefix + slack - repeated + rank, ext)
            keep = pos < prefix
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(cid[keep]), pa.array(n[keep].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], schema=schema)

    return run


class Chain:
    """Links that connect all candidates among the rows of one shingle, which come by rising size.

    Candidates pass the length and position bounds.  Rows of one size and position have the same partners, so the
    first stands for the others, which are linked to it.
    """

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.known: dict[tuple[int, int], int] = {}
        self.rows = np.zeros((4, 16), np.int64)  # size, shingles from the position on, class, number of its group
        self.count = 0

    def add(self, n: int, pos: int, cid: int) -> list[tuple[int, int]]:
        first = self.known.setdefault((n, pos), cid)
        if first != cid:
            return [(first, cid)]
        size, rest, ids, group = self.rows[:, : self.count]
        low = int(np.searchsorted(size, -(-self.num * n // self.den)))
        need = overlap_needed(size[low:], n, self.num, self.den)
        near = low + np.flatnonzero((rest[low:] >= need) & (n - pos >= need))
        groups, at = np.unique(group[near], return_index=True)
        out = [(int(ids[near[i]]), cid) for i in at]
        own = int(groups[0]) if len(groups) else cid
        if len(groups) > 1:
            group[np.isin(group, groups)] = own
        if low > 1024 and 2 * low > self.count:  # too short for all that follow
            for i, r in zip(size[:low].tolist(), rest[:low].tolist(), strict=True):
                del self.known[i, i - r]
            self.rows[:, : self.count - low] = self.rows[:, low : self.count].copy()
            self.count -= low
        if self.count == self.rows.shape[1]:
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)), axis=1)
        self.rows[:, self.count] = n, n - pos, cid, own
        self.count += 1
        return out


def _candidates(num: int, den: int):
    """Rows sorted by (token, n, cid) -> candidates, whatever the batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chain = None, None
        for batch in batches:
            edges = []
            for token, cid, n, pos in zip(*(batch.column(c).to_pylist() for c in ("token", "cid", "n", "pos")), strict=True):
                if token != last:
                    last, chain = token, (cid, n, pos)  # most shingles have few rows
                elif isinstance(chain, tuple):
                    (other, m, at), chain = chain, Chain(num, den)
                    chain.add(m, at, other)
                    edges += chain.add(n, pos, cid)
                else:
                    edges += chain.add(n, pos, cid)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*set(edges), strict=True)], schema=schema)

    return run


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that start there, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class PrefixTree:
    """A trie of token sets, all in one order: tokens of more sets first, then by hash.

    Paths without a branch are one node.  Nodes lie breadth first in flat arrays, a node's children side by side, so
    a set walks down level by level: a node's overlap with it is its parent's and the hits among its own tokens,
    which all sets below share.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        self.inside = np.zeros(len(counts), np.int64)
        self.sets = [np.sort(x) for x in np.split(rank[inverse], np.cumsum(self.sizes)[:-1])]
        order = sorted(range(len(sets)), key=lambda i: self.sets[i].astype(">u4").tobytes())
        depth, parent, of, ends = [0], [-1], [order[0]], [-1]
        stack, last = [0], None
        for number, i in enumerate(order):
            shared = 0
            if number:
                a, b = self.sets[order[number - 1]], self.sets[i]
                m = min(len(a), len(b))
                differ = a[:m] != b[:m]
                shared = int(differ.argmax()) if differ.any() else m
            while depth[stack[-1]] > shared:
                last = stack.pop()
            if depth[stack[-1]] < shared:  # a path branches here
                depth.append(shared), parent.append(stack[-1]), of.append(i), ends.append(-1)
                parent[last] = len(depth) - 1
                stack.append(len(depth) - 1)
            depth.append(len(self.sets[i])), parent.append(stack[-1]), of.append(i), ends.append(i)
            stack.append(len(depth) - 1)
        children: list[list[int]] = [[] for _ in depth]
        for v in range(1, len(depth)):
            children[parent[v]].append(v)
        nodes, self.levels = [0], [0, 1]
        while self.levels[-1] > self.levels[-2]:
            nodes += [c for v in nodes[self.levels[-2] : self.levels[-1]] for c in children[v]]
            self.levels.append(len(nodes))
        place = np.empty(len(nodes), np.int64)
        place[nodes] = np.arange(len(nodes))
        self.depth, self.ends = np.array(depth)[nodes], np.array(ends)[nodes]
        self.parent = np.concatenate(([0], place[np.array(parent, np.int64)[nodes[1:]]]))
        self.kids = np.array([len(children[v]) for v in nodes])
        self.child = np.cumsum(self.kids) - self.kids + 1
        pieces = [self.sets[of[v]][depth[parent[v]] : depth[v]] if v else self.sets[0][:0] for v in nodes]
        self.length = np.array([len(x) for x in pieces])
        self.first = np.cumsum(self.length) - self.length
        self.tokens = np.concatenate(pieces)
        self.last = np.array([int(x[-1]) if len(x) else -1 for x in pieces])
        own = np.where(self.ends >= 0, self.sizes[self.ends], 0)
        self.least, self.most = self._below(np.where(self.ends >= 0, own, self.sizes.max() + 1), own)

    def _below(self, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest of the values at and below each node."""
        for a, b in zip(self.levels[-3:0:-1], self.levels[-2:1:-1], strict=True):
            np.minimum.at(least, self.parent[a:b], least[a:b])
            np.maximum.at(most, self.parent[a:b], most[a:b])
        return least, most

    def group(self, label: np.ndarray) -> None:
        """Note of each node the only group of the sets below it, -1 for several."""
        own = label[self.ends]
        least, most = self._below(np.where(self.ends >= 0, own, np.iinfo(np.int64).max), np.where(self.ends >= 0, own, -1))
        self.only = np.where(least == most, least, -1)

    def links(self, number: int, num: int, den: int, known: int = -2) -> tuple[np.ndarray, int]:
        """Numbers of the sets that link with set `number`, itself included, and of the nodes seen; none below nodes whose only group is `known`."""
        own = self.sets[number]
        n, found, seen = len(own), [], 0
        self.inside[own] = 1
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            kids = self.kids[nodes]
            overlap, nodes = np.repeat(overlap, kids), spread(self.child[nodes], kids)
            if known >= 0:
                other = self.only[nodes] != known
                nodes, overlap = nodes[other], overlap[other]
            if not len(nodes):
                break
            seen += len(nodes)
            lengths = self.length[nodes]
            hits = np.add.reduceat(self.inside[self.tokens[spread(self.first[nodes], lengths)]], np.cumsum(lengths) - lengths)
            overlap = overlap + hits
            # what the walking set has left after the node's last token, and the length below that fits it best
            rest, depth = n - np.searchsorted(own, self.last[nodes], "right"), self.depth[nodes]
            best = np.clip(depth + rest, self.least[nodes], self.most[nodes])
            alive = overlap + np.minimum(rest, best - depth) >= overlap_needed(n, best, num, den)
            nodes, overlap = nodes[alive], overlap[alive]
            sets = self.ends[nodes]
            found.append(sets[(sets >= 0) & (overlap >= overlap_needed(n, self.sizes[sets], num, den))])
        self.inside[own] = 0
        return np.concatenate(found) if found else np.zeros(0, np.int64), seen


def match_block(ids: list[int], sets: list[np.ndarray], num: int, den: int, label: np.ndarray | None = None, walking: Iterable[int] | None = None) -> list[tuple[int, int]]:
    """Links that, with the components `label` known before, connect all linked sets of a block; only the sets numbered in `walking` seek partners."""
    if len(ids) < 2:
        return []
    tree, out = PrefixTree(sets), []
    label = np.arange(len(ids)) if label is None else np.unique(label, return_inverse=True)[1]
    tree.group(label)
    news, seen = 0, 0
    for i in range(len(ids)) if walking is None else walking:
        found, nodes = tree.links(i, num, den, int(label[i]))
        seen += nodes
        others, at = np.unique(label[found], return_index=True)
        others, at = others[others != label[i]], at[others != label[i]]
        if len(others):
            out += [(ids[i], ids[j]) for j in found[at].tolist()]
            label[np.isin(label, others)] = label[i]
            news += len(others)
        if news and (seen > len(tree.depth) or 8 * news > len(ids)):  # costs as much as it has cost to walk
            tree.group(label)
            news, seen = 0, 0
    return out


def _whole_sets(n: int):
    schema = pa.schema([("block", pa.int64()), ("chunks", pa.int32()), ("cid", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            sets = [s.tobytes() if set_key(s) == k else None for s, k in zip(_sets(batch, n), keys, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(sets, pa.binary())], schema=schema)

    return run


def _matched(num: int, den: int):
    """Rows by cell (cell, block, cid, tokens, component, walks) -> links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            edges = []
            groups: dict[tuple[int, int], dict[int, tuple]] = {}
            for cell, block, cid, *row in zip(*(table.column(c).to_pylist() for c in ("cell", "block", "cid", "tokens", "component", "walks")), strict=True):
                known = groups.setdefault((cell, block), {})
                if cid not in known or row[2]:
                    known[cid] = tuple(row)
            for members in groups.values():
                ids = sorted(members)
                tokens, component, walks = zip(*(members[i] for i in ids), strict=True)
                edges += match_block(ids, [np.frombuffer(t, np.uint64) for t in tokens], num, den, np.array(component), [i for i, w in enumerate(walks) if w])
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], schema=schema)

    return run


def _links(whole: DataFrame, num: int, den: int, block_tokens: int, width: int) -> DataFrame:
    """(a, b) that connect all linked sets of each block of `whole` (block, chunks, cid, n, tokens)."""

    def matched(cells: DataFrame) -> DataFrame:
        return cells.repartition(width, "cell").sortWithinPartitions("cell").mapInArrow(lean(_matched(num, den)), "a bigint, b bigint")

    large = whole.where("chunks > 1")
    first = F.min(F.struct(F.xxhash64("cid").alias("h"), "cid"))["cid"].alias("cid")
    hubs = large.groupBy("block", F.pmod(F.xxhash64("cid", F.lit(2)), F.lit(HUBS)).alias("nth")).agg(first, F.first("chunks").alias("chunks"))
    own = F.pmod(F.xxhash64("cid"), "chunks")
    places = whole.select("block", "cid", "tokens", own.alias("chunk"))
    copies = hubs.select("block", "cid", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk")).join(large.select("block", "cid", "tokens"), ["block", "cid"])
    cells = places.unionByName(copies).select(F.xxhash64("block", "chunk").alias("cell"), "block", "cid", "tokens", F.col("cid").alias("component"), F.lit(True).alias("walks"))
    links = materialise(matched(cells), "links")
    if large.limit(1).count() == 0:
        return links
    # all that is not in its block's largest component meets all of the block
    found = components(links.join(large.select(F.col("cid").alias("a")), "a", "left_semi"), "chunks")
    members = large.select("block", "cid", "n").join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    members = materialise(members, "chunked")
    main = members.groupBy("block", "component").agg(F.count("*").alias("size")).groupBy("block").agg(F.max(F.struct("size", "component"))["component"].alias("main"))
    rest = members.join(main, "block").where(F.col("component") != F.col("main")).select("block", "cid", "n")
    pieces = F.ceil(F.sum("n") / (SECOND * block_tokens))
    cut = members.groupBy("block").agg(pieces.alias("stores")).join(rest.groupBy("block").agg(pieces.alias("pieces")), "block")
    sets = large.select("block", "cid", "tokens").join(members.select("cid", "component"), "cid").join(cut, "block")
    piece, store = F.pmod(F.xxhash64("cid", F.lit(1)), "pieces"), F.pmod(F.xxhash64("cid"), "stores")
    stored = sets.withColumn("store", store).withColumn("piece", F.explode(F.expr("sequence(0L, pieces - 1)"))).withColumn("walks", F.lit(False))
    walking = sets.join(rest.select("cid"), "cid", "left_semi").withColumn("piece", piece).withColumn("store", F.explode(F.expr("sequence(0L, stores - 1)"))).withColumn("walks", F.lit(True))
    second = stored.unionByName(walking).select(F.xxhash64("block", "piece", "store").alias("cell"), "block", "cid", "tokens", "component", "walks")
    return links.unionByName(materialise(matched(second), "links"))


def _perhaps(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """`rows` (column `key`) without most of those whose key is no doc_id of `members`, and with all others; each id sets one of many slots."""
    slots = F.lit(max(1, min(MOST_SLOTS, SLOTS * members.count())))
    slot = lambda c: F.pmod(F.xxhash64(c), slots)
    found = with_values(rows, (F.lit(""), slot(key)), members.select(F.lit("").alias("file"), slot("doc_id").alias("number"), F.lit(1).alias("value")), "slots")
    return found.where("_value = 1").drop("_value")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, pool: int = POOL, block_tokens: int = 200_000, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text); with text columns `also`, these and `component`, a number of its own for every component."""
    spark = docs.sparkSession
    small_batches(spark)
    width = shuffle_width(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *also)

    signed = rows.mapInArrow(lean(_signatures(n, num, den, pool, also)), f"doc_id bigint, {''.join(c + ' string, ' for c in also)}n_shingles int, key binary, slack int, pool array<bigint>")
    signed = materialise(signed.withColumn("rid", F.monotonically_increasing_id()), "sets")
    classes = materialise(signed.where("key is not null").groupBy("key").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n")), "classes")

    # pools of the rows that stand for a class; only numbers of rows are told, so pools are not shuffled for it
    first = classes.select(F.lit("").alias("file"), F.col("cid").alias("number"), F.lit(1).alias("value"))
    tokens = (
        with_values(signed, (F.lit(""), F.col("rid")), first, "first").where("_value = 1")
        .select(F.col("rid").alias("cid"), F.col("n_shingles").alias("n"), "slack", F.posexplode("pool").alias("at", "token"))
        .select("token", "cid", "n", "slack", F.expr(f"IF(shiftrightunsigned(token, 60) < {pool}, -1, at)").cast("int").alias("ext"))
    )
    counted = tokens.repartition(width, "token").sortWithinPartitions("token").mapInArrow(lean(_counted), "token bigint, cid bigint, n int, slack int, ext int, df int")
    prefixes = counted.repartition(width, "cid").sortWithinPartitions("cid").mapInArrow(lean(_prefixes(pool, num, den)), "token bigint, cid bigint, n int, pos int")
    pairs = prefixes.repartition(width, "token").sortWithinPartitions("token", "n", "cid").mapInArrow(lean(_candidates(num, den)), "a bigint, b bigint")
    blocks = components(pairs, "blocks").select(F.col("node").alias("cid"), F.col("component").alias("block"))

    member = materialise(blocks.join(classes, "cid"), "members")
    sizes = member.groupBy("block").agg(F.ceil(F.sum("n") / block_tokens).cast("int").alias("chunks"))
    member = member.join(sizes, "block")
    texts = _perhaps(rows.withColumnRenamed("doc_id", "id"), "id", member).join(member.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id"))).select("text", "key", "block", "chunks", "cid", "n")
    whole = texts.mapInArrow(lean(_whole_sets(n)), "block bigint, chunks int, cid bigint, n int, tokens binary").where("tokens is not null")
    links = _links(materialise(whole, "whole"), num, den, block_tokens, width)

    found = components(links, "links").select(F.col("node").alias("cid"), "component")
    found = materialise(classes.join(found, "cid", "left").select("key", "doc_id", F.coalesce("component", "cid").alias("component")), "found")
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = found.join(least, "component").select("key", "component_id", "component")
    own = [*also, F.coalesce("component", "rid").alias("component")] if also else []
    return signed.select("doc_id", "n_shingles", "key", "rid", *also).join(named, "key", "left").select("doc_id", F.col("n_shingles").cast("bigint").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *own)
