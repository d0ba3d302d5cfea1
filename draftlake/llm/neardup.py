"""Near-duplicate classes by an LSH forest over MinHash signatures.

Each of ``TREES`` trees orders the distinct shingle sets by its own sequence of ``DEPTH`` minimum hashes. Sets whose
sequences start alike form a region: at depth two, at depth four where that region holds more than ``REGION`` sets, and split
by a hash of the set where even such a region does. Inside a region every set is paired with its neighbours in
sequence order, which share the longest prefixes, and with the region's first set. A 2-bit sketch of the whole signature
drops pairs that are far apart (five standard deviations from the threshold); the others are confirmed on their full
shingle sets. That joins most of what belongs together with few pairs. Whatever then still stands in one region at depth
two but in different components is compared whole: every such pair by its sketch, and by its full sets while its
components differ, in blocks of bounded size that give the links of a spanning forest, so rows never grow with the square
of a group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.words import CHUNK, shingle_sets
from draftlake.session import cut, written

TREES, DEPTH = 12, 6
REGION = 20_000
NEIGHBOURS = 2
COVERED = 4  # sets of a region that its neighbours and its first set pair wholly
BLOCK = 4096  # sets of a chunk; two chunks are compared at once
BLOCK_SHINGLES = 1 << 21  # shingles of a chunk where the full sets are compared
_VALUES = TREES * DEPTH
_SKETCHED = 64  # values of the signature that the sketch holds
_MULTIPLIERS = np.random.default_rng(20240817).integers(0, 1 << 63, _VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes, one row of ``TREES * DEPTH`` 32-bit values per non-empty set."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    joined = np.concatenate(sets)
    out = np.empty((len(sets), _VALUES), np.uint32)
    for j, multiplier in enumerate(_MULTIPLIERS):
        out[:, j] = np.minimum.reduceat(joined * multiplier, starts) >> np.uint64(32)
    return out


def sketches(values: np.ndarray) -> np.ndarray:
    """Two bits of every sketched value, 32 values to a long."""
    bits = (values[:, :_SKETCHED] & np.uint32(3)).astype(np.uint64).reshape(len(values), -1, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        sizes = np.zeros(n, np.int64)
        keys: list[bytes | None] = [None] * n
        forest: list[bytes | None] = [None] * n
        marks = np.zeros((n, _SKETCHED // 32), np.int64)
        rows: list[int] = []
        sets: list[np.ndarray] = []
        waiting = 0

        def flush() -> None:
            values = signatures(sets)
            marks[rows] = sketches(values)
            for row, own, value in zip(rows, sets, values.astype(">u4"), strict=True):
                keys[row] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                forest[row] = value.tobytes()
            rows.clear()
            sets.clear()

        for row, own in shingle_sets(batch.column(1), words):
            sizes[row] = len(own)
            if len(own):
                rows.append(row)
                sets.append(own)
                waiting += 8 * len(own)
            if waiting > CHUNK:
                flush()
                waiting = 0
        if sets:
            flush()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(forest, pa.binary()), *(pa.array(marks[:, i]) for i in range(marks.shape[1]))],
            names=["doc_id", "text_key", "n_shingles", "set_key", "forest", "s0", "s1"])


def _full_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # a document that repeats in the table gives its set once
    for batch in batches:
        nodes, sets = [], []
        asked, own_nodes = batch.column(0), batch.column(2).to_pylist()
        for row, own in shingle_sets(batch.column(1), words):
            if own_nodes[row] not in seen and hashlib.blake2b(own.tobytes(), digest_size=16).digest() == asked[row].as_py():
                seen.add(own_nodes[row])
                nodes.append(own_nodes[row])
                sets.append(own.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])


def _differences(a: str, b: str) -> Column:
    """In how many of the signature's values two sketches differ."""
    total = F.lit(0)
    for s in ("s0", "s1"):
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def most_differences(percent: int) -> int:
    """Five standard deviations over the differences expected at the threshold: 3/4 of unequal values show in two bits."""
    p = (1 - percent / 100) * 0.75
    return math.ceil(_SKETCHED * p + 5 * math.sqrt(_SKETCHED * p * (1 - p)))


def _prefix(depth: int) -> Column:
    return F.expr(f"substring(seq, 1, {4 * depth})")


def candidates(reps: DataFrame, percent: int) -> DataFrame:
    """(a, b, differences), a < b: pairs of neighbours of the forest that may be linked.

    ``reps`` (node, n_shingles, forest, s0, s1), one row per distinct non-empty set.
    """
    rows = reps.select(F.struct("node", "n_shingles", "s0", "s1").alias("own"), F.inline(F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.cast("byte").alias("tree"), F.substring(F.col("forest"), t * (4 * DEPTH) + 1, F.lit(4 * DEPTH)).alias("seq")))))
    trees = rows.withColumn("region", _prefix(2))
    # Adaptive depth: a crowded region is cut by longer prefixes, then by a hash of the set.
    crowded = trees.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > REGION)
    sized = trees.join(crowded, ["tree", "region"], "left")
    calm = sized.where("size is null").select("own", "tree", "seq", "region", F.lit(0).cast("long").alias("part"))
    deep = sized.where("size is not null").select("own", "tree", "seq", _prefix(4).alias("region"))
    lead = deep.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("size"), F.min("own").alias("lead"))
    dense = deep.join(lead, ["tree", "region"])
    parted = dense.select("own", "tree", "seq", "region", F.pmod(F.xxhash64("own"), F.ceil(F.col("size") / REGION)).alias("part"))
    w = Window.partitionBy("tree", "region", "part").orderBy("seq", "own.node")
    near = calm.unionByName(parted).select("own", F.array(*(F.lag("own", i).over(w) for i in range(1, NEIGHBOURS + 1)), F.first("own").over(w)).alias("others"))
    pairs = near.select("own", F.explode(F.array_distinct(F.array_compact("others"))).alias("other")).unionByName(
        dense.where(F.col("size") > REGION).select("own", F.col("lead").alias("other")))
    small, large = F.least("own.n_shingles", "other.n_shingles"), F.greatest("own.n_shingles", "other.n_shingles")
    return pairs.where((F.col("own.node") != F.col("other.node")) & (100 * small >= percent * large)).select(
        F.least("own.node", "other.node").alias("a"), F.greatest("own.node", "other.node").alias("b"), _differences("own", "other").alias("differences")).where(
        F.col("differences") <= most_differences(percent)).groupBy("a", "b").agg(F.min("differences").alias("differences"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that are linked on their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select(
        "a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("both"))
    return met.where(100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node with an edge (a, b) can reach.

    Alternating star rounds: every neighbour above a node is tied to the least of its neighbours, then every node to the
    least below it, until nothing changes; the rounds grow with the logarithm of a component's size. Sums tell whether
    anything changed, so a round costs five small shuffles.
    """
    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        kept = cut(df.where("a <> b").distinct())
        row = kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))).first()
        return kept, tuple(row)

    stars, mark = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.inline(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        stars, now = written(small)
        if now == mark:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that stand together with one value in the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if high > low:
                if held and held[0].column(0)[0].as_py() != ids[low]:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Block:
    """Sets of one region, or of two chunks of it, and which of them are to be compared."""

    def __init__(self, rows: pa.Table, percent: int):
        of = lambda name: rows.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        self.node, self.size, self.component, self.chunk = of("node"), of("n_shingles"), of("component"), of("chunk")
        self.s0, self.s1 = of("s0").view(np.uint64), of("s1").view(np.uint64)
        self.tree = rows.column("tree")[0].as_py()
        self.places = rows.column("places").combine_chunks().flatten().to_numpy().reshape(len(self.node), TREES)[:, : self.tree]
        self.percent, self.most = percent, most_differences(percent)
        self.chunks = bool((self.chunk != self.chunk[0]).any())
        _, self.label, sizes = np.unique(self.component, return_inverse=True, return_counts=True)
        # Of two sets in different components at least one is outside the largest.
        self.outside = np.flatnonzero(self.label != sizes.argmax()).tolist()

    def near(self, i: int) -> np.ndarray:
        """Sets in other components that may be linked with ``i`` and meet it in no earlier tree."""
        go = self.label != self.label[i]
        if self.chunks:
            go &= self.chunk != self.chunk[i]
        go &= (100 * self.size >= self.percent * self.size[i]) & (100 * self.size[i] >= self.percent * self.size)
        at = np.flatnonzero(go)
        total = np.zeros(len(at), np.int64)
        for s in (self.s0, self.s1):
            x = s[at] ^ s[i]
            total += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
        at = at[total <= self.most]
        return at[~(self.places[at] == self.places[i]).any(axis=1)]


def _meeting(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(place, tree, node): the sets that have one in another component to be compared with."""
    for rows in _blocks(batches):
        block = _Block(rows, percent)
        met = np.zeros(len(block.node), bool)
        for i in block.outside:
            near = block.near(i)
            if len(near):
                met[i] = True
                met[near] = True
        if met.any():
            n = int(met.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rows.column("place")[0].as_py())), pa.array(np.full(n, block.tree, np.int32)), pa.array(block.node[met])], names=["place", "tree", "node"])


def _tied(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b): components that a pair of sets links, no more of them in a block than join what belongs together."""
    for rows in _blocks(batches):
        block = _Block(rows, percent)
        lists = rows.column("shingles").combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(block.size)])
        words, ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        mark = np.zeros(len(words), bool)
        out: list[list[int]] = [[], []]
        for i in block.outside:
            near = block.near(i)
            if not len(near):
                continue
            own = ids[offsets[i] : offsets[i + 1]]
            mark[own] = True
            if 4 * len(near) < len(block.node):
                both = np.array([np.count_nonzero(mark[ids[offsets[j] : offsets[j + 1]]]) for j in near.tolist()])
            else:
                both = np.diff(np.concatenate([[0], np.cumsum(mark[ids])])[offsets])[near]
            mark[own] = False
            linked = near[100 * both >= percent * (block.size[i] + block.size[near] - both)]
            if len(linked):
                labels, first = np.unique(block.label[linked], return_index=True)
                out[0].extend([int(block.component[i])] * len(first))
                out[1].extend(block.component[linked[first]].tolist())
                block.label[np.isin(block.label, labels)] = block.label[i]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])


def _dealt(rows: DataFrame, chunks: Column) -> DataFrame:
    """``rows`` of every place in blocks: each of its ``chunks`` with itself and with every other one, a block's rows side by side."""
    own = F.pmod(F.xxhash64("node"), chunks)
    dealt = rows.withColumn("chunk", own).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    block = F.xxhash64("place", F.least("chunk", "_with"), F.greatest("chunk", "_with"))
    return dealt.select(block.alias("block"), *(c for c in dealt.columns if c not in ("_with", "_n"))).repartition("block").sortWithinPartitions("block")


def remaining_ties(reps: DataFrame, placed: DataFrame, sets: DataFrame, full_sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame | None:
    """(a, b): components to be joined because sets that share a region at depth two are linked; None where there are none to compare.

    ``placed`` (node, component) for every one of ``reps``; ``sets`` (node, shingles) the full sets known so far, and
    ``full_sets`` gives those of further nodes (node).
    """
    places = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring(F.col("forest"), t * (4 * DEPTH) + 1, F.lit(8))))
    rows = reps.select("node", "n_shingles", "s0", "s1", places.alias("places")).join(placed, "node")
    at = F.posexplode("places").alias("tree", "place")
    crowds = written(rows.select("component", at).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where(
        f"n > {COVERED} and low < high").select("place", F.ceil(F.col("n") / BLOCK).alias("_n")))
    mixed = rows.select("*", at).join(crowds, "place")
    met = written(_dealt(mixed, F.col("_n")).mapInArrow(lambda batches: _meeting(batches, percent), "place long, tree int, node long").distinct())
    if met.isEmpty():
        return None
    more = written(met.select("node").distinct().join(sets.select("node"), "node", "left_anti"))
    known = sets.unionByName(cut(full_sets(more)))
    shares = met.join(rows, "node")
    sizes = shares.groupBy("place").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("_n"))
    heavy = shares.join(sizes, "place").join(known, "node")
    return _dealt(heavy, F.col("_n")).mapInArrow(lambda batches: _tied(batches, percent), "a long, b long")


def text_key() -> Column:
    """What tells the texts of rows with one doc_id apart."""
    return F.xxhash64("text")


def link_documents(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Words are lower-cased (A-Z) and documents linked where 100 * intersection >= percent * union of their sets of distinct
    ``words``-word shingles; fewer words make one shingle. component_id is the smallest doc_id reachable, kept whether it is
    the row's own. Without words a document is linked with nothing. Equal texts, or repeated rows, share a component. A row
    with a null doc_id takes no part: its component_id is null and it is kept. Other columns are not read; an empty table
    gives no rows. Rows that share a doc_id but not their text are linked each by its own text.
    """
    return _classes(docs, percent, words).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _classes(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, component, component_id) for every row; component is a number of this run, null where
    nothing can be linked. Two components may have one component_id, where rows share a doc_id."""
    source = docs.select(F.col("doc_id").cast("long"), "text")
    signed = cut(source.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(
        lambda batches: _signed(batches, words), "doc_id long, text_key long, n_shingles long, set_key binary, forest binary, s0 long, s1 long"))
    known = signed.where("set_key is not null and doc_id is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "forest", "s0", "s1")))
    reps = cut(classes.withColumn("node", F.monotonically_increasing_id()))  # numbers of this run, fixed by writing them
    pairs = cut(candidates(reps, percent))

    def full_sets(nodes: DataFrame) -> DataFrame:
        texts = nodes.join(reps.select("node", "set_key", "rep"), "node").join(source.withColumnRenamed("doc_id", "rep"), "rep").select("set_key", "text", "node")
        return texts.mapInArrow(lambda batches: _full_sets(batches, words), "node long, shingles array<long>")

    sets = cut(full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    # First each set's closest candidate; then whatever still runs between different components.
    closest = pairs.groupBy("b").agg(F.min(F.struct("differences", "a")).alias("m")).select("m.a", "b")
    links = cut(_confirmed(closest, sets, percent))
    found = cut(components(links))
    of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"{x}_in"))
    placed = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("a_in", F.coalesce("a_in", "a")).withColumn("b_in", F.coalesce("b_in", "b"))
    open_pairs = cut(placed.where("a_in <> b_in"))
    ties = _confirmed(open_pairs, sets, percent).join(open_pairs, ["a", "b"]).select(F.col("a_in").alias("a"), F.col("b_in").alias("b"))
    joined_up = components(ties).select(F.col("node").alias("component"), F.col("component").alias("top"))
    least = reps.select("node", "set_key", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).join(
        joined_up, "component", "left").select("node", "set_key", "rep", F.coalesce("top", "component").alias("component"))
    # Then every pair that shares a region but, so far, no component.
    least = written(least)
    further = remaining_ties(reps, least.select("node", "component"), sets, full_sets, percent)
    if further is not None:
        tops = components(further).select(F.col("node").alias("component"), F.col("component").alias("top"))
        least = least.join(tops, "component", "left").withColumn("component", F.coalesce("top", "component"))
    named = least.join(least.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("set_key", "component", "component_id")
    joined = known.select("doc_id", "text_key", "n_shingles", "set_key").join(named, "set_key").drop("set_key")
    alone = signed.where("set_key is null or doc_id is null").select(
        "doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone)


def drop_near_copies(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest doc_id; all columns stay.

    Rows without words or without doc_id stay. Where rows share a doc_id, each is judged by its own text; the text with the
    smaller hash stands first. Of rows equal in doc_id and text one stays.
    """
    classes = _classes(docs, percent, words).where("doc_id is not null")
    first = classes.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select("k.*")
    kept = first.unionByName(classes.where("component is null").select("doc_id", "text_key")).distinct().select(F.col("doc_id").alias("__doc"), "text_key")
    own = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("__doc"), text_key().alias("text_key"))
    chosen = own.join(kept, ["__doc", "text_key"], "left_semi").dropDuplicates(["__doc", "text_key"])
    return chosen.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)).unionByName(docs.where("doc_id is null"))
