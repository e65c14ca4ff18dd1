"""N-gram Jaccard self-join with signature trees.

A document is the set of its 5-word shingles; two link when the Jaccard
similarity of their sets is 0.75 or more, and components of links are the
near-duplicate classes.

1. One pass sketches every document: set size, set fingerprint (documents
   with equal sets are one node from here on) and ``BANDS`` keys of
   ``ROWS`` MinHash values.  A linked pair shares no key with probability
   (1 - 0.75 ** ROWS) ** BANDS < 1e-9 at the threshold, less above it.
2. Nodes that share a key form blocks (components of key sharing, found by
   a distributed label propagation); other nodes link with nothing.
3. Every block's sets meet in a task as signature trees: a leaf holds the
   token bitmaps of a few documents, an inner node the OR of its children
   and their size range.  A dual traversal drops node pairs whose sizes are
   too far apart, whose bitmaps cannot overlap enough, or which are linked
   already; what is left is verified exactly, set against set.
4. A block of more than ``BLOCK`` nodes is first compared with a few pivots;
   nodes that link to the same pivot are one group from then on.  The groups
   are cut into pieces of ``BLOCK`` nodes, and pairs of pieces of different
   groups (and pieces of unlinked nodes) are tasks of their own, so no task
   holds an unbounded group and a group of near copies costs one comparison
   each.
5. Components of the verified links give the classes.

With ``count_links`` every pair that the traversal leaves is verified, also of
nodes that are connected already, and each node's links are summed in the task
that verifies them, weighted by the number of documents behind the other node;
so links are counted without being listed.  Blocks are then cut into pieces by
hash and all pairs of pieces meet, which costs the square of a block: that is
how many links there can be.  Without it, a class costs one comparison a node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import as_row, doc_key, from_row, has_word
from panelkit.llm.components import components
from panelkit.llm.words import Batch, gram_hashes, mix, slices
from panelkit.session import scratch_path

SHINGLE, NUM, DEN = 5, 75, 100         # words of a shingle; the threshold NUM / DEN
BANDS, ROWS = 38, 3
BLOCK, LEAF, PIVOTS = 2000, 16, 6
PAIR_COST = 400_000                    # multiplications worth as much as one comparison of two sets
TOKEN_SLICE, PAIRS_AT_ONCE = 2048, 1 << 20
BROADCAST_BLOCKS = 100_000
_U64 = np.uint64
_rng = np.random.default_rng(75)
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _U64(2) + _U64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All documents' sorted shingle sets, end to end, and their bounds."""
    text = Batch.of(texts)
    starts, ends, bounds = text.spans()
    words = text.hashes(starts, ends, lower=True)
    grams = gram_hashes(words, SHINGLE)
    sets = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= SHINGLE:
            sets.append(np.unique(grams[lo:hi - SHINGLE + 1]))
        elif hi > lo:
            sets.append(mix(gram_hashes(words[lo:hi], hi - lo) + _U64(hi - lo)))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def _nodes(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Order-free 64-bit fingerprint of every non-empty set."""
    at = bounds[:-1]
    return mix(np.add.reduceat(mix(tokens), at) ^ mix(np.bitwise_xor.reduceat(mix(tokens + _U64(1)), at)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        tokens, bounds = shingle_sets(part.column("text"))
        n = np.diff(bounds)
        full = np.flatnonzero(n)
        node, keys = np.zeros(len(n), np.int64), [None] * len(n)
        if len(full):
            at = bounds[:-1][full]
            packed = np.append(at, bounds[-1])
            node[full] = _nodes(tokens, packed).view(np.int64)
            bands = np.empty((len(full), BANDS), np.uint64)
            for b in range(BANDS):
                acc = np.full(len(full), _U64(b), np.uint64)
                for k in range(b * ROWS, b * ROWS + ROWS):
                    acc = mix(acc ^ np.minimum.reduceat((tokens ^ _XOR[k]) * _MUL[k], at))
                bands[:, b] = acc
            for i, d in enumerate(full.tolist()):
                keys[d] = bands[i].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_key"), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
             pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n", "node", "keys"])


_SETS = "node long, block long, weight long, tokens binary"
_FOUND = "a long, b long, n long"


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token sets of the nodes; a row whose text only shares the hash of the
    node's text is told apart by the set's fingerprint and left out."""
    for part in slices(batches, "text"):
        tokens, bounds = shingle_sets(part.column("text"))
        full = np.flatnonzero(np.diff(bounds))
        mine = np.zeros(len(bounds) - 1, bool)
        if len(full):
            found = _nodes(tokens, np.append(bounds[:-1][full], bounds[-1])).view(np.int64)
            mine[full] = found == part.column("node").to_numpy()[full]
        raw = [tokens[a:b].tobytes() for a, b, m in zip(bounds[:-1], bounds[1:], mine) if m]
        kept = pa.array(mine)
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c).filter(kept) for c in ("node", "block", "weight")), pa.array(raw, pa.binary())],
            names=["node", "block", "weight", "tokens"])


class _Links:
    """Components of the documents of a task, with the links found."""

    def __init__(self, n: int):
        self.comp, self.found = np.arange(n), []

    def add(self, a: int, b: int) -> None:
        x, y = self.comp[a], self.comp[b]
        self.comp[self.comp == y] = x
        self.found.append((a, b))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    if DEN * len(x) < NUM * len(y) or not len(x):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return DEN * both >= NUM * (len(x) + len(y) - both)


class _Tree:
    """Signature tree over documents ordered by set size.

    Level 0 are single documents; each next level ORs ``LEAF`` nodes."""

    def __init__(self, sets: list[np.ndarray], order: np.ndarray, bits: int):
        self.order = order
        words = bits // 64
        sig = np.zeros((len(order), words), np.uint64)
        for i, d in enumerate(order):
            h = sets[d] % _U64(bits)
            np.bitwise_or.at(sig[i], (h >> _U64(6)).astype(np.int64), _U64(1) << (h & _U64(63)))
        size = np.array([len(sets[d]) for d in order])
        spare = size - np.bitwise_count(sig).sum(axis=1).astype(np.int64)
        self.levels = [(sig, size, size, spare)]
        while len(self.levels[-1][0]) > 1:
            sig, low, high, spare = self.levels[-1]
            at = np.arange(0, len(sig), LEAF)
            self.levels.append((np.bitwise_or.reduceat(sig, at), np.minimum.reduceat(low, at),
                                np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at)))


def _possible(a, i: np.ndarray, b, j: np.ndarray) -> np.ndarray:
    """Which pairs of nodes (a[i], b[j]) can hold a linked pair."""
    near = (NUM * a[1][i] <= DEN * b[2][j]) & (NUM * b[1][j] <= DEN * a[2][i])
    i, j = i[near], j[near]
    overlap = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1).astype(np.int64) + np.minimum(a[3][i], b[3][j])
    # A link needs (NUM + DEN) * overlap >= NUM * (size + size).
    ok = (NUM + DEN) * overlap >= NUM * (a[1][i] + b[1][j])
    near[np.flatnonzero(near)[~ok]] = False
    return near


def _candidates(left: _Tree, right: _Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document pairs that the dual traversal leaves, a node pair's at a time;
    a tree against itself gives each pair once."""
    same = left is right
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        # Open the higher node (both when level); children of one node are
        # tested against the other side together.
        kids_i = np.array([i]) if la < lb or la == 0 else \
            np.arange(i * LEAF, min((i + 1) * LEAF, len(left.levels[la - 1][0])))
        kids_j = np.array([j]) if lb < la or lb == 0 else \
            np.arange(j * LEAF, min((j + 1) * LEAF, len(right.levels[lb - 1][0])))
        na, nb = (la if la < lb or la == 0 else la - 1), (lb if lb < la or lb == 0 else lb - 1)
        gi, gj = (x.ravel() for x in np.meshgrid(kids_i, kids_j, indexing="ij"))
        if same and na == nb:
            keep = gi <= gj if na else gi < gj
            gi, gj = gi[keep], gj[keep]
        ok = _possible(left.levels[na], gi, right.levels[nb], gj)
        gi, gj = gi[ok], gj[ok]
        if na == 0 and nb == 0:
            if len(gi):
                yield left.order[gi], right.order[gj]
        else:
            stack.extend((na, a, nb, b) for a, b in zip(gi.tolist(), gj.tolist()))


def _traverse(left: _Tree, right: _Tree, sets: list[np.ndarray], links: _Links) -> None:
    """Links between documents that are not connected yet."""
    for da, db in _candidates(left, right):
        apart = links.comp[da] != links.comp[db]
        for a, b in zip(da[apart].tolist(), db[apart].tolist()):
            if links.comp[a] != links.comp[b] and linked(sets[a], sets[b]):
                links.add(a, b)


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection size of every pair (sets[a[k]], sets[b[k]]): pair by pair,
    or for many pairs of few sets by products of 0/1 matrices, a slice of the
    tokens at a time."""
    rows, row_of = np.unique(a, return_inverse=True)
    cols, col_of = np.unique(b, return_inverse=True)
    tokens, token_of = np.unique(np.concatenate([sets[d] for d in [*rows, *cols]]), return_inverse=True)
    if len(a) * PAIR_COST < len(rows) * len(cols) * len(tokens):
        out = np.empty(len(a), np.int64)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = sorted((sets[x], sets[y]), key=len)
            out[k] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
        return out
    sizes = [len(sets[d]) for d in [*rows, *cols]]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(token_of, kind="stable")
    owner, token_of = owner[order], token_of[order]
    both = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, len(tokens), TOKEN_SLICE):
        x, y = np.searchsorted(token_of, (lo, lo + TOKEN_SLICE))
        held = np.zeros((len(sizes), TOKEN_SLICE), np.float32)
        held[owner[x:y], token_of[x:y] - lo] = 1
        both += held[:len(rows)] @ held[len(rows):].T
    return both[row_of, col_of].astype(np.int64)


def block_counts(sets: list[np.ndarray], weight: np.ndarray, left: np.ndarray, right: np.ndarray | None):
    """Every document's links within ``left``, or between ``left`` and
    ``right``, each worth the other's weight; and (document, document) edges
    that connect what is linked."""
    bits = _bits(sets)
    a = _Tree(sets, _by_size(sets, left), bits)
    b = a if right is None else _Tree(sets, _by_size(sets, right), bits)
    size = np.array([len(s) for s in sets])
    count, label = np.zeros(len(sets), np.int64), np.arange(len(sets))

    def settle(da: np.ndarray, db: np.ndarray) -> None:
        nonlocal label
        both = overlaps(sets, da, db)
        yes = DEN * both >= NUM * (size[da] + size[db] - both)
        da, db = da[yes], db[yes]
        np.add.at(count, da, weight[db])
        np.add.at(count, db, weight[da])
        while (label[da] != label[db]).any():
            low = np.minimum(label[da], label[db])
            for side in (da, db):
                np.minimum.at(label, label[side], low)
            label = label[label]
    held, waiting = [], 0
    for pair in _candidates(a, b):
        held.append(pair)
        waiting += len(pair[0])
        if waiting >= PAIRS_AT_ONCE:
            settle(*(np.concatenate(x) for x in zip(*held)))
            held, waiting = [], 0
    if held:
        settle(*(np.concatenate(x) for x in zip(*held)))
    joined = np.flatnonzero(label != np.arange(len(label)))
    return count, list(zip(joined.tolist(), label[joined].tolist()))


def _bits(sets: list[np.ndarray]) -> int:
    """Width of the token bitmaps: about two bits a token of the largest set."""
    return min(max(64, 1 << int(2 * max(len(s) for s in sets) - 1).bit_length()), 1 << 15)


def _by_size(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    return part[np.argsort([len(sets[d]) for d in part], kind="stable")]


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that connect the documents ``left`` among themselves, or with
    ``right`` when given; pairs that are connected already are not tested."""
    links, bits = _Links(len(sets)), _bits(sets)
    # Most members of a block of copies link with its first document.
    if right is None and len(left) > 2:
        for d in left[1:].tolist():
            if linked(sets[left[0]], sets[d]):
                links.add(int(left[0]), d)
    a = _Tree(sets, _by_size(sets, left), bits)
    b = a if right is None else _Tree(sets, _by_size(sets, right), bits)
    _traverse(a, b, sets, links)
    return links.found


def _block_task(count_links: bool):
    """Links of every block piece pair in one task's rows: (a, b, 0) connect,
    and with ``count_links`` (a, a, n) says that a has n links there."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pair", "ascending")])
        pair = table.column("pair").to_numpy()
        node, side, weight = (table.column(c).to_numpy() for c in ("node", "side", "weight"))
        tokens = table.column("tokens").to_pylist()
        head = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else []
        rows: list[tuple[int, int, int]] = []
        for lo, hi in zip(head, np.append(head[1:], len(pair)) if len(pair) else []):
            sets = [np.frombuffer(t, np.uint64) for t in tokens[lo:hi]]
            left, right = np.flatnonzero(side[lo:hi] == 0), np.flatnonzero(side[lo:hi] == 1)
            if not len(left):
                continue
            if count_links:
                count, found = block_counts(sets, weight[lo:hi], left, right if len(right) else None)
                rows += [(int(node[lo + k]), int(node[lo + k]), int(count[k])) for k in np.flatnonzero(count).tolist()]
            else:
                found = block_links(sets, left, right if len(right) else None)
            rows += [(int(node[lo + a]), int(node[lo + b]), 0) for a, b in found]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))], names=["a", "b", "n"])
    return run


def _pivot_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hit = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
               for x, y in zip(b.column("tokens").to_pylist(), b.column("p_tokens").to_pylist())]
        yield b.select(["node", "pivot"]).filter(pa.array(hit, pa.bool_()))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("text_key", doc_key(F.col("text")))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n (set size), node (set fingerprint), keys, written once."""
    path = scratch_path(docs.sparkSession, "jaccard-sketches")
    _source(docs).mapInArrow(_sketch, "doc_id long, text_key long, n long, node long, keys array<bigint>") \
        .write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _one_each(rows: DataFrame, named: DataFrame, sketch: DataFrame, name: list[str]) -> DataFrame:
    """``rows`` (with r_doc and r_key) of the documents in ``named``, one per
    ``name``.  Only rows that repeat both doc_id and text need to be reduced,
    so only they are shuffled by name."""
    repeated = sketch.groupBy(F.col("doc_id").alias("t_doc"), F.col("text_key").alias("t_key")).count() \
        .where("count > 1").drop("count")
    same = F.col("r_doc").eqNullSafe(F.col("t_doc")) & (F.col("r_key") == F.col("t_key"))
    found = F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("text_key") == F.col("r_key"))
    once = rows.join(named.join(repeated, same, "left_anti"), found)
    if repeated.limit(1).count() == 0:
        return once
    return once.unionByName(rows.join(named.join(repeated, same, "left_semi"), found).dropDuplicates(name))


def _blocks(sketch: DataFrame) -> DataFrame:
    """(node, comp): blocks of nodes that share band keys."""
    keyed = sketch.where("n > 0").groupBy("node").agg(F.any_value("keys").alias("keys")) \
        .select("node", F.posexplode("keys").alias("band", "key"))
    hubs = keyed.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("c")) \
        .where("c > 1").select(F.col("band").alias("h_band"), F.col("key").alias("h_key"), "hub")
    edges = keyed.join(hubs, (F.col("key") == F.col("h_key")) & (F.col("band") == F.col("h_band"))) \
        .where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    return components(edges)


def node_links(docs: DataFrame, sketch: DataFrame, count_links: bool = False) -> DataFrame:
    """(a, b, n): links that connect the nodes (n = 0) and, with
    ``count_links``, parts of each node's number of links (a = b)."""
    spark = docs.sparkSession
    blocks = _blocks(sketch)
    # The text of one document per node that shares a block.
    reps = sketch.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"),
                                                     F.count("*").alias("weight")) \
        .join(blocks.withColumnRenamed("node", "b_node"), F.col("node") == F.col("b_node")) \
        .select(F.col("rep.doc_id").alias("r_doc"), F.col("rep.text_key").alias("r_key"), F.col("node").alias("r_node"),
                F.col("comp").alias("block"), "weight")
    path = scratch_path(spark, "jaccard-sets")
    _one_each(_source(docs), reps, sketch, ["r_node"]) \
        .select(F.col("r_node").alias("node"), "block", "weight", "text") \
        .mapInArrow(_set_rows, _SETS).write.parquet(path)
    sets = spark.read.parquet(path)
    sizes = sets.groupBy("block").agg(F.count("*").alias("size"))
    large = sizes.where(F.col("size") > BLOCK)
    n_large = large.count()                        # at most nodes / BLOCK blocks
    if n_large <= BROADCAST_BLOCKS:
        large = F.broadcast(large)
    small = sets.join(large, "block", "left_anti")
    n_small = sizes.where(F.col("size") <= BLOCK).agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-n_small // BLOCK))
    links = small.select(F.pmod(F.xxhash64("block"), F.lit(tasks)).alias("task"), F.col("block").alias("pair"),
                         "node", F.lit(0).alias("side"), "weight", "tokens") \
        .groupBy("task").applyInArrow(_block_task(count_links), _FOUND)
    if n_large:
        links = links.unionByName(_all_pieces(sets, large) if count_links else _large_links(sets, large))
    return links


def _met(pieces: DataFrame, pairs: DataFrame, count_links: bool) -> DataFrame:
    """Links of pairs (piece, other) of pieces, a task each."""
    pairs = pairs.withColumn("pair", F.xxhash64("piece", "other"))
    sides = pairs.select("pair", F.col("piece").alias("s_piece"), F.lit(0).alias("side")).unionByName(
        pairs.where("piece <> other").select("pair", F.col("other").alias("s_piece"), F.lit(1).alias("side")))
    return pieces.join(sides, F.col("piece") == F.col("s_piece")) \
        .select(F.col("pair").alias("task"), "pair", "node", "side", "weight", "tokens") \
        .groupBy("task").applyInArrow(_block_task(count_links), _FOUND)


def _all_pieces(sets: DataFrame, large: DataFrame) -> DataFrame:
    """All pairs of nodes of blocks of more than BLOCK nodes, by pairs of
    pieces.  Pairs inside a piece meet in the pair of the piece with itself
    and nowhere else, so every pair of nodes is seen once."""
    pieces = sets.join(large, "block").withColumn("piece", F.xxhash64("block", F.pmod(
        F.xxhash64("node", F.lit(2)), F.ceil(F.col("size") / BLOCK))))
    listed = pieces.select("block", "piece").distinct()
    other = listed.select(F.col("block").alias("o_block"), F.col("piece").alias("other"))
    pairs = listed.join(other, (F.col("block") == F.col("o_block")) & (F.col("piece") < F.col("other"))).select("piece", "other")
    alone = listed.select("piece", F.col("piece").alias("other"))
    inside, across = _met(pieces, alone, True), _met(pieces, pairs, True)
    return inside.unionByName(across)


def _large_links(sets: DataFrame, large: DataFrame) -> DataFrame:
    """Links of blocks of more than BLOCK nodes: pivots, then piece pairs."""
    mine = sets.join(large, "block")
    salts = F.ceil(F.col("size") / BLOCK).cast("int")
    # The node that is smallest under each of PIVOTS hash orders.
    drawn = mine.groupBy("block").agg(*[
        F.min_by("node", F.xxhash64("node", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
    pivot_ids = drawn.select(F.explode(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("node")).distinct()
    pivots = mine.join(pivot_ids, "node", "left_semi").select(
        F.col("block").alias("p_block"), F.col("node").alias("pivot"), F.col("tokens").alias("p_tokens"),
        F.explode(F.sequence(F.lit(0), salts - 1)).alias("p_salt"))
    salted = mine.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
    stars = salted.join(pivots, (F.col("block") == F.col("p_block")) & (F.col("salt") == F.col("p_salt"))) \
        .where("node <> pivot").select("node", "pivot", "tokens", "p_tokens") \
        .mapInArrow(_pivot_task, "node long, pivot long").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    path = scratch_path(sets.sparkSession, "jaccard-stars")
    stars.write.parquet(path)
    stars = sets.sparkSession.read.parquet(path)
    groups = components(stars).select(F.col("node").alias("g_node"), F.col("comp").alias("group"))
    held = mine.join(groups, F.col("node") == F.col("g_node"), "left")
    counts = held.groupBy("block", "group").agg(F.count("*").alias("g_size")) \
        .withColumnsRenamed({"block": "c_block", "group": "c_group"})
    pieces = held.join(counts, (F.col("block") == F.col("c_block")) & F.col("group").eqNullSafe(F.col("c_group"))) \
        .withColumn("piece", F.xxhash64("block", F.coalesce("group", F.lit(0)), F.pmod(
            F.xxhash64("node", F.lit(2)), F.ceil(F.col("g_size") / BLOCK))))
    listed = pieces.select("block", "group", "piece").distinct()
    other = listed.select(F.col("block").alias("o_block"), F.col("group").alias("o_group"),
                          F.col("piece").alias("other"))
    # Pieces of one block meet unless they belong to the same linked group.
    pairs = listed.join(other, (F.col("block") == F.col("o_block")) & (F.col("piece") <= F.col("other"))
                        & ~F.coalesce(F.col("group") == F.col("o_group"), F.lit(False))).select("piece", "other")
    return stars.select("a", "b", F.lit(0).cast("long").alias("n")).unionByName(_met(pieces, pairs, False))


def _classes(docs: DataFrame, sketch: DataFrame, count_links: bool = False) -> DataFrame:
    """The documents with words: doc_id, text_key, n, comp (a node of the
    class), component_id and, with ``count_links``, n_links."""
    found = node_links(docs, sketch, count_links)
    if count_links:
        path = scratch_path(docs.sparkSession, "jaccard-links")      # read for classes and for counts
        found.write.parquet(path)
        found = docs.sparkSession.read.parquet(path)
    links = components(found.where("n = 0")).select(F.col("node").alias("l_node"), "comp")
    nodes = sketch.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("weight"))
    named = nodes.join(links, F.col("node") == F.col("l_node"), "left") \
        .withColumn("comp", F.coalesce("comp", "node"))
    if count_links:
        counts = found.where("n > 0").groupBy(F.col("a").alias("n_node")).agg(F.sum("n").alias("n_links"))
        named = named.join(counts, F.col("node") == F.col("n_node"), "left") \
            .withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1)
    least = named.groupBy("comp").agg(F.min("least").alias("component_id")) \
        .withColumnRenamed("comp", "c_comp")
    more = ["n_links"] if count_links else []
    owner = named.select(F.col("node").alias("o_node"), "comp", *more).join(least, F.col("comp") == F.col("c_comp")) \
        .select("o_node", "comp", "component_id", *more)
    return sketch.where("n > 0").join(owner, F.col("node") == F.col("o_node")) \
        .select("doc_id", "text_key", "n", "comp", "component_id", *more)


def near_duplicates(docs: DataFrame, count_links: bool = False) -> DataFrame:
    """Every document row: doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links, itself included) and, with ``count_links``,
    n_links (documents that it links with, copies included).

    Texts without words have the empty set and link with nothing; a text of
    fewer than five words is one shingle.  Null doc_ids link like any other
    document, but never name a component unless all its ids are null.
    Repeated rows are linked.  Very long texts are shingled whole.
    """
    sketch = sketches(docs)
    more = ["n_links"] if count_links else []
    full = _classes(docs, sketch, count_links).select("doc_id", F.col("n").alias("n_shingles"), "component_id", *more)
    none = [F.lit(0).cast("long").alias(c) for c in more]
    return full.unionByName(sketch.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *none))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, in its own columns: that of the smallest doc_id
    (null ids last), and among rows of that id the one of the smallest text
    hash; of rows that repeat both, any one.  So rows of one id with unlinked
    texts all stay.  Rows without words stay, each of them."""
    sketch = sketches(docs)
    keep = _classes(docs, sketch).groupBy("comp").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")).alias("least")) \
        .select(F.col("least.doc_id").alias("r_doc"), F.col("least.text_key").alias("r_key"))
    rows = as_row(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row_key").alias("text_key"))
    kept = _one_each(rows, keep, sketch, ["doc_id", "text_key"]).select("row")
    empty = as_row(docs.where(~F.coalesce(has_word(F.col("text")), F.lit(False)))).select("row")
    return kept.unionByName(empty).select(*from_row(docs))
