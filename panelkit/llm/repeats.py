"""Substring dedup with prefix-partitioned suffix trees over words.

Every word starts a suffix.  Suffixes are split into groups by a prefix of
variable length: a first pass counts one-word prefixes, then two-word ones
under the frequent one-word ones, and so on, and each suffix goes by its
shortest prefix that is not frequent.  The table of frequent prefixes holds
at most ``SHARE`` entries per length, whatever the input, and is broadcast.

A group is the subtree below its prefixes.  Its suffixes are sorted by the
label of their path down to ``window`` words; equal neighbours are the leaves
below one internal node of at least that depth, a repeat.  All leaves of a
node but those of its smallest doc_id are reported.  Overlapping reports
merge into maximal covered spans when the words are taken out.

Path labels travel as 64-bit hashes (56 bits inside a group), with document
and position as small deltas, packed by the thousands into binary rows.
Repeats inside one map batch are settled there, so a passage that a third of
all documents share reaches its group once per batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.words import Batch, gathered, gram_hashes, gram_mask, mix, owner

WINDOW = 13
SHARE = 4096                     # a prefix is frequent above 1/SHARE of all suffixes
GROUP = 2_000_000                # suffixes of a group, about
MAP_BYTES = 1 << 22              # text of a map batch
BUCKET_BYTES = 1 << 23           # text of a document bucket
_NONE = np.iinfo(np.int64).max   # stands for a null doc_id: after all others
_U64 = np.uint64


def _tags(texts: Batch) -> np.ndarray:
    """16-bit text checksums: tell rows of equal doc_id apart."""
    raw, off = memoryview(texts.data), texts.offsets
    return np.fromiter((zlib.crc32(raw[off[k]:off[k + 1]]) & 0xFFFF for k in range(len(off) - 1)),
                       np.uint16, len(off) - 1)


def _bucket(doc_ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc_ids.view(np.uint64)) % _U64(n)).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NONE).to_numpy(zero_copy_only=False).copy()


class _Suffixes:
    """The suffixes of a batch that are ``window`` words long or longer."""

    def __init__(self, part: pa.RecordBatch, window: int):
        ids = _ids(part.column("doc_id"))
        if len(ids) > 1 and (np.diff(ids) < 0).any():
            order = np.argsort(ids, kind="stable")
            part, ids = part.take(pa.array(order)), ids[order]
        self.text = Batch.of(part.column("text"))
        starts, ends, self.bounds = self.text.spans()
        self.ids, self.n_words = ids, len(starts)
        self.words = self.text.hashes(starts, ends)
        self.at = np.flatnonzero(gram_mask(self.bounds, self.n_words, window)) \
            if self.n_words >= window else np.zeros(0, np.int64)

    def prefixes(self, at: np.ndarray, above: np.ndarray, width: int) -> np.ndarray:
        """Labels of the ``width``-word prefixes, from those one word shorter."""
        return mix(above ^ self.words[at + (width - 1)])


def _count_prefixes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, "text", MAP_BYTES):
            s = _Suffixes(part, window)
            rows = [(0, 0, len(s.at)), (-1, 0, int(s.text.offsets[-1]))]
            at, least = s.at, max(2, len(s.at) // SHARE)
            acc = np.zeros(len(at), np.uint64)
            for width in range(1, window + 1):
                acc = s.prefixes(at, acc, width)
                values, inverse, counts = np.unique(acc, return_inverse=True, return_counts=True)
                heavy = counts >= least
                rows += [(width, int(v), int(c)) for v, c in zip(values[heavy].view(np.int64), counts[heavy])]
                below = heavy[inverse]
                at, acc = at[below], acc[below]
                if not len(at):
                    break
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                             names=["width", "prefix", "n"])
    return run


def _encode(values: np.ndarray) -> bytes:
    """Ascending or small non-negative integers, compressed."""
    top = int(values.max()) if len(values) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _decode(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[raw[0]], offset=1).astype(np.int64)


def _pack(doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> list[bytes]:
    """Places ordered by (doc, pos) as: doc ids, tags, places per doc, deltas."""
    if not len(doc):
        return [b"", b"", b"\x01", b"\x01"]
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    head = np.flatnonzero(new)
    delta = np.empty(len(pos), np.int64)
    delta[0] = pos[0]
    delta[1:] = np.where(new[1:], pos[1:], pos[1:] - pos[:-1])
    return [ids[doc[head]].astype(np.int64).tobytes(), tags[doc[head]].astype(np.uint16).tobytes(),
            _encode(np.diff(np.append(head, len(doc)))), _encode(delta)]


def _unpack(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc id, tag and position of every place."""
    ids, tags = np.frombuffer(parts[0], np.int64), np.frombuffer(parts[1], np.uint16)
    n, delta = _decode(parts[2]), _decode(parts[3])
    head = np.cumsum(n) - n
    total = np.cumsum(delta)
    base = np.repeat(total[head] - delta[head], n) if len(n) else total
    return np.repeat(ids, n), np.repeat(tags, n), (total - base).astype(np.int32)


_PLACES = "ids binary, tags binary, runs binary, deltas binary"
_LOCAL = "l_ids binary, l_tags binary, l_runs binary, l_deltas binary"


def _split(window: int, groups: int, sub: int, tables):
    """Map side: suffixes to their groups; repeats inside the batch settled."""
    def group_of(s: _Suffixes, at: np.ndarray, label: np.ndarray) -> np.ndarray:
        out, left = np.empty(len(at), np.uint64), np.arange(len(at))
        acc = np.zeros(len(at), np.uint64)
        for width in range(1, window + 1):
            acc = s.prefixes(at[left], acc, width)
            table = tables.value.get(width)
            frequent = np.isin(acc, table) if table is not None and width < window else np.zeros(len(left), bool)
            out[left[~frequent]] = acc[~frequent]
            left, acc = left[frequent], acc[frequent]
            if not len(left):
                break
        if sub > 1:                     # subtrees too large for one task
            out = mix(out + label % _U64(sub))
        return (out % _U64(groups)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, "text", MAP_BYTES):
            s = _Suffixes(part, window)
            if not len(s.at):
                continue
            tags, doc_of = _tags(s.text), owner(s.bounds)[s.at]
            label = gram_hashes(s.words, window)[s.at]
            pos = s.at - s.bounds[doc_of]
            order = np.argsort(label, kind="stable")
            ranked = label[order]
            head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            runs = np.diff(np.append(head, len(order)))
            first = np.repeat(s.ids[doc_of[order[head]]], runs)
            settled = np.zeros(len(order), bool)
            settled[order] = s.ids[doc_of[order]] > first
            sent, gone = np.flatnonzero(~settled), np.flatnonzero(settled)
            gid = group_of(s, s.at[sent], label[sent])
            by = np.argsort(gid, kind="stable")
            cuts = np.searchsorted(gid[by], np.arange(groups + 1))
            gone_gid = _bucket(s.ids, groups)[doc_of[gone]]
            gone_by = np.argsort(gone_gid, kind="stable")
            gone_cuts = np.searchsorted(gone_gid[gone_by], np.arange(groups + 1))
            rows = []
            for g in np.flatnonzero(np.diff(cuts) + np.diff(gone_cuts)):
                mine = sent[by[cuts[g]:cuts[g + 1]]]
                local = gone[gone_by[gone_cuts[g]:gone_cuts[g + 1]]]
                labels = np.ascontiguousarray(label[mine]).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
                rows.append((int(g), labels, *_pack(doc_of[mine], pos[mine], s.ids, tags),
                             *_pack(doc_of[local], pos[local], s.ids, tags)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))],
                names=["gid", "labels", "ids", "tags", "runs", "deltas", "l_ids", "l_tags", "l_runs", "l_deltas"])
    return run


def _subtree(buckets: int):
    """Reduce side: the deep nodes of one group's subtree."""
    def run(table: pa.Table) -> pa.Table:
        labels, places, local = [], [], []
        for batch in table.to_batches():                # a few blobs at a time
            for row in batch.to_pylist():
                raw = np.frombuffer(row["labels"], np.uint8).reshape(-1, 7)
                wide = np.zeros((len(raw), 8), np.uint8)
                wide[:, :7] = raw
                labels.append(wide.view(np.uint64).ravel())
                places.append(_unpack([row["ids"], row["tags"], row["runs"], row["deltas"]]))
                local.append(_unpack([row["l_ids"], row["l_tags"], row["l_runs"], row["l_deltas"]]))
        label = np.concatenate(labels)
        doc, tag, pos = (np.concatenate([p[k] for p in places]) for k in range(3))
        del labels, places
        order = np.argsort(label, kind="stable")
        ranked = label[order]
        if len(ranked):
            head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            least = np.minimum.reduceat(doc[order], head)
            later = order[doc[order] > np.repeat(least, np.diff(np.append(head, len(order))))]
            del ranked, label
        else:
            later = order
        doc, tag, pos = (np.concatenate([x[later]] + [p[k] for p in local])
                         for k, x in enumerate((doc, tag, pos)))
        return _places_by_bucket(doc, tag, pos, buckets)
    return run


_HITS = f"bucket int, {_PLACES}"


def _places_by_bucket(doc, tag, pos, buckets) -> pa.Table:
    bucket = _bucket(doc, buckets) if len(doc) else np.zeros(0, np.int64)
    order = np.lexsort((pos, tag, doc, bucket))
    doc, tag, pos, bucket = doc[order], tag[order], pos[order], bucket[order]
    head = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(doc) else []
    ends = np.append(head[1:], len(doc)) if len(doc) else []
    row_of = np.zeros(len(doc), np.int64)
    if len(doc):
        row_of[1:] = np.cumsum((doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))
    first = np.unique(row_of, return_index=True)[1] if len(doc) else np.zeros(0, np.int64)
    rows = [(int(bucket[a]), *_pack(row_of[a:b], pos[a:b], doc[first], tag[first])) for a, b in zip(head, ends)]
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.table([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(cols)],
                    names=["bucket", "ids", "tags", "runs", "deltas"])


def _take_out(window: int, ids_type: pa.DataType):
    import zstandard

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        found: dict[tuple, list] = {}
        for row in hits.select(["ids", "tags", "runs", "deltas"]).to_pylist():
            doc, tag, pos = _unpack([row["ids"], row["tags"], row["runs"], row["deltas"]])
            if len(doc):
                head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))))
                for a, b in zip(head, np.append(head[1:], len(doc))):
                    found.setdefault((int(doc[a]), int(tag[a])), []).append(pos[a:b])
        out = []
        unpack = zstandard.ZstdDecompressor().decompress
        for doc, z in zip(docs.column("doc_id").to_pylist(), docs.column("z").to_pylist()):
            raw = unpack(z)
            words = raw.split()
            hit = found.get((_NONE if doc is None else doc, zlib.crc32(raw) & 0xFFFF)) if found else None
            spans = []
            if hit:
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(np.concatenate(hit))
                edge[starts] += 1
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                cut = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(cut[::2], cut[1::2])]
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            else:
                kept = words
            out.append((doc, len(words), len(words) - len(kept), b" ".join(kept).decode(), spans))
        cols = list(zip(*out)) if out else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(),
                 pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)],
                        names=["doc_id", "n_words", "n_removed", "kept", "spans"])
    return run


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd frames, for the shuffle."""
    import zstandard
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        texts = b.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("size_hint"), pa.array([squeeze(t) for t in texts], pa.binary())],
            names=["doc_id", "bucket", "z"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (words joined by one space)
    and spans (start, end) of the removed words.

    A word goes when a window of ``window`` words around it also starts in a
    document with a smaller doc_id.  Null or empty texts have no words.  A
    null doc_id counts as larger than any other.  Rows with equal doc_id are
    not repeats of each other.  Texts shorter than the window stay whole.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = source.mapInArrow(_count_prefixes(window), "width long, prefix long, n long") \
        .groupBy("width", "prefix").agg(F.sum("n").alias("n"))
    totals = {"suffixes": 0, "bytes": 0}
    tables: dict[int, np.ndarray] = {}
    counted = counted.persist()
    for row in counted.where("width <= 0").collect():
        totals["suffixes" if row.width == 0 else "bytes"] = row.n
    frequent = counted.where((F.col("width") > 0) & (F.col("n") > max(1, totals["suffixes"] // SHARE)))
    for row in frequent.collect():                  # at most SHARE per length
        tables.setdefault(row.width, []).append(row.prefix)
    counted.unpersist()
    tables = {w: np.sort(np.array(v, np.int64).view(np.uint64)) for w, v in tables.items()}
    groups = max(1, -(-totals["suffixes"] // GROUP))
    sub = max(1, -(-2 * totals["suffixes"] // (SHARE * GROUP)))
    buckets = max(1, -(-totals["bytes"] // BUCKET_BYTES))
    shared = spark.sparkContext.broadcast(tables)
    hits = source.mapInArrow(_split(window, groups, sub, shared), f"gid int, labels binary, {_PLACES}, {_LOCAL}") \
        .groupBy("gid").applyInArrow(_subtree(buckets), _HITS)
    by_bucket = source.withColumn("size_hint", F.lit(0)).mapInArrow(
        _with_bucket(buckets), "doc_id long, bucket int, z binary")
    return by_bucket.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(
        _take_out(window, pa.int64()),
        "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>")


def _with_bucket(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbered():
            for b in batches:
                bucket = _bucket(_ids(b.column("doc_id")), buckets) if b.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(bucket, pa.int32()), b.column("text")],
                    names=["doc_id", "size_hint", "text"])
        yield from _squeezed(numbered())
    return run
