"""Fill-in-middle transformation by secondary-sort assembly.

A map task cuts every text into prefix, middle and suffix and emits bounded
pieces keyed by (row, output position).  ``repartitionAndSortWithinPartitions``
brings each row's pieces together in output order, and the receiving task
streams them, one at a time, into incremental digests or output texts.  For
restoration the output is split at its markers again and the pieces are
sorted once more, by their place in the text; a row's pieces already lie in
one partition, so :func:`assemble` does that there, while :func:`restore`
starts from stored outputs and shuffles by text position.

A row is known by a digest of (doc_id, text), its map task and a running
number among equal rows of that task.  All pieces of a row go to one
partition in every attempt of the task, so a lost executor costs a rerun and
nothing else; a hot text or doc_id is spread, as each of its rows is dealt on
its own.  Pieces travel compressed.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"P": "<P>", "S": "<S>", "M": "<M>"}
LAYOUT = {"psm": "PSM", "spm": "SPM"}      # segments in output order
TEXT_ORDER = "PMS"                          # segments in text order
CHUNK = 1 << 14                             # code points of a piece
PARTITION_BYTES = 1 << 28                   # text whose pieces one task sorts
LEVEL = 3                                   # zstd level of a piece

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, " \
         "restored_sha256 string"


def unit_offsets(text: str, unit: str | None) -> list[int] | None:
    """Code point offset after each unit; None for single code points.  With a
    pattern, units are its matches from left to right and the last one takes
    the rest of the text."""
    if unit is None:
        return None
    ends = [m.end() for m in re.finditer(unit, text) if m.end() > m.start()]
    if text:
        ends = ends or [len(text)]
        ends[-1] = len(text)
    return ends


def plan(doc_id, text: str, seed: int, plain: int, spm: int, unit: str | None = None):
    """(n units, form, prefix end, middle end) of a text, the ends in code
    points.  Chosen by the sha256 of seed and doc_id alone, so every run and
    every machine agrees; a null doc_id counts as the empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    ends = unit_offsets(text, unit)
    n = len(text) if ends is None else len(ends)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if ends is not None:
        lo, hi = ([0, *ends][k] for k in (lo, hi))
    if not text or any(m in text for m in MARKS.values()) or h[2] % 100 >= plain:
        return n, "plain", None, None
    return n, "spm" if h[3] % 100 < spm else "psm", lo, hi


def segments(text: str, form: str, lo, hi) -> list[str]:
    """The marked segments of the output, in output order."""
    if form == "plain":
        return [text]
    parts = {"P": text[:lo], "M": text[lo:hi], "S": text[hi:]}
    return [MARKS[s] + parts[s] for s in LAYOUT[form]]


class Splitter:
    """Finds the segments of a marked output that arrives in pieces.

    The text holds no marker, a marker starts with ``<`` and ends with ``>``
    and holds neither inside, so the first match of the next marker is always
    the marker itself, also where text and marker meet.
    """

    def __init__(self, form: str):
        self.left = list(LAYOUT.get(form, ""))
        self.segment, self.rest = "P", b""

    def feed(self, piece: bytes) -> Iterator[tuple[str, bytes]]:
        if not self.left:
            yield self.segment, piece
            return
        data = self.rest + piece
        while self.left:
            at = data.find(MARKS[self.left[0]].encode())
            if at < 0:
                break
            if at:
                yield self.segment, data[:at]
            self.segment, data = self.left.pop(0), data[at + 3:]
        keep = min(len(data), 2 if self.left else 0)
        if len(data) > keep:
            yield self.segment, data[:len(data) - keep]
        self.rest = data[len(data) - keep:]

    def end(self) -> Iterator[tuple[str, bytes]]:
        if self.rest:
            yield self.segment, self.rest


def _key(doc, raw: bytes, seen: dict) -> bytes:
    digest = hashlib.blake2b(raw, digest_size=12, key=str(doc).encode()[:64]).digest()
    nth = seen.get(digest, 0)
    seen[digest] = nth + 1
    return digest + struct.pack(">II", TaskContext.get().partitionId(), nth)


def _cut(rows, chunk: int, args: tuple) -> Iterator:
    """((row, output position), (head or None, packed piece)) of every text;
    the head (doc_id and plan) travels with the first piece."""
    import zstandard
    pack, seen = zstandard.ZstdCompressor(level=LEVEL).compress, {}
    for doc, text in rows:
        text = text or ""
        n, form, lo, hi = plan(doc, text, *args)
        row = _key(doc, text.encode(), seen)
        head = (doc, n, form, lo, None if hi is None else hi - lo)
        at = 0
        for part in segments(text, form, lo, hi):
            for start in range(0, max(1, len(part)), chunk):
                yield (row, at), (head, pack(part[start:start + chunk].encode()))
                at, head = at + min(chunk, len(part) - start), None


def _rows(docs: DataFrame) -> RDD:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).rdd


def _partitions(df: DataFrame, column: str) -> int:
    """Partitions for the pieces of a text column.  Adaptive execution does
    not size the shuffles of RDDs, so the volume is measured: one row."""
    total = df.agg(F.sum(F.octet_length(F.col(column).cast("string")).cast("long"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))


def _deal(key: tuple) -> int:
    """Partition of a (row, position) key: by row alone."""
    return zlib.crc32(key[0])


def _in_rows(parts) -> Iterator:
    """The pieces of each row, unpacked, as they come."""
    import zstandard
    unpack = zstandard.ZstdDecompressor().decompress
    for _, group in groupby(parts, key=lambda kv: kv[0][0]):
        yield ((at, head, unpack(packed)) for (_, at), (head, packed) in group)


def _digests(parts) -> Iterator:
    for pieces in _in_rows(parts):
        out, back = hashlib.sha256(), hashlib.sha256()
        held, head = [], None
        for _, first, piece in pieces:
            if first is not None:
                head, split = first, Splitter(first[2])
            out.update(piece)
            if head[2] == "plain":
                back.update(piece)
            else:
                held += [(TEXT_ORDER.index(s), len(held) + k, p) for k, (s, p) in enumerate(split.feed(piece))]
        if held:
            held += [(TEXT_ORDER.index(s), len(held), p) for s, p in split.end()]
            for _, _, piece in sorted(held):
                back.update(piece)
        yield (*head, out.hexdigest(), back.hexdigest())


def _texts(parts) -> Iterator:
    for pieces in _in_rows(parts):
        head, out = None, []
        for _, first, piece in pieces:
            head = first or head
            out.append(piece)
        yield (*head, b"".join(out).decode())


def _pieces(docs: DataFrame, seed: int, plain: int, spm: int, unit: str | None, chunk: int) -> RDD:
    args = (seed, plain, spm, unit)
    return _rows(docs).mapPartitions(lambda rows: _cut(rows, chunk, args)) \
        .repartitionAndSortWithinPartitions(_partitions(docs, "text"), _deal)


def assemble(docs: DataFrame, seed: int = 1, plain: int = 90, spm: int = 20, unit: str | None = None,
             chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``SCHEMA``, digests of the output and of the text
    rebuilt from it.

    ``plain`` and ``spm`` are percentages: a text whose third hash falls at or
    above ``plain`` stays as it is, and of the others ``spm`` percent put the
    suffix first.  ``unit`` is a pattern of the units that may be cut between
    (None: code points).  Null text counts as empty and stays plain, and so
    does a text that holds a marker; prefix_chars and middle_chars are null
    then.  Rows with null or repeated doc_id, and whole repeated rows, come
    out one by one.  Texts of any length are streamed in pieces of ``chunk``
    code points.  Only doc_id and text are read; an empty table gives no rows.
    """
    return docs.sparkSession.createDataFrame(
        _pieces(docs, seed, plain, spm, unit, chunk).mapPartitions(_digests), SCHEMA, verifySchema=False)


def transform(docs: DataFrame, seed: int = 1, plain: int = 90, spm: int = 20, unit: str | None = None,
              chunk: int = CHUNK) -> DataFrame:
    """The output texts: doc_id, n, form, prefix_chars, middle_chars, output."""
    return docs.sparkSession.createDataFrame(
        _pieces(docs, seed, plain, spm, unit, chunk).mapPartitions(_texts),
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", verifySchema=False)


def restore(formed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The texts behind stored outputs (doc_id, form, output): doc_id, text.
    Pieces are keyed by their place in the text and sorted by it."""
    def cut(rows):
        import zstandard
        pack, seen = zstandard.ZstdCompressor(level=LEVEL).compress, {}
        for doc, form, output in rows:
            raw = (output or "").encode()
            row, split, head, places = _key(doc, raw, seen), Splitter(form), (doc,), defaultdict(int)
            found = [(s, part) for k in range(0, max(1, len(raw)), chunk) for s, part in split.feed(raw[k:k + chunk])]
            for s, part in [*found, *split.end()] or [("P", b"")]:
                place = (TEXT_ORDER.index(s), places[s])
                places[s] += 1
                yield (row, place), (head, pack(part))

    rows = formed.select(F.col("doc_id").cast("long").alias("doc_id"), "form", "output").rdd
    return formed.sparkSession.createDataFrame(
        rows.mapPartitions(cut).repartitionAndSortWithinPartitions(_partitions(formed, "output"), _deal).mapPartitions(_texts),
        "doc_id long, text string", verifySchema=False)
