"""Alignment of two tokenizers by galloping intersection of token ends.

A text's bytes are cut twice: by a byte-level BPE (A) and by a piece BPE with
byte fallback (B).  Byte offsets at which both cut are found by galloping: the
shorter list of ends drives an exponential, then binary search into the longer
one.  Common ends slice the tokens into groups, and differences of ranks give
the range of B tokens that each A token overlaps.

**Units.**  Neither tokenizer joins a non-space character to a following space
or line feed, so a text falls into units there whose tokens and links do not
depend on the neighbours.  A task takes about ``SLICE_BYTES`` of text at a time
and treats each distinct unit of the slice once, all of them in lockstep numpy
searches; documents are then sums over their units.

**Corpus counts** of linked id pairs come back without broadcasting them:

1. One pass over the texts writes a table: per document its unit numbers and
   own figures, per slice its units' links and its distinct pairs with counts.
2. Pairs are summed over slices, and the highest count of each B id (at most
   one row per id of the vocabulary) is joined to them.
3. Each slice's pairs get their totals back and meet the slice's documents in
   one partition, sorted by kind, where they are added up as a stream.

A frequent pair is one row per slice, not per occurrence; slices are bounded
by size, so no key gathers more than that.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.words import gathered
from panelkit.session import scratch_path

SLICE_BYTES = 1 << 23               # text whose units are treated together
CHUNK = 1 << 15                     # units that are Python objects at a time
# Unicode White_Space, which the byte-level pattern's \s means.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NO_CUT = WHITE.replace(r"\n", "").replace(r"\r ", r"\r")
SPACE_MARK = "▁"
SHIFT = 16                          # a pair's code: A id << SHIFT | B id
PAIR, UNITS, DOC = 0, 1, 2          # kinds of rows of the written table, in reading order

TABLE = "kind int, slice long, code long, n long, best boolean, doc_id long, n_a long, n_b long, n_groups long, " \
        "n_links long, groups_sha256 string, data binary"
REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, " \
         "groups_sha256 string"


def byte_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _cuts() -> re.Pattern:
    """A unit: white space, then other characters; white space other than
    space and line feed does not end it, nor does any at the text's end
    after such."""
    other, white, held = f"[^{WHITE}]", f"[{WHITE}]", f"[{NO_CUT}]"
    return re.compile(f"{white}*{other}+(?:{held}{white}*{other}+)*(?:{held}{white}*\\Z)?|{white}+")


class Tokenizers:
    """The two tokenizers by unit: ids, and the bytes of every id."""

    def __init__(self, byte_file: str, piece_file: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        with open(byte_file, encoding="utf-8") as f:
            spec = json.load(f)
        # The file writes each byte as a printable character: itself, or the
        # next one from 256 on.  Added tokens are not ordinary tokens.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        added = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in added}
        self.a = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                   special_tokens={}).encode_ordinary
        self.a_len = np.zeros(max(ranks.values()) + 1, np.int64)
        self.a_len[list(ranks.values())] = [len(k) for k in ranks]

        sp = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
        if any("\n" in p or re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces):
            raise ValueError("a piece crosses a space or a line feed: texts cannot be cut there")
        self._sp, self._lone = sp, sp.piece_to_id(SPACE_MARK)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace(SPACE_MARK, " ").encode()
                        for k, p in enumerate(pieces)]
        self.b_len = np.array([len(b) for b in self.b_bytes], np.int64)

    def b(self, units: list[str]) -> list[list[int]]:
        """Ids of the units as they stand in a text.  The processor puts a
        space before what it encodes: a unit's own first space, or one that is
        dropped again before a line feed, to which nothing is joined."""
        out = self._sp.encode([u[1:] if u[0] == " " else u for u in units])
        for k, u in enumerate(units):
            if u == " ":
                out[k] = [self._lone]
            elif u[0] != " ":
                if out[k][:1] != [self._lone]:
                    raise ValueError(f"unit {u!r} cannot be cut off")
                del out[k][0]
        return out


def gallop(ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each row the first index in [lo, hi) with ends[index] >= x, or hi:
    exponential steps from lo on, then binary search between the last two."""
    left, right, step = lo.copy(), lo.copy(), 1
    live = np.flatnonzero(right < hi)
    while len(live):
        live = live[ends[right[live]] < x[live]]
        left[live] = right[live] + 1
        right[live] = np.minimum(right[live] + step, hi[live])
        live = live[right[live] < hi[live]]
        step *= 2
    live = np.flatnonzero(left < right)
    while len(live):
        mid = (left[live] + right[live]) >> 1
        less = ends[mid] < x[live]
        left[live] = np.where(less, mid + 1, left[live])
        right[live] = np.where(less, right[live], mid)
        live = live[left[live] < right[live]]
    return left


class Alignment:
    """Common ends, groups and links of units whose A and B ids lie one after
    the other in ``a`` and ``b``; unit u owns a[a_at[u]:a_at[u + 1]]."""

    def __init__(self, a, a_at, a_len, b, b_at, b_len):
        ends_a, ends_b = np.cumsum(a_len[a]), np.cumsum(b_len[b])
        n_a, n_b = np.diff(a_at), np.diff(b_at)
        unit_a, unit_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        # Number of B ends before each A end, by the shorter list of each unit.
        a_drives = n_a <= n_b
        below, common_a, common_b = np.zeros(len(a), np.int64), np.zeros(len(a), bool), np.zeros(len(b), bool)
        i = np.flatnonzero(a_drives[unit_a])
        at = gallop(ends_b, b_at[unit_a[i]], b_at[unit_a[i] + 1], ends_a[i])
        same = ends_b[at] == ends_a[i]
        below[i], common_a[i] = at, same
        common_b[at[same]] = True
        j = np.flatnonzero(~a_drives[unit_b])
        at = gallop(ends_a, a_at[unit_b[j]], a_at[unit_b[j] + 1], ends_b[j])
        same = ends_a[at] == ends_b[j]
        common_b[j] = same
        common_a[at[same]] = True
        # Ranks the other way round: a B end counts for all A ends after the
        # one it met, and for that one too where they differ.
        inside = np.bincount(at[~same], minlength=len(a) + 1)
        equal = np.bincount(at[same] + 1, minlength=len(a) + 1)
        back = np.flatnonzero(~a_drives[unit_a])
        seen = np.cumsum(inside + equal)
        earlier = np.cumsum(n_b * ~a_drives) - n_b * ~a_drives       # B ends of such units before each unit
        below[back] = (b_at[:-1] - earlier)[unit_a[back]] + seen[back]
        self.common_a, self.common_b, self.below = common_a, common_b, below
        # An A token overlaps the B tokens from the one after the previous A
        # end's rank (the same one, if that end lies inside it) to its own.
        start = np.empty(len(a), np.int64)
        start[1:] = below[:-1] + common_a[:-1]
        start[a_at[:-1][n_a > 0]] = b_at[:-1][n_a > 0]
        width = below - start + 1
        self.links_at = np.concatenate(([0], np.cumsum(width)))[a_at]
        total = int(width.sum())
        ahead = np.cumsum(width) - width
        b_index = np.repeat(start - ahead, width) + np.arange(total)
        self.codes = (np.repeat(a, width).astype(np.int64) << SHIFT) | b[b_index]
        self.n_a, self.n_b = n_a, n_b
        self.n_groups = np.add.reduceat(np.append(common_a, 0), a_at[:-1]) * (n_a > 0) if len(n_a) else n_a
        self.n_links = np.diff(self.links_at)


def group_texts(a, a_at, common_a, b, b_at, common_b) -> list[bytes]:
    """Each unit's groups as ``a1,a2|b1;a3|b2``."""
    a, b, ca, cb = a.tolist(), b.tolist(), common_a.tolist(), common_b.tolist()
    a_at, b_at = a_at.tolist(), b_at.tolist()
    out = []
    for u in range(len(a_at) - 1):
        i, i_end, j, parts = a_at[u], a_at[u + 1], b_at[u], []
        while i < i_end:
            part = str(a[i])
            while not ca[i]:
                i += 1
                part += f",{a[i]}"
            part += f"|{b[j]}"
            while not cb[j]:
                j += 1
                part += f",{b[j]}"
            parts.append(part)
            i, j = i + 1, j + 1
        out.append(";".join(parts).encode())
    return out


class _Numbers(dict):
    """Numbers units in the order they are met."""

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        return n


class Slice:
    """The alignment of some texts, by their distinct units."""

    def __init__(self, texts: list[str | None], tok: Tokenizers, cuts: re.Pattern):
        number = _Numbers()
        # Units as array("I"): four bytes each, whatever the text's length.
        self.docs = [np.frombuffer(array("I", map(number.__getitem__, cuts.findall(" " + t))), np.uint32) if t
                     else np.zeros(0, np.uint32) for t in texts]
        units = list(number)
        number.clear()
        self.good = np.ones(len(units), bool)
        parts = [self._tokens(units[lo:lo + CHUNK], lo, tok) for lo in range(0, len(units), CHUNK)]
        del units
        self.a, self.a_at = _joined([p[:2] for p in parts])
        self.b, self.b_at = _joined([p[2:] for p in parts])
        self.links = Alignment(self.a, self.a_at, tok.a_len, self.b, self.b_at, tok.b_len)
        self.groups = [text for lo in range(0, len(self.good), CHUNK) for text in self._group_texts(lo)]
        # A document with any unit that B cannot write back has no tokens.
        self.docs = [d if self.good[d].all() else d[:0] for d in self.docs]

    def _tokens(self, units: list[str], first: int, tok: Tokenizers) -> tuple:
        ids_a, ids_b = [tok.a(u) for u in units], tok.b(units)
        piece = tok.b_bytes.__getitem__
        for k, (x, u) in enumerate(zip(ids_b, units)):
            if b"".join(map(piece, x)) != u.encode():
                self.good[first + k] = False
                ids_a[k], ids_b[k] = [], []
        return *_flat(ids_a), *_flat(ids_b)

    def _group_texts(self, lo: int) -> list[bytes]:
        hi = min(lo + CHUNK, len(self.good))
        a, b = slice(self.a_at[lo], self.a_at[hi]), slice(self.b_at[lo], self.b_at[hi])
        return group_texts(self.a[a], self.a_at[lo:hi + 1] - self.a_at[lo], self.links.common_a[a],
                           self.b[b], self.b_at[lo:hi + 1] - self.b_at[lo], self.links.common_b[b])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pair codes, their link counts over the documents, and each
        link's place among the codes."""
        times = np.bincount(np.concatenate([np.zeros(0, np.uint32), *self.docs]), minlength=len(self.good))
        codes, place = np.unique(self.links.codes, return_inverse=True)
        weight = np.repeat(times, self.links.n_links)
        return codes, np.bincount(place, weights=weight, minlength=len(codes)).astype(np.int64), place


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    return np.frombuffer(array("I", chain.from_iterable(lists)), np.uint32), list(map(len, lists))


def _joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The chunks' ids end to end, and where each unit's begin."""
    lens = np.array([n for _, ns in parts for n in ns], np.int64)
    return np.concatenate([np.zeros(0, np.int64), *[ids for ids, _ in parts]]).astype(np.int64), \
        np.concatenate(([0], np.cumsum(lens)))


def _pack(x: np.ndarray) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, "<u4").tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def _table(schema: pa.Schema, rows: int, **given) -> pa.RecordBatch:
    cols = []
    for f in schema:
        v = given.get(f.name)
        cols.append(pa.nulls(rows, f.type) if v is None else v if isinstance(v, pa.Array)
                    else pa.array([v] * rows if np.isscalar(v) else v, f.type))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def _scan(paths: tuple[str, str], size: int):
    """Map task of the first pass: the rows of ``TABLE``."""
    schema = _arrow(TABLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, cuts = Tokenizers(*paths), _cuts()
        number = TaskContext.get().partitionId() << 32
        for part in gathered(batches, "text", size):
            cut = Slice(part.column("text").to_pylist(), tok, cuts)
            codes, counts, place = cut.pairs()
            held = np.flatnonzero(counts)
            yield _table(schema, len(held), kind=PAIR, slice=number, code=codes[held], n=counts[held])
            # Links of pairs that no document holds get the number after the last.
            new = np.full(len(codes), len(held))
            new[held] = np.arange(len(held))
            yield _table(schema, 2, kind=UNITS, slice=number, code=[0, 1],
                         data=[_pack(cut.links.n_links), _pack(new[place])])
            sums = {name: [int(v[d].sum()) for d in cut.docs] for name, v in
                    (("n_a", cut.links.n_a), ("n_b", cut.links.n_b), ("n_groups", cut.links.n_groups),
                     ("n_links", cut.links.n_links))}
            text = cut.groups.__getitem__
            sha = [hashlib.sha256(b";".join(map(text, d.tolist()))).hexdigest() if len(d) else "" for d in cut.docs]
            yield _table(schema, part.num_rows, kind=DOC, slice=number, doc_id=part.column("doc_id"),
                         groups_sha256=sha, data=[_pack(d) for d in cut.docs], **sums)
            number += 1
    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``TABLE`` sorted by (slice, kind, code), pairs with corpus
    totals: the report's rows."""
    schema = _arrow(REPORT)
    totals, best, lens, place, unit_sum, unit_best, current = [], [], None, None, None, None, None
    for part in batches:
        kinds, slices = (part.column(c).to_numpy() for c in ("kind", "slice"))
        bounds = np.flatnonzero(np.diff(kinds) | np.diff(slices)) + 1
        for lo, hi in zip([0, *bounds.tolist()], [*bounds.tolist(), len(kinds)]):
            if lo == hi:
                continue
            if slices[lo] != current:
                current, totals, best, lens = slices[lo], [], [], None
            rows = part.slice(lo, hi - lo)
            if kinds[lo] == PAIR:
                totals.append(rows.column("n").to_numpy())
                best.append(rows.column("best").to_numpy(zero_copy_only=False))
            elif kinds[lo] == UNITS:
                for code, data in zip(rows.column("code").to_pylist(), rows.column("data").to_pylist()):
                    if code == 0:
                        lens = _unpack(data)
                    else:
                        place = _unpack(data)
                        value = np.concatenate([*totals, [0]]).astype(np.int64)[place]
                        top = np.concatenate([*best, [False]]).astype(np.int64)[place]
                        ends = np.cumsum(lens, dtype=np.int64)
                        unit_sum, unit_best = (np.concatenate(([0], np.cumsum(v)))[ends]
                                               - np.concatenate(([0], np.cumsum(v)))[ends - lens] for v in (value, top))
            else:
                docs = [_unpack(d) for d in rows.column("data").to_pylist()]
                given = {c: rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                yield _table(schema, len(docs), n_best=[int(unit_best[d].sum()) for d in docs],
                             count_sum=[int(unit_sum[d].sum()) for d in docs], **given)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scanned(docs: DataFrame, byte_file: str | None = None, piece_file: str | None = None,
            size: int = SLICE_BYTES) -> DataFrame:
    """The first pass, written to the shared folder and read again."""
    paths = (byte_file or byte_path(), piece_file or piece_path())
    path = scratch_path(docs.sparkSession, "token-alignment")
    _texts(docs).mapInArrow(_scan(paths, size), TABLE).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(found: DataFrame) -> DataFrame:
    """Corpus counts of linked id pairs, from :func:`scanned`: code, a_id,
    b_id, n and best (n is the highest of its b_id, ties included)."""
    total = found.where(F.col("kind") == PAIR).groupBy("code").agg(F.sum("n").alias("n")) \
        .withColumn("a_id", F.shiftright("code", SHIFT)) \
        .withColumn("b_id", F.col("code").bitwiseAND((1 << SHIFT) - 1))
    # One row per B id: bounded by the vocabulary, whatever the input.
    top = total.groupBy("b_id").agg(F.max("n").alias("top"))
    return total.join(F.broadcast(top), "b_id").select("code", "a_id", "b_id", "n", (F.col("n") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, byte_file: str | None = None, piece_file: str | None = None,
                    size: int = SLICE_BYTES) -> DataFrame:
    """One row per document: ``REPORT``.

    n_a and n_b count tokens of space+text, n_groups the groups between common
    ends, n_links the A-B token pairs that overlap; n_best of those have a pair
    whose corpus count is the highest of its B id, and count_sum adds up the
    corpus counts of all.  groups_sha256 digests the ids, ``a1,a2|b1;a3|b2``.

    Null and empty texts, and texts that the tokens do not write back, have no
    tokens: zeros, and an empty groups_sha256.  Strings of special tokens are
    plain text.  Rows with null or repeated ids and whole repeated rows come
    out (and count) one by one; very long texts are taken whole.  Only doc_id
    and text are read; an empty table gives no rows.
    """
    found = scanned(docs, byte_file, piece_file, size)
    counts = pair_counts(found).select("code", F.col("n").alias("_n"), F.col("best").alias("_best"))
    pairs = found.where(F.col("kind") == PAIR).drop("n", "best").join(counts, "code")
    names = [f.split()[0] for f in TABLE.split(", ")]
    pairs = pairs.withColumnsRenamed({"_n": "n", "_best": "best"}).select(*names)
    rest = found.where(F.col("kind") != PAIR).select(*names)
    return pairs.unionByName(rest).repartition("slice").sortWithinPartitions("slice", "kind", "code") \
        .mapInArrow(_add_up, REPORT)


def aligned_groups(docs: DataFrame, byte_file: str | None = None, piece_file: str | None = None,
                   size: int = SLICE_BYTES) -> DataFrame:
    """The alignment itself: per document its a_ids and b_ids, and for every
    group where it ends in either list (a_ends, b_ends).  Empty arrays for
    documents without tokens."""
    paths = (byte_file or byte_path(), piece_file or piece_path())
    names = ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"]

    def run(batches):
        tok, cuts = Tokenizers(*paths), _cuts()
        schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.list_(pa.int32())) for n in names[1:]]])
        for part in gathered(batches, "text", size):
            cut = Slice(part.column("text").to_pylist(), tok, cuts)
            cols: list[list] = [[], [], [], []]
            for d in cut.docs:
                for k, (ids, at, common) in enumerate(((cut.a, cut.a_at, cut.links.common_a),
                                                       (cut.b, cut.b_at, cut.links.common_b))):
                    take = np.concatenate([np.arange(at[u], at[u + 1]) for u in d.tolist()] or [np.zeros(0, np.int64)])
                    cols[k].append(ids[take])
                    cols[k + 2].append(np.flatnonzero(common[take]) + 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(c, pa.list_(pa.int32())) for c in cols]], schema=schema)
    return _texts(docs).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, "
                                        "b_ends array<int>")
