"""Hierarchical multi-length packing into context windows.

Each task tokenizes its documents, then packs them window by window of
``BUFFER`` documents:

1. Whole 1024-token runs of a document become sequences of their own.
2. The rest of each document is routed to the tier of its size: over 512,
   over 256, over 128 and up to 128 tokens.
3. Each tier, longest first, opens sequences; the gap of a long sequence is
   filled from the longest shorter tier that fits, and the last gap by
   cutting one more piece, so every sequence but the last is full.
4. The last, open sequence is carried into the next window.  At the end of
   the task it is cut into power-of-two sequences, which need no padding.

Sequences are numbered per task.  At its end the task deals them into step
groups of about ``GROUP`` full sequences: full ones in turn, the short ones of
the last cut to the lightest group, so the groups of a task differ by at most
one sequence's tokens.  (Between tasks they differ by the rounding of a task's
sequences to whole groups.)  Until then a task keeps the numbers of its pieces,
72 bytes each; texts and ids are kept for one window only.  Nothing is
shuffled: the job is one scan whose cost is tokenization.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.words import gathered

CONTEXT = 1024
TIERS = (512, 256, 128, 0)          # lower bounds of the remainder tiers
BUFFER_BYTES = 1 << 23              # text packed together
GROUP = 64                          # full sequences of a step group
END = 0                             # id after every document
CACHE = 300_000                     # units whose ids a task remembers

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, sequence_length long, step_group long")


class UnitTokenizer:
    """Byte-level BPE ids, remembering those of recent units.

    The tokenizer's own pattern never joins a run of non-space characters
    with what follows, and takes at most one space before it.  So a text
    falls into units (a run with that space, or a run of white space) whose
    ids do not depend on the neighbours, and frequent units are looked up.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        # Added tokens stand for their strings wherever those occur, and the
        # text around is cut there; the longest match wins.
        self._added = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec.get("added_tokens", [])}
        by_length = sorted(self._added, key=len, reverse=True)
        self._cut = re.compile("(" + "|".join(map(re.escape, by_length)) + ")").split if by_length else None
        # The file writes each byte as a printable character: itself, or the
        # next one from 256 on.  Ids follow the order of merges, so they are
        # the merge ranks.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in vocabulary.items()
                 if all(c in byte_of for c in token) and token not in self._added}
        self._encode = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN,
                                         mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        # The pattern's \s is Unicode White_Space; Python's adds \x1c-\x1f.
        space = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self._units = re.compile(f" ?[^{space}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        self._seen: dict[str, bytes] = {}

    def _learn(self, units: list[str]) -> None:
        if len(self._seen) + len(units) > CACHE:
            self._seen.clear()
        for unit in units:
            if unit not in self._seen:
                self._seen[unit] = array("I", self._encode(unit)).tobytes()

    def _ids(self, text: str) -> bytes:
        units = self._units(text)
        try:
            return b"".join(map(self._seen.__getitem__, units))
        except KeyError:
            self._learn(units)
            return b"".join(map(self._seen.__getitem__, units))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of every text, the end id included."""
        out = []
        end = array("I", [END]).tobytes()
        for text in texts:
            text = text or ""
            if any(t in text for t in self._added):
                parts = self._cut(text)
                out.append(b"".join(self._added[p] if k % 2 else self._ids(p) for k, p in enumerate(parts)) + end)
            else:
                out.append(self._ids(text) + end)
        return out


class _Packer:
    def __init__(self, task: int, context: int):
        self.context, self.rows, self.n = context, [], task << 40
        self.lengths = array("i")      # of every sequence so far
        self.open: list = []           # pieces of the open sequence
        self.room = context

    def _emit(self, pieces: list) -> None:
        at, total = 0, sum(p[3] for p in pieces)
        for doc, ids, start, length in pieces:
            self.rows.append((doc, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]),
                              len(ids) // 4, self.n, at, total))
            at += length
        self.n += 1
        self.lengths.append(total)

    def _put(self, piece: tuple) -> None:
        doc, ids, start, length = piece
        while length:
            take = min(length, self.room)
            self.open.append((doc, ids, start, take))
            start, length, self.room = start + take, length - take, self.room - take
            if not self.room:
                self._emit(self.open)
                self.open, self.room = [], self.context

    def window(self, docs: list) -> None:
        """Packs (doc_id, ids) pairs; the open sequence stays for the next."""
        tiers: list[list] = [[] for _ in TIERS]
        for doc, ids in docs:
            n = len(ids) // 4
            whole = n - n % self.context
            for start in range(0, whole, self.context):
                self._emit([(doc, ids, start, self.context)])
            if n > whole:
                rest = n - whole
                tier = next(k for k, low in enumerate(TIERS) if rest > low * self.context // CONTEXT)
                tiers[tier].append((doc, ids, whole, rest))
        for tier in tiers:
            tier.sort(key=lambda p: p[3])
        while any(tiers):
            # The longest piece of the highest tier that fits the gap; when
            # none does, the shortest piece there is gets cut.
            pick = next((t for t in tiers if t and t[0][3] <= self.room), None)
            if pick is None:
                self._put(next(t for t in reversed(tiers) if t).pop(0))
                continue
            k = len(pick) - 1
            if pick[k][3] > self.room:
                lo, hi = 0, len(pick)
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if pick[mid][3] <= self.room else (lo, mid)
                k = lo - 1
            self._put(pick.pop(k))

    def close(self) -> None:
        """Cuts the open sequence into power-of-two ones."""
        total = sum(p[3] for p in self.open)
        pieces, self.open = self.open, []
        size = self.context
        while total:
            while size > total:
                size //= 2
            need, cut = size, []
            while need:
                doc, ids, start, length = pieces[0]
                take = min(need, length)
                cut.append((doc, ids, start, take))
                need -= take
                if take == length:
                    pieces.pop(0)
                else:
                    pieces[0] = (doc, ids, start + take, length - take)
            self._emit(cut)
            total -= size
        self.room = self.context

    def taken(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in zip(*rows)] if rows
            else [pa.array([], pa.int64()) for _ in schema], schema=schema)


def step_groups(lengths: np.ndarray, context: int) -> np.ndarray:
    """Group of every sequence: full ones in turn, then each shorter one,
    longest first, to the group with the fewest tokens."""
    groups = max(1, round(int(lengths.sum()) / (GROUP * context)))
    out = np.zeros(len(lengths), np.int64)
    full = np.flatnonzero(lengths == context)
    out[full] = np.arange(len(full)) % groups
    held = np.bincount(out[full], minlength=groups) * context
    short = np.flatnonzero(lengths < context)
    for k in short[np.argsort(-lengths[short], kind="stable")].tolist():
        out[k] = g = int(np.argmin(held))
        held[g] += lengths[k]
    return out


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def pack(docs: DataFrame, path: str | None = None, context: int = CONTEXT) -> DataFrame:
    """One row per piece: see ``SCHEMA``.

    Null text counts as empty (one piece with the end id).  Null doc_ids stay
    null.  Repeated rows are packed each on their own.  Documents longer than
    the context are cut.  ``context`` is a power of two.
    """
    path = path or tokenizer_path()
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in names[:-1]])
        task = TaskContext.get().partitionId()
        tok, packer, done = UnitTokenizer(path), _Packer(task, context), []
        for part in gathered(batches, "text", BUFFER_BYTES):
            ids = tok.encode(part.column("text").to_pylist())
            packer.window(list(zip(part.column("doc_id").to_pylist(), ids)))
            done.append(packer.taken(schema))
        packer.close()
        done.append(packer.taken(schema))
        group = (task << 40) + step_groups(np.array(packer.lengths, np.int64), context)
        for batch in done:
            mine = batch.column("sequence_id").to_numpy() - (task << 40)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group[mine])], names=names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, SCHEMA)
