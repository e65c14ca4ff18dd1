"""Secret scan: fixed formats plus learned probabilistic automata.

Base spans come from three fixed patterns.  A bounded sample of their values
(``LABELLED`` per kind) is the labelled set: its strings, as character
classes, form one prefix tree per kind, and states whose next-symbol
frequencies are compatible (Hoeffding bound) are merged into a probabilistic
automaton.

Every candidate in every text is then scored: log-likelihood under the best
automaton against a bigram background learned from a bounded sample of ordinary
runs.  A candidate is a maximal run of credential characters, or a part of one
between the separators ``= / .``, from the shortest learned length on; runs of
letters alone, but for a first capital, are words and left out.  Of overlapping
candidates above the threshold the best one counts, neighbours between which
only a separator stands are one span, and what no base span holds already is
added as a ``grammar`` span.  The threshold lies between the scores of the
labelled values and those of ordinary runs; long runs that mix letters and
digits in one part are left out of the ordinary ones, as they may be secrets
nobody labelled.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.words import Batch, slices
from panelkit.session import scratch_path

KINDS = ("assign", "access", "hex", "grammar")
# The base formats.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
LEAST = 6                # no candidate is shorter
MIXED = 16               # an unlabelled part that mixes letters and digits is not ordinary from here on
LABELLED = 400           # values per kind that the automata are learned from
SAMPLE_DOCS = 20_000     # expected documents that the samples come from
ALPHA = 0.05             # of the Hoeffding compatibility test

_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True
_RUN_BYTES = np.zeros(256, bool)
_RUN_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PARTS = re.compile(rb"[^=/.]+")
# Character classes: upper, a-f, g-z, digit; the rest stand for themselves.
_CLASS = bytes(range(256)).translate(bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    b"U" * 26 + b"h" * 6 + b"l" * 20 + b"d" * 10))
_SYMBOLS = 10            # U h l d + / _ . = -
_FLOOR = math.log(1e-4)


def _runs(data: np.ndarray, table: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``table`` bytes, ``least`` long."""
    held = table[data]
    if not len(held):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = held.copy(), held.copy()
    first[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(held))]
    first[inner] = held[inner]
    last[inner - 1] = held[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def base_spans(batch: Batch) -> list[list[tuple[int, str, int, int]]]:
    """Per document: (start, kind, end, value start) in bytes of the document."""
    raw, off = batch.data.tobytes(), batch.offsets
    out: list[list] = [[] for _ in range(len(off) - 1)]
    for s, e in zip(*_runs(batch.data, _HEX_BYTES, off, MIN_HEX)):
        d = int(np.searchsorted(off, s, "right")) - 1
        out[d].append((int(s - off[d]), "hex", int(e - off[d]), int(s - off[d])))
    akia = b"AKIA" in raw
    for d in range(len(off) - 1):
        lo, hi = int(off[d]), int(off[d + 1])
        if raw.find(b"=", lo, hi) >= 0 or raw.find(b":", lo, hi) >= 0:
            for m in ASSIGN.finditer(raw[lo:hi]):
                if m.end(2) - m.start(2) >= MIN_ASSIGN:
                    out[d].append((m.start(), "assign", m.end(), m.start(2)))
        if akia and raw.find(b"AKIA", lo, hi) >= 0:
            for m in ACCESS.finditer(raw[lo:hi]):
                if m.end() - m.start() >= MIN_ACCESS:
                    out[d].append((m.start(), "access", m.end(), m.start()))
        if len(out[d]) > 1:
            out[d].sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return out


class Automaton:
    """Probabilistic automaton merged from a prefix tree of strings."""

    def __init__(self, strings: list[bytes], alpha: float = ALPHA):
        self.count, self.end, self.next = [0], [0], [dict()]   # next: symbol -> [state, uses]
        for s in strings:
            at = 0
            self.count[0] += 1
            for c in s:
                edge = self.next[at].get(c)
                if edge is None:
                    edge = self.next[at][c] = [len(self.count), 0]
                    self.count.append(0)
                    self.end.append(0)
                    self.next.append({})
                edge[1] += 1
                at = edge[0]
                self.count[at] += 1
            self.end[at] += 1
        self._alpha = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.logp = [self._logs(q) for q in range(len(self.count))]

    def _near(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) < self._alpha * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n1, n2 = self.count[a], self.count[b]
            if not n1 or not n2:
                continue
            if not self._near(self.end[a], n1, self.end[b], n2):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if not self._near(x[1] if x else 0, n1, y[1] if y else 0, n2):
                    return False
                if x and y and x[0] != y[0] and y[0] not in self._red:
                    stack.append((x[0], y[0]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        stack = [(red, blue)]
        while stack:
            a, b = stack.pop()
            self.count[a] += self.count[b]
            self.end[a] += self.end[b]
            for c, (to, uses) in self.next[b].items():
                mine = self.next[a].get(c)
                if mine is None:
                    self.next[a][c] = [to, uses]
                else:
                    mine[1] += uses
                    if mine[0] != to:
                        stack.append((mine[0], to))

    def _merge(self) -> None:
        red, self._red = [0], {0}
        while True:
            blue = next(((q, c, e[0]) for q in red for c, e in self.next[q].items() if e[0] not in self._red), None)
            if blue is None:
                return
            parent, symbol, state = blue
            for q in red:
                if self._compatible(q, state):
                    self.next[parent][symbol][0] = q
                    self._fold(q, state)
                    break
            else:
                red.append(state)
                self._red.add(state)

    def _logs(self, q: int) -> tuple[dict, float]:
        n = self.count[q] + 0.5 * (_SYMBOLS + 1)
        return ({c: (e[0], math.log((e[1] + 0.5) / n)) for c, e in self.next[q].items()},
                math.log((self.end[q] + 0.5) / n))

    def score(self, symbols: bytes) -> float:
        at, total = 0, 0.0
        for c in symbols:
            step = self.logp[at][0].get(c)
            if step is None:
                total += _FLOOR
            else:
                at = step[0]
                total += step[1]
        return total + self.logp[at][1]


class Background:
    """Bigram model of ordinary runs."""

    def __init__(self, strings: list[bytes]):
        pairs, ones = Counter(), Counter()
        for s in strings:
            pairs.update(zip(b"^" + s, s + b"$"))
            ones.update(b"^" + s)
        self.logp = defaultdict(lambda: _FLOOR, {
            k: math.log((v + 0.5) / (ones[k[0]] + 0.5 * (_SYMBOLS + 1))) for k, v in pairs.items()})
        if not strings:
            self.logp = defaultdict(lambda: -math.log(_SYMBOLS + 1))

    def score(self, s: bytes) -> float:
        return sum(map(self.logp.__getitem__, zip(b"^" + s, s + b"$")))


class Model:
    """Automata per kind, the background and the threshold they imply."""

    def __init__(self, values: dict[str, list[bytes]], ordinary: list[bytes]):
        values = {k: [v.translate(_CLASS) for v in vs] for k, vs in values.items() if vs}
        ordinary = [v.translate(_CLASS) for v in ordinary]
        self.automata = [Automaton(vs) for vs in values.values()]
        self.background = Background(ordinary)
        self.least = max(LEAST, min((len(v) for vs in values.values() for v in vs), default=LEAST))
        self._seen: dict[bytes, float] = {}
        good = sorted(self.ratio(v) for vs in values.values() for v in vs)
        bad = sorted(map(self.ratio, ordinary))
        self.threshold = math.inf
        if good:
            low = good[len(good) // 20]
            high = bad[-1 - len(bad) // 1000] if bad else low - 1
            self.threshold = (low + high) / 2 if low > high else high

    def ratio(self, symbols: bytes) -> float:
        """Log-likelihood ratio per character of the best automaton; a short
        string is held to the length that is worth as much as its end, so
        that chance has less weight."""
        if not self.automata:
            return -math.inf
        known = self._seen.get(symbols)
        if known is None:
            if len(self._seen) > 200_000:
                self._seen.clear()
            best = max(a.score(symbols) for a in self.automata)
            known = self._seen[symbols] = (best - self.background.score(symbols)) / max(len(symbols), MIXED)
        return known

    def best(self, run: bytes) -> list[tuple[int, int]]:
        """Places of the credentials in a run: the highest-scoring candidates
        that do not overlap, neighbours merged."""
        places = {(0, len(run)), *((m.start(), m.end()) for m in _PARTS.finditer(run))}
        named = run.find(b"=")
        if 0 < named < len(run) - 1:
            places.add((named + 1, len(run)))            # what a name is set to
        scored = sorted(((self.ratio(run[a:b].translate(_CLASS)), a, b) for a, b in places
                         if b - a >= self.least and not _word(run[a:b])), key=lambda x: (-x[0], x[1]))
        taken: list[tuple[int, int]] = []
        for score, a, b in scored:
            if score > self.threshold and not any(x < b and a < y for x, y in taken):
                taken.append((a, b))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(taken):
            if merged and a - merged[-1][1] <= 1:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        return merged


def _word(run: bytes) -> bool:
    """Letters alone, in lower case but for the first."""
    return run.isalpha() and (run[1:].islower() or len(run) == 1)


def _mixed(run: bytes) -> bool:
    """Whether a long part mixes letters and digits."""
    return any(len(p) >= MIXED and re.search(rb"[0-9]", p) and re.search(rb"[A-Za-z]", p) for p in _PARTS.findall(run))


def _candidates(batch: Batch, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that may hold a credential: not only
    letters after the first character, or a capital among those."""
    starts, ends = _runs(batch.data, _RUN_BYTES, batch.offsets, least)
    lower = _LETTER[batch.data] & (batch.data >= 97)
    seen = np.concatenate(([0], np.cumsum(~lower)))
    plain = (seen[ends] == seen[np.minimum(starts + 1, ends)]) & _LETTER[batch.data[starts]] if len(starts) \
        else np.zeros(0, bool)
    return starts[~plain], ends[~plain]


def _spans(batch: Batch, model: Model | None) -> list[list[tuple[int, str, int]]]:
    base = base_spans(batch)
    out = [[s[:3] for s in spans] for spans in base]
    if model is None or not model.automata:
        return out
    raw, off = batch.data.tobytes(), batch.offsets
    starts, ends = _candidates(batch, model.least)
    where = np.searchsorted(off, starts, "right") - 1
    for s, e, d in zip(starts.tolist(), ends.tolist(), where.tolist()):
        lo = int(off[d])
        for a, b in model.best(raw[s:e]):
            a, b = s + a - lo, s + b - lo
            if not any(x <= a and b <= y for x, _, y in out[d]):
                out[d].append((a, "grammar", b))
    for spans in out:
        spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return out


def learn(docs: DataFrame) -> Model:
    """The model, from at most LABELLED values per kind, whole, and as many
    ordinary runs times four; they come from about SAMPLE_DOCS hash-chosen documents."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(n, 1))
    chosen = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(math.ceil(share * (1 << 20))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            batch = Batch.of(part.column("text"))
            raw, off = batch.data.tobytes(), batch.offsets
            kinds, values = [], []
            held: set[int] = set()
            for d, spans in enumerate(base_spans(batch)):
                for _, kind, end, at in spans:
                    kinds.append(kind)
                    values.append(raw[off[d] + at:off[d] + end])
                    held.update(range(int(off[d]) + at, int(off[d]) + end))
            for s, e in zip(*(x.tolist() for x in _candidates(batch, LEAST))):
                if s not in held and e - 1 not in held and not _mixed(raw[s:e]):
                    kinds.append("ordinary")
                    values.append(raw[s:e])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.binary())],
                                             names=["kind", "value"])
    path = scratch_path(docs.sparkSession, "secret-sample")
    chosen.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, value binary") \
        .distinct().write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    values: dict[str, list[bytes]] = {}
    for kind in (*KINDS[:3], "ordinary"):
        limit = LABELLED * (4 if kind == "ordinary" else 1)
        rows = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(limit).collect()
        values[kind] = [bytes(r.value) for r in rows]
    ordinary = values.pop("ordinary")
    return Model(values, ordinary)


def secret_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every document row with its spans: arrays of (kind, start, end) in code
    points, by start and then kind.

    Null text counts as empty.  Repeated rows get equal results.  Overlapping
    base spans of different kinds all stay; a ``grammar`` span that lies inside
    a base span is not added, one that reaches beyond it is.  Very long texts
    are scanned whole.
    """
    model = learn(docs) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            batch = Batch.of(part.column("text"))
            off = batch.offsets
            rows = []
            for d, spans in enumerate(_spans(batch, model)):
                if spans:
                    # Byte positions to code points: leave out continuation bytes.
                    at = np.concatenate(([0], np.cumsum((batch.data[off[d]:off[d + 1]] & 0xC0) != 0x80)))
                    spans = [{"kind": k, "start": int(at[s]), "end": int(at[e])} for s, k, e in spans]
                rows.append(spans)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(rows, pa.list_(pa.struct(
                    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "spans"])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
                         "spans array<struct<kind:string,start:bigint,end:bigint>>")


def secret_report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans as text."""
    spans = secret_spans(docs, model)

    def text(array):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "grammar")
    return spans.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
                        count("grammar").alias("n_grammar"))
