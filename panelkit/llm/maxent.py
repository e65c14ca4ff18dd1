"""Language-model scoring: hashed maximum-entropy model with class-factored
softmax, under counted n-gram and skip features.

Tokens are the words of the A-Z-lowered text, then one end token.  Each token
belongs to a class: the end to its own, a word by the bucket of its last three
bytes.  Buckets are clustered into classes by the buckets they stand next to
in all training documents (counts of neighbouring buckets, a table of fixed
size, reduced by its leading singular vectors and grouped by k-means).  Then

    P0(token | history) = P(class | history) * (c + 1) / mass(class)

where c is the token's count over all training tokens and mass sums c + 1
over the class's training tokens, plus 1 for unknown words.  P(class |
history) is a softmax over weights of four hashed features: the previous
word, the one before it (a skip feature), the pair of both, and the pair of
their classes.  This base has a fixed number of weights.  What grows with the
input are the counts of every (word two before, token), (previous word,
token) and (both, token) of all training documents.  Level by level, in that
order, they refine the base:

    P_k = L * count(history, token) / count(history) + (1 - L) * P_(k-1)

so a word is told from others of its class by the phrases it stood in, and
P_3 sums to one like P0.  L depends on the level and the binary logarithm of
count(history); it is fitted by EM on all training tokens, bucket by bucket,
and averaged over the buckets, each weighted by its tokens.  A training token
is left out of its own n-gram counts, in the fit and in its score.

n-grams are hashed to SPARE_BITS bits more than the size of the texts in bytes
has, so an unseen one meets a counted one with probability below 2^-7 at any
size (up to 2^55 bytes; the hash has 64 bits).

Counts cover every training document: documents are dealt into buckets by a hash
of doc_id and text, each bucket sends its distinct tokens and n-grams once to
their hash groups, and a group returns what the other buckets counted, so neither the vocabulary nor
the n-grams are ever in one place.  Every bucket is counted once: the fit
writes down what a token's probability is made of (base, counts), and the
scores are read off that with the averaged shares.  Weights are trained by distributed gradient updates: in each of
``ROUNDS`` rounds every task starts from the shared weights, makes AdaGrad
steps over its part of the round's documents, and the changes are averaged
row by row, weighted by how often each task saw the feature.  The weight
table has a fixed size, so it is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import doc_key
from panelkit.llm.repeats import _decode, _encode
from panelkit.llm.words import Batch, mix, slices
from panelkit.session import scratch_path

CLASSES = 16                                  # class 0 is the end token's
SUFFIXES, DIMENSIONS = 1024, 16               # word-end buckets (0: the end token)
_SIZES = (1 << 13, 1 << 12, 1 << 14, CLASSES * CLASSES)
_BASES = np.concatenate(([0], np.cumsum(_SIZES)))
FEATURES = int(_BASES[-1])
ROUNDS, RATE, STEP_TOKENS = 2, 0.3, 1 << 16
SCORE_TOKENS = 1 << 13
SLICES, FAN_IN = 16, 64                       # of the weight averaging
BUCKET_BYTES, GROUP_BYTES = 3 << 21, 3 << 21
LEVELS, SPARE_BITS = 3, 8                    # skip, bigram, trigram; see above
BINS, EM_STEPS = 48, 12
FIT_BUCKETS = None                            # not a limit any more: the fit takes every bucket
ROW_TOKENS, GROUP_ROWS = 1 << 17, 16          # of the stored counts
_U64 = np.uint64
END = _U64(0x5851F42D4C957F2D)                # the end token's hash
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 7, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _before(bounds: np.ndarray, back: int, values: np.ndarray, start) -> np.ndarray:
    """``values`` of the token ``back`` places before each token, or
    ``start`` where that is outside the document."""
    out = np.full(len(values), start, values.dtype)
    out[back:] = values[:-back]
    for k in range(back):
        at = bounds[:-1] + k
        out[at[at < bounds[1:]]] = start
    return out


class Tokens:
    """Hashes and classes of a batch's tokens; document d owns the tokens
    bounds[d]:bounds[d + 1], the last of which is its end."""

    def __init__(self, texts: pa.Array, classes: np.ndarray | None = None):
        text = Batch.of(texts)
        starts, ends, bounds = text.spans()
        docs = len(bounds) - 1
        place = np.arange(len(starts)) + np.repeat(np.arange(docs), np.diff(bounds))
        self.bounds = bounds + np.arange(docs + 1)
        self.hash = np.full(len(starts) + docs, END, np.uint64)
        self.hash[place] = text.hashes(starts, ends, lower=True)
        self.suffix = np.zeros(len(self.hash), np.int64)
        tail = np.zeros(len(starts), np.uint64)
        for k in range(1, 4):
            at = ends - k
            tail = tail * _U64(256) + np.where(at >= starts, _LOWER[text.data[np.maximum(at, 0)]], 0).astype(np.uint64)
        self.suffix[place] = 1 + (mix(tail + _U64(1)) % _U64(SUFFIXES - 1)).astype(np.int64)
        self.cls = self.suffix if classes is None else classes[self.suffix]

    def features(self) -> np.ndarray:
        """The four weight rows of every token, as columns."""
        n = len(self.hash)
        one, two = np.full(n, END, np.uint64), np.full(n, END, np.uint64)
        c1, c2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        one[1:], c1[1:] = self.hash[:-1], self.cls[:-1]     # before the first: an end
        two[2:], c2[2:] = self.hash[:-2], self.cls[:-2]
        first = self.bounds[:-1]
        two[first], c2[first] = END, 0
        out = np.empty((4, n), np.int32)
        out[0] = one % _U64(_SIZES[0])
        out[1] = _BASES[1] + (mix(two + _U64(1)) % _U64(_SIZES[1])).astype(np.int64)
        out[2] = _BASES[2] + (mix(one * _U64(3) + two * _U64(5)) % _U64(_SIZES[2])).astype(np.int64)
        out[3] = _BASES[3] + c1 * CLASSES + c2
        return out

    def before(self, back: int, values: np.ndarray, start) -> np.ndarray:
        return _before(self.bounds, back, values, start)

    def grams(self, bits: int) -> np.ndarray:
        """Hashes of (skip, token), (previous, token) and (both, token) of
        all tokens, end to end; only the upper ``bits`` bits are set."""
        one, two = self.before(1, self.hash, END), self.before(2, self.hash, END)
        key = np.concatenate([mix(mix(two + _U64(2)) ^ self.hash), mix(mix(one + _U64(1)) + self.hash),
                              mix(mix(mix(two + _U64(3)) + one) ^ self.hash)])
        spare = _U64(64 - bits)
        return (key >> spare) << spare


def gram_bits(size: int) -> int:
    """Bits of the n-gram hashes for texts of ``size`` bytes; one of 64 is a flag."""
    return min(63, int(size).bit_length() + SPARE_BITS)


def _log_probs(weights: np.ndarray, feats: np.ndarray) -> np.ndarray:
    z = weights[feats[0]]
    for f in feats[1:]:
        z += weights[f]
    z -= _row_max(z)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _row_max(z: np.ndarray) -> np.ndarray:
    """Largest of each row's CLASSES values, by halves: a reduction along so
    short rows takes several times as long."""
    while z.shape[1] > 1:
        half = z.shape[1] // 2
        z = np.maximum(z[:, :half], z[:, half:])
    return z


def class_scores(weights: np.ndarray, tokens: Tokens) -> np.ndarray:
    """Natural log P(class | history) of every token."""
    feats, out = tokens.features(), np.empty(len(tokens.hash))
    for lo in range(0, len(out), SCORE_TOKENS):
        cls = tokens.cls[lo:lo + SCORE_TOKENS]
        z = weights.take(feats[0, lo:lo + SCORE_TOKENS], axis=0)
        for f in feats[1:, lo:lo + SCORE_TOKENS]:
            z += weights.take(f, axis=0)
        z -= _row_max(z)
        mine = z[np.arange(len(cls)), cls]
        out[lo:lo + SCORE_TOKENS] = mine - np.log(np.exp(z, out=z).sum(axis=1))
    return out


def _neighbour_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (bucket, next bucket) over a task's tokens."""
    counts = np.zeros(SUFFIXES * SUFFIXES)
    for part in slices(batches, "text"):
        suffix = Tokens(part.column("text")).suffix
        counts += np.bincount(suffix[:-1] * SUFFIXES + suffix[1:], minlength=len(counts))
    if counts.any():
        yield _sliced(counts.astype(np.float32).reshape(SUFFIXES, SUFFIXES), np.zeros(SUFFIXES, np.float32))


def learn_classes(docs: DataFrame) -> np.ndarray:
    """Class of every word-end bucket, from all rows of ``docs``."""
    return cluster(_summed(docs.select("text"), _neighbour_task, SUFFIXES)[0])


def cluster(counts: np.ndarray) -> np.ndarray:
    """Classes of buckets whose neighbours are alike; bucket 0 is class 0."""
    classes = np.zeros(SUFFIXES, np.int64)
    total = counts.sum()
    weight = counts.sum(axis=0) + counts.sum(axis=1)
    weight[0] = 0
    used = np.flatnonzero(weight)
    if not len(used):
        return classes
    # Positive pointwise mutual information with the buckets on both sides.
    sides = []
    for m in (counts, counts.T):
        expected = np.outer(m.sum(axis=1), m.sum(axis=0)) / total
        ratio = np.divide(m, expected, out=np.ones_like(m), where=expected > 0)
        sides.append(np.log(np.maximum(ratio, 1)) * np.sqrt(m.sum(axis=0) / total))
    u, s, _ = np.linalg.svd(np.concatenate(sides, axis=1)[used], full_matrices=False)
    x = (u * s)[:, :DIMENSIONS]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    w = weight[used]
    k = min(CLASSES - 1, len(used))
    centres = x[[int(np.argmax(w))]]
    while len(centres) < k:                     # far from all, and frequent
        gap = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.append(centres, x[[int(np.argmax(gap * w))]], axis=0)
    for _ in range(30):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(k):
            if (near == c).any():
                centres[c] = np.average(x[near == c], axis=0, weights=w[near == c])
    # Buckets never seen in training share the last class.
    classes[1:] = k
    classes[used] = 1 + near
    return classes


def _sliced(change: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    """A task's table in SLICES rows, to be summed over tasks."""
    edge = np.linspace(0, len(change), SLICES + 1).astype(int)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(SLICES), pa.int32()), pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32()),
         pa.array([change[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary()),
         pa.array([seen[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())],
        names=["slice", "task", "change", "seen"])


def _summed(docs: DataFrame, task, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of all tasks' tables, by a tree of sums FAN_IN wide; the tables
    have a fixed size, so the result comes to the driver."""
    schema = "slice int, task int, change binary, seen binary"
    found, tasks = docs.mapInArrow(task, schema), docs.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        found = found.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")) \
            .groupBy("slice", "task").applyInArrow(_add_up, schema)
    parts = {r.slice: r for r in found.collect()}
    if not parts:
        return np.zeros((rows, rows if task is _neighbour_task else CLASSES), np.float64), np.zeros(rows)
    seen = [np.frombuffer(parts[k].seen, np.float32) for k in range(SLICES)]
    change = [np.frombuffer(parts[k].change, np.float32).reshape(len(seen[k]), -1) for k in range(SLICES)]
    return np.concatenate(change).astype(np.float64), np.concatenate(seen)


def _train_task(weights, classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = weights.value
        w, acc = start.copy(), np.full(FEATURES, 1e-6, np.float32)
        seen = np.zeros(FEATURES, np.float32)
        for part in slices(batches, "text"):
            tokens = Tokens(part.column("text"), classes)
            feats = tokens.features()
            for lo in range(0, len(tokens.hash), STEP_TOKENS):
                mine = feats[:, lo:lo + STEP_TOKENS]
                grad = np.exp(_log_probs(w, mine))
                grad[np.arange(len(grad)), tokens.cls[lo:lo + STEP_TOKENS]] -= 1
                for f in mine:
                    # Feature and place in one integer, as in _order.
                    packed = np.sort(f.astype(np.uint32) * np.uint32(STEP_TOKENS) + np.arange(len(f), dtype=np.uint32))
                    order, ranked = packed % np.uint32(STEP_TOKENS), (packed // np.uint32(STEP_TOKENS)).astype(np.int32)
                    head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
                    rows, total = ranked[head], np.add.reduceat(grad[order], head)
                    acc[rows] += (total * total).mean(axis=1)
                    w[rows] -= RATE * total / np.sqrt(acc[rows])[:, None]
                    seen[rows] += np.diff(np.append(head, len(f)))
        if seen.any():
            yield _sliced((w - start) * seen[:, None], seen)
    return run


def _add_up(table: pa.Table) -> pa.Table:
    def total(name):
        out = 0
        for raw in table.column(name).to_pylist():
            out = out + np.frombuffer(raw, np.float32)
        return pa.array([out.astype(np.float32).tobytes()], pa.binary())
    return pa.table({"slice": table.column("slice").slice(0, 1), "task": table.column("task").slice(0, 1),
                     "change": total("change"), "seen": total("seen")})


def train(docs: DataFrame, classes: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights learned from every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    weights = np.zeros((FEATURES, CLASSES), np.float32)
    for k in range(rounds):
        part = docs.where(F.pmod(doc_key(F.col("text")), F.lit(rounds)) == k).select("text")
        shared = spark.sparkContext.broadcast(weights)
        change, seen = _summed(part, _train_task(shared, classes), FEATURES)
        weights = weights + (change / np.maximum(seen, 1)[:, None]).astype(np.float32)
    return weights


def _unpacked(column: pa.ChunkedArray) -> pa.Array:
    import zstandard
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(z) for z in column.to_pylist()], pa.large_binary())


def _planes(values: np.ndarray, level: int = 1) -> bytes:
    """Non-negative integers, byte plane by byte plane, compressed."""
    import zstandard
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(raw.T).tobytes())


def _from_planes(raw: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _keys_out(keys: np.ndarray, bits: int) -> bytes:
    """Sorted n-gram hashes as their differences."""
    small = keys >> _U64(64 - bits)
    return _planes(np.diff(small, prepend=_U64(0)))


def _keys_in(raw: bytes, bits: int) -> np.ndarray:
    return np.cumsum(_from_planes(raw), dtype=np.uint64) << _U64(64 - bits)


_WORDS = ("grp int, bucket int, words binary, counts binary, skips binary, classes binary, "
          "grams binary, gram_counts binary")


def _order(keys: np.ndarray, bits: int) -> np.ndarray:
    """Sorting order of hashes of ``bits`` upper bits.  Their places go into
    the free lower bits, where they fit: sorting plain integers is several
    times faster than sorting places by them."""
    n = len(keys)
    if n > 1 << (64 - bits):
        return np.argsort(keys, kind="stable")
    return (np.sort(keys | np.arange(n, dtype=np.uint64)) & _U64((1 << (64 - bits)) - 1)).astype(np.int64)


def _distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and each hash's place among them."""
    order = _order(keys, bits)
    ranked = keys[order]
    head = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(head) - 1
    return ranked[head], place


def _words(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes, the first place of each, and each word's place
    among them.  Sorted by 44 upper bits; where two words share those, whole."""
    order = _order(hashes >> _U64(20) << _U64(20), 44)
    ranked = hashes[order]
    new = ranked[1:] != ranked[:-1]
    if (new & (ranked[1:] >> _U64(20) == ranked[:-1] >> _U64(20))).any():
        return np.unique(hashes, return_index=True, return_inverse=True)
    head = np.concatenate(([True], new)) if len(hashes) else np.zeros(0, bool)
    place = np.empty(len(hashes), np.int64)
    place[order] = np.cumsum(head) - 1
    return ranked[head], order[head], place


def _own_counts(grams: np.ndarray, train: np.ndarray, bits: int, places: bool = False):
    """Distinct n-grams, how often each stands in training texts, and with
    ``places`` each n-gram's place among them."""
    if places:
        values, place = _distinct(grams, bits)
        return values, np.bincount(place, weights=train, minlength=len(values)).astype(np.int64), place
    # The last bit is free for the flag: see gram_bits.
    flagged = np.sort(grams | train.astype(np.uint64))
    values = flagged & ~_U64(1)
    head = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    counts = np.add.reduceat((flagged & _U64(1)).astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
    return values[head], counts, None


def _bucket_words(groups: int, classes: np.ndarray, bits: int):
    """Distinct tokens and n-grams of a bucket, dealt to hash groups."""
    def run(table: pa.Table) -> pa.Table:
        tokens = Tokens(_unpacked(table.column("z")), classes)
        train = np.repeat(table.column("train").to_numpy(), np.diff(tokens.bounds))
        values, first, inverse = _words(tokens.hash)
        counts = np.bincount(inverse, weights=train, minlength=len(values)).astype(np.int64)
        end = int(np.searchsorted(values, END))
        skips = np.bincount(tokens.before(2, inverse, end), weights=train, minlength=len(values)).astype(np.int64)
        cls = tokens.cls[first].astype(np.uint8)
        grams, gram_counts, _ = _own_counts(tokens.grams(bits), np.tile(train, LEVELS), bits)
        bucket = table.column("bucket")[0].as_py()
        mine, theirs = ({g: (a, b) for g, a, b in _cuts(v, groups)} for v in (values, grams))
        rows = []
        for g in sorted(mine.keys() | theirs.keys()):
            a, b = mine.get(g, (0, 0))
            x, y = theirs.get(g, (0, 0))
            rows.append((g, bucket, values[a:b].tobytes(), _encode(counts[a:b]), _encode(skips[a:b]),
                         cls[a:b].tobytes(), _keys_out(grams[x:y], bits), _planes(gram_counts[x:y])))
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                        names=[n.split()[0] for n in _WORDS.split(", ")])
    return run


def _cuts(values: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
    """(group, from, to) of sorted hashes, by hash range."""
    edges = np.array([(g << 64) // groups for g in range(groups)], np.uint64)
    at = np.append(np.searchsorted(values, edges), len(values))
    return [(g, int(at[g]), int(at[g + 1])) for g in np.flatnonzero(np.diff(at)).tolist()]


def _group_counts(bits: int):
    """Total counts of a hash group's tokens, and the other buckets' counts of
    its n-grams, back to every bucket; the group's class masses, vocabulary and tokens in a row of
    bucket -1."""
    def run(table: pa.Table) -> pa.Table:
        names = table.column("bucket").to_pylist()
        grp = table.column("grp")[0].as_py()

        def column(name):
            return table.column(name).to_pylist()
        words = [np.frombuffer(w, np.uint64) for w in column("words")]
        values, inverse = np.unique(np.concatenate(words), return_inverse=True)

        def total(name):
            return np.bincount(inverse, weights=np.concatenate([_decode(r) for r in column(name)]),
                               minlength=len(values)).astype(np.int64)
        counts, skips = total("counts"), total("skips")
        cls = np.zeros(len(values), np.uint8)
        cls[inverse] = np.concatenate([np.frombuffer(r, np.uint8) for r in column("classes")])
        held = counts > 0
        mass = np.bincount(cls[held], weights=counts[held] + 1, minlength=CLASSES).astype(np.int64)
        grams = [_keys_in(r, bits) for r in column("grams")]
        sizes = [len(g) for g in grams]
        _, place = _distinct(np.concatenate(grams), bits)
        del grams
        own = np.concatenate([_from_planes(r) for r in column("gram_counts")]).astype(np.int64)
        # Most n-grams stand in one bucket, to which there is nothing to add.
        gram_counts = np.bincount(place, weights=own).astype(np.int64)[place] - own
        out = [(-1, grp, b"", b"", b"", mass.tolist(), int(held.sum()), int(counts.sum()))]
        at = to = 0
        for bucket, w, n in zip(names, words, sizes):
            mine = inverse[at:at + len(w)]
            out.append((bucket, grp, _thin(counts[mine]), _thin(_folded(skips[mine] - counts[mine])), _planes(gram_counts[to:to + n]),
                        None, None, None))
            at, to = at + len(w), to + n
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)],
                        names=[n.split()[0] for n in _COUNTS.split(", ")])
    return run


_COUNTS = ("bucket int, grp int, counts binary, skips binary, gram_counts binary, mass array<bigint>, "
           "vocabulary long, tokens long")
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_FITTED = "doc_id array<bigint>, held_out array<boolean>, n_tokens array<bigint>, n_known array<bigint>, " \
          "unigrams array<double>, base binary, counts binary, skips binary, joint binary, " \
          "fit array<struct<level: int, bin: int, share: double, weight: double>>"


def _thin(values: np.ndarray) -> bytes:
    """Non-negative integers as _planes, of four bytes where those are enough."""
    import zstandard
    kind = "<u4" if not len(values) or int(values.max()) < 1 << 32 else "<u8"
    size = np.dtype(kind).itemsize
    raw = np.ascontiguousarray(values, kind).view(np.uint8).reshape(-1, size)
    return bytes([size]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(raw.T).tobytes())


def _from_thin(raw: bytes) -> np.ndarray:
    import zstandard
    size = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(raw)[1:]), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").ravel().astype(np.int64)


def _folded(values: np.ndarray) -> np.ndarray:
    """Integers of either sign as non-negative ones: 0, -1, 1, -2 ..."""
    return values << 1 ^ values >> 63


def _unfolded(values: np.ndarray) -> np.ndarray:
    return values >> 1 ^ -(values & 1)


class _Counted:
    """Base probability and total counts of the tokens of some documents:
    ``counts`` and ``skips`` of the token's word, as itself and as a skip
    history, ``joint`` of its n-grams by level."""

    def __init__(self, bounds: np.ndarray, own: np.ndarray, base: np.ndarray, counts: np.ndarray, skips: np.ndarray,
                 joint: np.ndarray):
        # A training token is left out of its own counts.
        self.bounds, self.own, self.base, self.counts, self.skips, self.joint = bounds, own, base, counts, skips, joint

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Relative frequency under level k's history, and the history's bin
        (0: not seen)."""
        # Every word is followed by a token, so a word or bigram is a history
        # as often as it occurs; the texts begin after two ends, and the
        # first document's last token is one.
        end = self.bounds[1] - 1
        back, values, start = ((2, self.skips, self.skips[end]), (1, self.counts, self.counts[end]),
                               (1, self.joint[1], self.counts[end]))[k]
        seen = np.maximum(_before(self.bounds, back, values, start) - self.own, 0).astype(np.float64)
        # The exponent of frexp is one above the binary logarithm's floor, and
        # 0 for 0, whose share is 0.
        bins = np.minimum(np.frexp(seen)[1], BINS - 1)
        return (self.joint[k] - self.own) / np.maximum(seen, 1), bins

    def fit(self) -> list[tuple[int, int, float, float]]:
        """Shares of the levels that make the training tokens likely, as
        (level, bin, share, tokens)."""
        out, held = [], self.own > 0
        p = self.base[held].astype(np.float64)
        for k in range(LEVELS):
            q, bins = (x[held] for x in self.level(k))
            n = np.bincount(bins, minlength=BINS)
            share = np.full(BINS, 0.5)
            share[0] = 0
            # A token without frequency under the history is the lower
            # level's at any share; of the others, a step sums
            # share * q / (share * q + (1 - share) * p).
            hit = np.flatnonzero(q)
            hit = hit[np.argsort(bins[hit].astype(np.uint8), kind="stable")]
            odds = q[hit] / p[hit] - 1
            edge = np.searchsorted(bins[hit], np.arange(BINS + 1))
            for j in range(1, BINS):
                mine, s = odds[edge[j]:edge[j + 1]], 0.5
                for _ in range(EM_STEPS):
                    # One token on either side keeps shares off 0 and 1.
                    s = (len(mine) - (1 - s) * (1 / (s * mine + 1)).sum() + 0.5) / (n[j] + 1)
                share[j] = s
            p = share[bins] * q + (1 - share[bins]) * p
            out += [(k, j, float(share[j]), float(n[j])) for j in np.flatnonzero(n).tolist()]
        return out

    def probs(self, shares: np.ndarray) -> np.ndarray:
        p = self.base.astype(np.float64)
        for k in range(LEVELS):
            q, bins = self.level(k)
            p = shares[k][bins] * q + (1 - shares[k][bins]) * p
        return p


def _rounded(values: np.ndarray) -> np.ndarray:
    """To 20 binary digits, as far as class scores from 32-bit weights are good."""
    bits = values.astype(np.float32).view(np.uint32)
    return ((bits + np.uint32(8)) & ~np.uint32(15)).view(np.float32)


def _counted(docs: pa.Table, counts: pa.Table, weights, classes, mass, groups: int, bits: int) -> _Counted:
    """A bucket's tokens with the total counts its groups returned."""
    tokens = Tokens(_unpacked(docs.column("z")), classes)
    own = np.repeat(docs.column("train").to_numpy(), np.diff(tokens.bounds)).astype(np.int64)
    rows = {r["grp"]: r for r in counts.to_pylist()}
    values, _, inverse = _words(tokens.hash)
    c, skips = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    for g, a, b in _cuts(values, groups):
        c[a:b] = _from_thin(rows[g]["counts"])
        skips[a:b] = c[a:b] + _unfolded(_from_thin(rows[g]["skips"]))
    c, skips = c[inverse], skips[inverse]
    del inverse
    grams, found, place = _own_counts(tokens.grams(bits), np.tile(own, LEVELS), bits, places=True)
    for g, a, b in _cuts(grams, groups):
        found[a:b] += _from_planes(rows[g]["gram_counts"]).astype(np.int64)
    del grams, rows
    joint = found[place].reshape(LEVELS, -1)
    share = np.maximum(mass + (np.arange(CLASSES) > 0), 1)
    base = _rounded(np.exp(class_scores(weights, tokens)) * (c + 1) / share[tokens.cls])
    return _Counted(tokens.bounds, own, base, c, skips, joint)


def _fit_bucket(weights, classes, mass, total: int, vocabulary: int, groups: int, bits: int):
    """The bucket's fitted shares, and its documents with their tokens' base
    and counts, ROW_TOKENS or a document in a row."""
    names = [f.split()[0] for f in _FITTED.split(", ")][:9] + ["fit"]
    longs, binary = pa.list_(pa.int64()), pa.binary()
    fitted = pa.list_(pa.struct([("level", pa.int32()), ("bin", pa.int32()), ("share", pa.float64()),
                                 ("weight", pa.float64())]))
    types = [longs, pa.list_(pa.bool_()), longs, longs, pa.list_(pa.float64()), binary, binary, binary, binary, fitted]

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            b = _counted(docs, counts, weights.value, classes, mass, groups, bits)
            fit = [dict(zip(("level", "bin", "share", "weight"), f)) for f in b.fit()]
            at, n = b.bounds[:-1], np.diff(b.bounds)
            ids, train = docs.column("doc_id").to_pylist(), docs.column("train").to_numpy()
            known = np.add.reduceat((b.counts > 0).astype(np.int64), at)
            unigrams = np.add.reduceat(np.log10(b.counts + 1.0), at) - n * np.log10(total + 1 * (vocabulary + 1))
            cuts = np.unique(np.append(np.searchsorted(at, np.arange(0, b.bounds[-1], ROW_TOKENS)), len(n)))
            for x, y in zip(cuts.tolist(), cuts[1:].tolist()):
                lo, hi = int(b.bounds[x]), int(b.bounds[y])
                rows.append((ids[x:y], (~train[x:y]).tolist(), n[x:y], known[x:y], unigrams[x:y],
                             _thin(b.base[lo:hi].view(np.uint32)), _thin(b.counts[lo:hi]),
                             _thin(_folded(b.skips[lo:hi] - b.counts[lo:hi])), _thin(b.joint[:, lo:hi].ravel()),
                             fit if x == 0 else []))
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)],
                        names=names)
    return run


def _shares(fitted: DataFrame) -> np.ndarray:
    """Share per level and bin, buckets weighted by their tokens; a bin that
    was not fitted has the share of the next smaller one."""
    out = np.full((LEVELS, BINS), np.nan)
    out[:, 0] = 0
    for r in fitted.groupBy("level", "bin").agg(
            (F.sum(F.col("share") * F.col("weight")) / F.sum("weight")).alias("share")).collect():
        out[r.level, r.bin] = r.share
    for j in range(1, BINS):
        out[:, j] = np.where(np.isnan(out[:, j]), out[:, j - 1], out[:, j])
    return out


def _score_rows(shares: np.ndarray):
    """Scores of the documents whose counts stand in a row."""
    names = [f.split()[0] for f in _SCORES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(n)[k] for n in batch.schema.names}
                n = r["n_tokens"].values.to_numpy()
                bounds = np.concatenate(([0], np.cumsum(n)))
                own = np.repeat(~r["held_out"].values.to_numpy(zero_copy_only=False), n).astype(np.int64)
                counts = _from_thin(r["counts"].as_py())
                b = _Counted(bounds, own, _from_thin(r["base"].as_py()).astype(np.uint32).view(np.float32), counts,
                             counts + _unfolded(_from_thin(r["skips"].as_py())), _from_thin(r["joint"].as_py()).reshape(LEVELS, -1))
                score = np.add.reduceat(np.log10(b.probs(shares)), bounds[:-1])
                yield pa.RecordBatch.from_arrays(
                    [r[x].values for x in ("doc_id", "held_out", "n_tokens", "n_known", "unigrams")] + [pa.array(score)],
                    names=names)
    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with compressed texts; null text is empty."""
    import zstandard
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in slices(batches, "text", BUCKET_BYTES):
        z = [pack((t or "").encode()) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("bucket"), b.column("train"), pa.array(z, pa.binary())],
                                         names=["doc_id", "bucket", "train", "z"])


def score_documents(docs: DataFrame, training: Column | None = None) -> DataFrame:
    """Every document row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (unigrams) and score (the model), both log10.

    ``training`` selects the rows to learn from (default: not held out).
    Null or empty text is the end token alone.  Repeated rows count as often
    as they stand there.  A training row's n-grams count without the token
    that is scored.  Without training rows every class is equally likely and
    all words are unknown.
    """
    spark = docs.sparkSession
    training = ~held_out(F.col("doc_id")) if training is None else training
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         training.alias("train"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = max(1, -(-size // BUCKET_BYTES)), max(1, -(-size // GROUP_BYTES))
    bits = gram_bits(size)
    rows = "doc_id long, bucket int, train boolean, z binary"
    # By doc_id and text: rows of one id, or without id, are dealt apart.
    source = source.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    dealt = source.select("doc_id", "bucket", "train", "text").mapInArrow(_packed, rows)
    path = scratch_path(spark, "maxent-counts")
    classes = learn_classes(source.where("train"))
    dealt.groupBy("bucket").applyInArrow(
        _bucket_words(groups, classes, bits), _WORDS) \
        .groupBy("grp").applyInArrow(_group_counts(bits), _COUNTS).write.parquet(path)
    counts = spark.read.schema(_COUNTS).parquet(path)
    sums = counts.where("bucket = -1").agg(
        F.sum("vocabulary"), F.sum("tokens"), *[F.sum(F.col("mass")[k]) for k in range(CLASSES)]).first()
    vocabulary, total = sums[0] or 0, sums[1] or 0
    mass = np.array([x or 0 for x in sums[2:]], np.int64)
    weights = spark.sparkContext.broadcast(train(source.where("train"), classes))
    back = counts.where("bucket >= 0").select("bucket", "grp", "counts", "skips", "gram_counts")
    parts = scratch_path(spark, "maxent-fitted")
    dealt.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(
        _fit_bucket(weights, classes, mass, total, vocabulary, groups, bits), _FITTED) \
        .write.option("parquet.block.row.count.limit", GROUP_ROWS).option("compression", "zstd").parquet(parts)
    fitted = spark.read.schema(_FITTED).parquet(parts)
    shares = _shares(fitted.select(F.inline("fit")))
    return fitted.drop("fit").mapInArrow(_score_rows(shares), _SCORES) \
        .withColumn("train_tokens", F.lit(total).cast("long"))
