"""Plain-Python versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import log10

BIG = float("inf")


def words(text):
    return (text or "").encode().split()


def lower(raw):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in raw)


def repeats(rows, window=13):
    """{(doc_id, text): (n_words, n_removed, kept)}"""
    first = {}
    for doc, text in rows:
        ws = words(text)
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i:i + window])
            first[key] = min(first.get(key, BIG), BIG if doc is None else doc)
    out = {}
    for doc, text in rows:
        ws = words(text)
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i:i + window])] < (BIG if doc is None else doc):
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()
        out[doc, text] = (len(ws), len(gone), kept)
    return out


def shingles(text, k=5):
    ws = [lower(w) for w in words(text)]
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)])


def class_of(rows, num=75, den=100):
    """A number of every row's class, in the rows' order."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = Counter()
    for hs in holders.values():
        for a in range(len(hs)):
            for b in range(a + 1, len(hs)):
                shared[hs[a], hs[b]] += 1
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            up[root(a)] = root(b)
    return [root(i) for i in range(len(rows))]


def link_counts(rows, num=75, den=100):
    """Every row's number of links, in the rows' order."""
    sets = [shingles(t) for _, t in rows]
    out = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                out[i] += 1
                out[j] += 1
    return out


def near_duplicates(rows):
    """[(doc_id, n_shingles, component_id)] in the rows' order."""
    classes, least = class_of(rows), {}
    for c, (doc, _) in zip(classes, rows):
        if doc is not None:
            least[c] = min(least.get(c, BIG), doc)
    return [(doc, len(shingles(t)), least.get(c) if words(t) else doc) for c, (doc, t) in zip(classes, rows)]


def item_words(text):
    return [w for w in re.split(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower((text or "").encode())) if w]


def contamination(rows, items, width=10):
    """[(doc_id, n_words, n_hit, n_items, items_sha256)]"""
    windows = defaultdict(set)
    for item, text in items:
        ws = item_words(text)
        n = min(len(ws), width)
        for i in range(len(ws) - n + 1 if ws else 0):
            windows[tuple(ws[i:i + n])].add(item)
    lens = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        ws, hit, found = item_words(text), set(), set()
        for n in lens:
            for i in range(len(ws) - n + 1):
                if (owners := windows.get(tuple(ws[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= owners
        ids = sorted(str(f) for f in found if f is not None)
        out.append((doc, len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()))
    return out


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ("assign", "access", "hex")
    return [f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(out)]


def unigrams(rows):
    """[(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)]"""
    def tokens(text):
        return [lower(w) for w in words(text)] + [None]
    out = [doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2 for doc, _ in rows]
    counts = Counter(t for held, (_, text) in zip(out, rows) if not held for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    res = []
    for held, (doc, text) in zip(out, rows):
        ts = tokens(text)
        res.append((doc, held, len(ts), sum(counts[t] > 0 for t in ts), n,
                    sum(log10(Fraction(counts[t] + 1, n + v + 1)) for t in ts)))
    return res


def line_dedup(rows, window=3):
    """{(doc_id, text): (n_lines, n_removed, text)}"""
    ws = " \t\n\x0b\x0c\r"
    held = {row: [(i, ln.strip(ws)) for i, ln in enumerate((row[1] or "").split("\n")) if ln.strip(ws)] for row in set(rows)}
    places = defaultdict(list)
    for row, lines in held.items():
        for k in range(len(lines) - window + 1):
            places[tuple(x for _, x in lines[k:k + window])].append((row, k))
    gone = defaultdict(set)
    for found in places.values():
        for row, k in sorted(found, key=lambda p: (-1 if p[0][0] is None else p[0][0], p[1]))[1:]:
            gone[row].update(held[row][k + j][0] for j in range(window))
    out = {}
    for row, lines in held.items():
        text = row[1]
        if gone[row]:
            text = "\n".join(ln for i, ln in enumerate(text.split("\n")) if i not in gone[row])
        out[row] = (len(lines), len(gone[row]), text)
    return out


def quality(rows, max_docs, min_remaining):
    """[(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)]
    of (doc_id, text, source) rows with distinct ids."""
    def norm(line):
        return re.sub("[0-9]", "0", b" ".join(line.encode().split()).decode()).lower()
    hosts = defaultdict(set)
    for doc, text, source in rows:
        for line in (text or "").split("\n"):
            if words(line):
                hosts[source, norm(line)].add(doc)
    out = []
    for doc, text, source in rows:
        text = text or ""
        ws = words(text)
        lines = [ln for ln in text.split("\n") if words(ln)]
        tri = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
        rep = {i + k for i in range(len(ws) - 2) if tri[tuple(ws[i:i + 3])] > 1 for k in range(3)}
        gone = sum(len(words(ln)) for ln in lines
                   if len(hosts[source, norm(ln)]) > max_docs and min(hosts[source, norm(ln)]) != doc)
        failed = len(ws) < 50 or 100 * len(rep) > 50 * len(ws)
        out.append((doc, len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in text),
                    len(lines) - len(set(lines)), len(rep), failed,
                    not failed and not 100 * (len(ws) - gone) < min_remaining * len(ws)))
    return out
