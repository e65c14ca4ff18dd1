"""Fill-in-middle outputs against slicing, and round trips."""

import hashlib
import random

import pytest

from panelkit.llm import fim


def plain_form(doc, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.fixture(params=["small", "odd"])
def docs(request):
    return request.getfixturevalue(request.param)


@pytest.mark.parametrize("chunk", [7, fim.CHUNK])
def test_assemble(docs, chunk):
    df, rows = docs
    if chunk == 7:
        df, rows = df.limit(40), None
        rows = [(r.doc_id, r.text) for r in df.collect()]
    got = [tuple(r) for r in fim.assemble(df.repartition(3), chunk=chunk).collect()]
    want = []
    for d, t in rows:
        n, form, p, m, out = plain_form(d, t)
        want.append((d, n, form, p, m, sha(out), sha(t or "")))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_transform_and_restore(docs):
    df, rows = docs
    out = fim.transform(df)
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()]
    assert sorted(got, key=key) == sorted(((d, *plain_form(d, t)) for d, t in rows), key=key)
    back = [tuple(r) for r in fim.restore(out, chunk=11 if len(rows) < 50 else fim.CHUNK).collect()]
    assert sorted(back, key=key) == sorted(((d, t or "") for d, t in rows), key=key)


def test_half_markers_at_every_cut():
    """Texts made of marker characters: the splitter finds the true markers,
    whatever the pieces."""
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "P", ">", "S", "M", "<P", "S>", "é", "<M<"]) for _ in range(rng.randrange(9)))
        if not text or any(m in text for m in fim.MARKS.values()):
            continue
        lo, hi = sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))
        for form in fim.LAYOUT:
            raw = "".join(fim.segments(text, form, lo, hi)).encode()
            step, split, got = rng.randrange(1, 6), fim.Splitter(form), {s: b"" for s in "PMS"}
            parts = [x for k in range(0, len(raw), step) for x in split.feed(raw[k:k + step])]
            for s, part in [*parts, *split.end()]:
                got[s] += part
            assert {s: v.decode() for s, v in got.items()} == {"P": text[:lo], "M": text[lo:hi], "S": text[hi:]}


def test_units_by_pattern(spark):
    """Cuts fall between words, and the last unit takes the rest."""
    rows = [(d, " ".join(f"w{d}x{k}" for k in range(d))) for d in range(60)] + [(99, "   "), (98, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in fim.transform(df, plain=100, unit=r"\s*\S+").collect()}
    for d, t in rows[1:60]:
        r = out[d]
        assert r.n == d and r.form != "plain"
        for at in (r.prefix_chars, r.prefix_chars + r.middle_chars):
            assert at in (0, len(t)) or t[at] == " "
    assert out[99].n == 1 and out[98].form == "plain"
    assert sorted(map(tuple, fim.restore(fim.transform(df, unit=r"\s*\S+")).collect())) == sorted(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "same text of two rows")] * 300 + [(None, None)] * 40 + [(None, "x")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fim.assemble(df, chunk=4).collect()
    assert len(got) == len(rows)
    assert sum(r.restored_sha256 == sha("same text of two rows") for r in got) == 300
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.assemble(empty).count() == 0 and fim.restore(fim.transform(empty)).count() == 0


def test_pieces_spread_over_partitions(spark):
    """Many rows of one text and one id do not meet in one partition."""
    df = spark.createDataFrame([(1, "the same")] * 800, "doc_id long, text string").repartition(8)
    sizes = fim._pieces(df, 1, 90, 20, None, fim.CHUNK).mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert len(sizes) == 8 and max(sizes) < 3 * sum(sizes) / len(sizes)
