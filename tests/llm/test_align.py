"""Token alignment against whole-text tokenizers and all-pairs overlaps."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelkit.llm import align


@pytest.fixture(scope="module")
def whole():
    """(ids, bytes) of both tokenizers over whole texts, by their own libraries."""
    import json
    a = Tokenizer.from_file(align.byte_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=align.piece_path())
    with open(align.byte_path(), encoding="utf-8") as f:
        name = {v: k for k, v in json.load(f)["model"]["vocab"].items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}

    def run(text):
        if not text:
            return [], []
        left = [(i, bytes(byte[c] for c in name[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                  else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        raw = (" " + text).encode()
        if b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
            return [], []
        return left, right
    return run


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows, whole):
    docs, count = [], Counter()
    for d, text in rows:
        a, b = (spans(x) for x in whole(text))
        links, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        ai = bi = 0
        for end in common:
            left, right = [], []
            while ai < len(a) and a[ai][2] <= end:
                left.append(str(a[ai][0]))
                ai += 1
            while bi < len(b) and b[bi][2] <= end:
                right.append(str(b[bi][0]))
                bi += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        count.update(links)
        docs.append((d, len(a), len(b), groups, links))
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return [(d, na, nb, len(g), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for d, na, nb, g, links in docs]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.fixture(params=["small", "odd"])
def docs(request):
    return request.getfixturevalue(request.param)


@pytest.mark.parametrize("size", [2000, align.SLICE_BYTES])
def test_align_documents(docs, whole, size):
    df, rows = docs
    if size == 2000:
        df = df.repartition(5)
    got = [tuple(r) for r in align.align_documents(df, size=size).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, whole), key=key)


ALPHABET = list("ab'sé1 \n\t\r\x1c\x85\xa0 　<>#~日本🙂ÿ\x00▁") + [
    "'ll", "  ", " \n", "\n\n", ");\r", "don't", "</s>", "<|endoftext|>", "<0x0A>", " ", " ", "�"]


def test_units_equal_whole_texts(whole):
    """Texts cut at spaces and line feeds give the tokens of whole texts."""
    rng, cuts = random.Random(1), align._cuts()
    tok = align.Tokenizers(align.byte_path(), align.piece_path())
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    cut = align.Slice(texts, tok, cuts)
    kept = 0
    for text, d in zip(texts, cut.docs):
        a, b = whole(text)
        got = [[int(i) for u in d for i in ids[at[u]:at[u + 1]]] for ids, at in ((cut.a, cut.a_at), (cut.b, cut.b_at))]
        assert got == [[i for i, _ in a], [i for i, _ in b]], repr(text)
        kept += bool(a)
    assert kept > 2000 and kept < len(texts)       # "▁" itself is written back as a space


def test_gallop_equals_search():
    rng = np.random.default_rng(0)
    ends = np.cumsum(rng.integers(1, 5, 5000))
    lo = rng.integers(0, 5000, 3000)
    hi = np.minimum(5000, lo + rng.integers(0, 4000, 3000))
    x = rng.integers(0, ends[-1] + 3, 3000)
    want = [l + np.searchsorted(ends[l:h], v) for l, h, v in zip(lo, hi, x)]
    assert (align.gallop(ends, lo, hi, x) == want).all()


def test_long_unit_without_spaces(spark, whole):
    rng = random.Random(2)
    rows = [(1, "".join(rng.choice("abcdefghij日本語é") for _ in range(20_000))), (2, "a" * 5000), (3, "日" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, align.align_documents(df).collect())) == sorted(brute(rows, whole))


def test_pair_counts_and_groups(spark, small, whole):
    df, rows = small
    found = align.scanned(df)
    got = {(r.a_id, r.b_id): r.n for r in align.pair_counts(found).collect()}
    total = Counter()
    for r in brute(rows, whole):
        total["links"] += r[4]
    assert sum(got.values()) == total["links"]
    by = {d: t for d, t in rows}
    for r in align.aligned_groups(df).limit(50).collect():
        a, b = whole(by[r.doc_id])
        assert r.a_ids == [i for i, _ in a] and r.b_ids == [i for i, _ in b]
        at = [np.cumsum([0, *[len(x) for _, x in t]]) for t in (a, b)]
        assert [int(at[0][k]) for k in r.a_ends] == [int(at[1][k]) for k in r.b_ends]
        assert len(r.a_ends) == len(set(at[0][1:].tolist()) & set(at[1][1:].tolist()))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.align_documents(df).count() == 0 and align.aligned_groups(df).count() == 0
    only = spark.createDataFrame([(1, None), (2, ""), (None, "")], "doc_id long, text string")
    assert {tuple(r)[1:] for r in align.align_documents(only).collect()} == {(0, 0, 0, 0, 0, 0, "")}
