"""The audit of all filter orders against a loop over orders, on rows with nulls, repeats, ties and clashing names."""

import collections
import itertools
import re

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VARIED = " ".join(f"word{i}" for i in range(250))
TEXTS = [VARIED, VARIED + " $", VARIED.upper(), "a b " * 150, "a b | " * 150, None, "", " \n ", "Ünï " * 30, "$" * 70_000, VARIED + " end", "A B C " * 100]


def failures(text, others):
    t = text or ""
    ws = WORD.findall(t)
    tests = (len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), any((o or "") == t for o in others))
    return {x for x, bad in zip("ABCDE", tests, strict=True) if bad}


def wanted(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    flagged = [(lang or "", i, failures(t, [u for j, u, _ in rows if i is not None and j is not None and j < i])) for i, t, lang in rows]
    out, total = {}, collections.Counter()
    for part in {p for p, *_ in flagged}:
        own = [(i, f) for p, i, f in flagged if p == part]
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                left = [(i, f) for i, f in own if not f & set(order[:k])]
                gone = [i for i, f in left if x in f]
                total[part, x] += len(gone)
                out[part, "".join(order), k + 1] = (
                    len(left) - len(gone), len(gone), sum(x in f and bool(f & set(order[:k])) for _, f in own), sum(f == {x} for _, f in own),
                    sum(i in good for i in gone), sum(i in toxic for i in gone),
                )
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("hot", [1000, 2])
def test_every_order(spark, monkeypatch, hot):
    from spanforge.llm import filter_audit

    monkeypatch.setattr(filter_audit, "HOT", hot)
    rng = np.random.default_rng(3)
    rows = [(int(i), TEXTS[rng.integers(len(TEXTS))], [None, "", "en", "de"][rng.integers(4)]) for i in range(90)]
    rows += [(3, VARIED, "en"), (3, VARIED, "en"), (None, VARIED, "de"), (None, None, None)]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, lang string, subset int, __first int, fails string").repartition(3)
    named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, named).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found} == wanted(rows, labels) and len(found) == 3 * 600
    assert filter_audit.audit(docs.filter("doc_id > 99"), named).count() == 0
    assert filter_audit.audit(docs, named.filter("doc_id > 99")).groupBy().sum("good_lost").first()[0] == 0


def test_bitmaps_of_many_parts():
    """Parts that end within a word of bits, at one's end and beyond it."""
    from spanforge.llm.filter_audit import bitmaps

    rng = np.random.default_rng(1)
    codes = rng.permutation(np.repeat(np.arange(6), [1, 63, 64, 65, 300, 2]))
    masks = rng.integers(0, 1 << 5, len(codes))
    found = bitmaps(codes, masks, 3)
    for part, subset in itertools.product(range(6), range(8)):
        own = masks[(codes == part) & (masks & subset == 0)]
        assert list(found[part, subset]) == [len(own), (own >> 3 & 1).sum(), (own >> 4 & 1).sum()]
