"""Ranked search against scoring every document, and the cutting of lists against all cuts."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def ranked(rows, items, k):
    held = [(i, collections.Counter(terms(t))) for i, t in rows]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(x for _, c in held for x in c)
    out = {}
    for item, text in items:
        if item is None:
            continue
        wanted = collections.Counter(x for j, t in items if j == item for x in terms(t))
        scores = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n) // total if c else 0
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x, q in wanted.items() if c[x])
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out[item] = [(-s, i if has else None) for s, has, i in sorted(scores)[:k]]
    return {i: v for i, v in out.items() if v}


def test_search_against_every_document(spark):
    from spanforge.llm.ranked_search import Layout, build_index, search

    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)] + ["Ünï", "日本", "A-b", "x_y", "dup"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 5, 40, 200]))) for _ in range(120)]
    rows = [(i * 3 % 119, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, " -- "), (None, "w1 w2 dup dup"), (None, None), (600, "dup w1"), (600, "dup w1"), (601, "dup w1"), (602, "w3 " * 20_000)]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(25)] + [(30, "dup W1 w1"), (31, None), (32, ""), (33, "nowhere"), (None, "w1"), (34, "dup"), (34, "w7 w8"), (35, "日本 ünï ab x y")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, item_id string, shard int, doc int").repartition(3)
    queries = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, term string")
    wanted = ranked(rows, items, 10)
    for layout in (Layout(), Layout(shard_bytes=2000, overhead=2, longest=5, items=4)):
        found = collections.defaultdict(list)
        for r in search(build_index(docs, layout), queries).orderBy("item_id", "rank").collect():
            found[r["item_id"]].append((r["score"], r["doc_id"]))
            assert r["rank"] == len(found[r["item_id"]])
        assert dict(found) == wanted
    none = build_index(docs.filter("doc_id > 9999"))
    assert none.members.count() == 0 == search(none, queries).count() == search(build_index(docs), queries.filter("item_id > 99")).count()


@pytest.mark.parametrize("longest", [3, 64])
def test_blocks_have_the_least_bound_error(longest):
    from spanforge.llm.ranked_search import block_ends

    rng = np.random.default_rng(longest)
    lists = [rng.integers(1, 100, n) for n in [1, 2, 3, 5, 8, 9, 9, 1, 7]]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    ends = block_ends(np.concatenate(lists), first, 2, longest)
    for i, x in enumerate(lists):
        cost = lambda cuts, x=x: sum((b - a) * x[a:b].max() + 2 * x.max() for a, b in itertools.pairwise([0, *cuts, len(x)]))
        every = (c for n in range(len(x)) for c in itertools.combinations(range(1, len(x)), n) if all(b - a <= longest for a, b in itertools.pairwise([0, *c, len(x)])))
        own = ends[(ends > first[i]) & (ends <= first[i + 1])] - first[i]
        assert own[-1] == len(x) and max(np.diff([0, *own])) <= longest and cost(own[:-1]) == min(map(cost, every))


def test_blocks_are_skipped(monkeypatch):
    """A shard's search scores few of the documents that its lists hold, and finds the same as all scores do."""
    from spanforge.llm import ranked_search

    rng = np.random.default_rng(2)
    lists, every = [], np.zeros(20_000, "i8")
    for size, weight in ((15_000, 3), (9_000, 20), (400, 900)):
        docs = np.sort(rng.choice(20_000, size, replace=False)).astype("i4")
        impacts = rng.integers(1, 200, size).astype("i4")
        impacts[rng.choice(size, 20, replace=False)] = 900
        ends = ranked_search.block_ends(impacts, np.array([0, size]), 8, 64)
        lists.append((docs, impacts, ends, np.maximum.reduceat(impacts, np.concatenate([[0], ends[:-1]]))))
        every[docs] += weight * impacts.astype("i8")
    asked, find = [], np.searchsorted
    monkeypatch.setattr(ranked_search.np, "searchsorted", lambda own, docs, **k: asked.append(len(docs)) or find(own, docs, **k))
    docs, scores = ranked_search.best(lists, np.array([3, 20, 900]), 10)
    top = np.lexsort((np.arange(20_000), -every))[:10]
    assert list(docs) == list(top) and list(scores) == list(every[top]) and max(asked) < 1_000
