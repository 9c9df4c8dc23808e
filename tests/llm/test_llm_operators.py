"""Each operator on a small table with nulls, empty and very long texts, repeated rows and clashing names, against brute force."""

import collections
import math
import re
import zlib

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards quietly pack five dozen heavy jugs of ale near old stone bridges at dawn"
VARIED = " ".join(f"word{i} and{i % 7}" for i in range(400))
TEXTS = [
    (0, SENTENCE), (1, SENTENCE.upper()), (2, None), (3, ""), (4, "  \n\t "), (5, "one two"), (6, "ONE  two"), (7, SENTENCE + " extra"), (8, VARIED), (9, VARIED + " end"),
    (10, "of " * 3000), (11, "x" * 70000 + " " + SENTENCE), (12, "naïve café ünïcode — “quoted” 日本語 <|endoftext|> end"), (12, "same id other text"), (13, SENTENCE), (13, SENTENCE),
    (None, SENTENCE), (None, None), (14, "a b c d e f g h\n" * 30), (15, "x " + SENTENCE.replace("lazy", "sleepy").replace("heavy", "light")),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 2, 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, h int, __uid int").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id > 99")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def test_overlaps(spark, docs, none):
    from spanforge.llm.decontaminate import MASKS, Overlap, find_overlaps, remove_contaminated

    item = " ".join(SENTENCE.split()[2:20])
    items = spark.createDataFrame([(1, item, "x"), (2, "short one", "x"), (3, None, "x"), (None, item, "x"), (4, item.upper() + "!", "x"), (1, item, "x")], "item_id long, text string, doc_id string")
    found = find_overlaps(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(d, i) for d in (0, 1, 7, 11, 13, 15) for i in (1, 4)}
    assert find_overlaps(docs, items, Overlap(block_words=5)).count() == len(found)
    assert find_overlaps(none, items).count() == 0 == find_overlaps(docs, items.filter("item_id > 9")).count()
    left = [r["doc_id"] for r in remove_contaminated(docs, items).collect()]
    assert 0 not in left and left.count(None) == 1 and 8 in left  # of the rows without doc_id that with a passage goes
    for size, misses in ((13, 2), (8, 1)):  # the masks miss no such window
        import itertools

        for bad in itertools.combinations(range(size), misses):
            assert any(all(o + i not in bad for i, c in enumerate(m) if c == "1") for m in MASKS for o in range(size - len(m) + 1))


def test_warc(spark, none):
    from spanforge.llm import warc

    rows = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, None), (4, "u4", ""), (None, "u5", "<p>a</p>"), (6, "é\r\nX: y", "ü" * 100_000), (7, "u7", None)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, refers_to int")
    out = warc.fresh_path(spark, "t")
    warc.write_archive(pages, out)
    back = {r["page_id"]: r for r in warc.read_archive(spark, out, check=True).collect()}
    assert len(back) == 7
    for i, _, html in rows:
        payload = (html or "").encode()
        assert back[i]["payload_bytes"] == len(payload) and back[i]["payload_digest"] == warc.digest32(payload)
    assert {i: back[i]["refers_to"] for i in back} == {1: None, 2: 1, 3: None, 4: 3, None: 1, 6: None, 7: 3}
    assert bytes(back[6]["payload"]) == ("ü" * 100_000).encode()
    some = warc.read_archive(spark, out).filter("record_type = 'revisit' and page_id > 1")
    assert {r["page_id"] for r in some.collect()} == {2, 4, 7}
    assert warc.round_trip(pages.filter("page_id > 99")).count() == 0
    import io

    data = warc.member(warc.record(1, "u", b"abc", None, False)) * 2 + __import__("gzip").compress(warc.record(2, "v", b"defg", None, False))
    assert [r.headers["x-page-id"] for r in warc.read_records(io.BytesIO(data))] == ["1", "1", "2"]
    assert [r.block()[-4:] for r in warc.read_records(io.BytesIO(data), lambda h: h["x-page-id"] == "2")] == [b"defg"]
    assert [len(r.block()) > 0 for r in warc.read_records(io.BytesIO(warc.record(1, "u", b"abc", None, False) * 3))] == [True] * 3


def test_warc_reads_payloads_only_when_asked(spark, tmp_path):
    """Payloads stay compressed until block() is called; archives of others, plain or compressed, with or without member sizes; ids that revisits name."""
    import gzip
    import io

    from spanforge.llm import warc

    big = warc.record(1, "u", b"z" * 5_000_000, None, False)
    for data in (warc.member(big) * 2, gzip.compress(big) * 2, big * 2):
        seen = [(r, r.inflated) for r in warc.read_records(io.BytesIO(data))]
        assert [n for _, n in seen] == [0, 0]
        for r in warc.read_records(io.BytesIO(data)):
            assert r.block().endswith(b"z" * 100) and r.inflated > 5_000_000
    assert warc.record(1, "u", b"a", None, False) == warc.record(1, "u", b"a", None, False)
    headers = [next(warc.read_records(io.BytesIO(warc.record(*x)))).headers for x in ((1, "u", b"a", None, False), (2, "v", b"a", 1, True))]
    assert headers[1]["warc-refers-to"] == headers[0]["warc-record-id"] != headers[1]["warc-record-id"]
    (tmp_path / "a.warc").write_bytes(warc.record(1, "u", b"plain", None, False))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(warc.record(2, "v", b"zipped", None, False)))
    got = {r["page_id"]: r for r in warc.read_archive(spark, str(tmp_path)).collect()}
    assert {i: bytes(r["payload"]) for i, r in got.items()} == {1: b"plain", 2: b"zipped"}
    bare = {r["page_id"]: r for r in warc.read_archive(spark, str(tmp_path), payload=False).collect()}
    assert all(r["payload"] is None for r in bare.values()) and {i: r["payload_bytes"] for i, r in bare.items()} == {1: 5, 2: 6}
    assert [r["page_id"] for r in warc.read_archive(spark, str(tmp_path)).filter("target_uri like 'v%' and record_type = 'response'").collect()] == [2]


def brute_components(texts, n, percent):
    sets = []
    for _, t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    best = {}
    for i, (d, _) in enumerate(texts):
        best[top(i)] = min((x for x in (best.get(top(i)), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), best[top(i)] if sets[i] else d) for i, (d, _) in enumerate(texts)), key=str)


@pytest.mark.parametrize("n,percent,frequent", [(3, 90, 8), (5, 80, 1)])
def test_components(docs, none, n, percent, frequent):
    from spanforge.llm.jaccard_join import Similar, similar_components

    found = similar_components(docs, Similar(words=n, percent=percent, frequent=frequent)).collect()
    assert sorted(map(tuple, found), key=str) == brute_components(TEXTS, n, percent)
    assert similar_components(none).count() == 0


def test_components_of_hot_tokens(spark):
    """Copies, near copies and boilerplate beyond the limit of frequent tokens; crowds of near copies that aren't all similar enough."""
    import random

    from spanforge.llm.jaccard_join import Similar, similar_components

    rng, texts = random.Random(3), []
    base, plate = [f"b{i}" for i in range(60)], [f"p{i}" for i in range(12)]
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"x{i}"
        texts.append((i, " ".join(w)))
    texts += [(100 + i, " ".join(plate + [f"o{i}_{k}" for k in range(rng.randint(1, 40))])) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for percent, crowd in ((80, 8), (80, 1), (90, 2), (60, 2)):
        found = similar_components(df, Similar(words=3, percent=percent, frequent=3, crowd=crowd)).collect()
        assert sorted(map(tuple, found), key=str) == brute_components(texts, 3, percent)


def test_shards(docs, none):
    from spanforge.llm.sharding import assign_shards

    got = assign_shards(docs, shards=7).collect()
    assert sorted(r["place"] for r in got) == list(range(len(TEXTS)))
    per = collections.defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    wanted = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in TEXTS)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == wanted
    key = lambda rs: sorted((str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"]) for r in rs if r["doc_id"] not in (None, 13))
    assert key(assign_shards(docs.repartition(5), shards=7).collect()) == key(got)
    assert assign_shards(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 17, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    from spanforge.llm.sharding import permute

    assert sorted(r[0] for r in spark.range(n).select(permute(F.col("id"), n)).collect()) == list(range(n))


def encodings(name, end):
    from tokenizers import Tokenizer

    from spanforge.llm.encode import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path(name))
    return [(d, [*t.encode(x or "", add_special_tokens=False).ids, end]) for d, x in TEXTS]


def crc(ids):
    import numpy as np

    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_token_files(docs, none, planes):
    from spanforge.llm.planes import round_trip

    got = sorted(round_trip(docs, planes=planes).collect(), key=lambda r: r["start"])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(d), len(i), crc(i)) for d, i in encodings("byte_bpe_50k.json", 0))
    ids, at = [r["doc_id"] for r in got], 0
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d)
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert round_trip(none).count() == 0


def test_token_counts(docs, none):
    import sentencepiece

    from spanforge.llm.encode import tokenizer_path
    from spanforge.llm.token_counts import prefix_token_counts, within_budget

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    counted = prefix_token_counts(docs).cache()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in counted.collect()) == sorted((str(d), len((t or "").encode()), len(model.encode(t or ""))) for d, t in TEXTS)
    for r in counted.filter("doc_id in (0, 8, 14)").collect():
        text = dict(TEXTS)[r["doc_id"]]
        for e, n in list(zip(r["ends"], r["counts"], strict=True))[:: max(1, len(r["ends"]) // 9)]:
            assert len(model.encode(text[:e])) == n
    kept = {r["doc_id"]: r for r in within_budget(counted, 10).collect()}
    assert len(model.encode(SENTENCE[: kept[0]["kept_chars"]])) == kept[0]["kept_tokens"] <= 10
    assert prefix_token_counts(none).count() == 0


def test_packing(docs, none):
    from spanforge.llm.packing import pack_documents

    for capacity in (16, 4096):
        got = pack_documents(docs, capacity=capacity).collect()
        wanted = sorted((str(d), k // capacity, k, len(i[k : k + capacity]), crc(i[k : k + capacity])) for d, i in encodings("word_bpe_49k.json", 1) for k in range(0, len(i), capacity))
        assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
        per = collections.defaultdict(list)
        for r in got:
            per[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in per.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(per) <= -(-sum(r["length"] for r in got) // capacity) + 1
    assert pack_documents(none).count() == 0


def fewest(items, cap):
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, cap - items[i]])

    go(0, [])
    return best[0]


def held_by(patterns, cap):
    held = collections.Counter()
    for pattern, times in patterns.items():
        assert sum(n * k for n, k in pattern) <= cap
        for n, k in pattern:
            held[n] += k * times
    return held


def test_bin_completion():
    import random

    from spanforge.llm.binpack import branch_and_bound, pack

    rng = random.Random(4)
    for _ in range(200):
        cap = rng.choice([10, 20, 37])
        items = sorted((rng.randint(1, cap) for _ in range(rng.randint(1, 10))), reverse=True)
        counts, alone = collections.Counter(items), collections.Counter(((n, 1),) for n in items)
        searched, settled = branch_and_bound(counts, cap, alone)
        for found in (pack(counts, cap), searched):
            assert sum(found.values()) == fewest(items, cap) and held_by(found, cap) == counts
        assert settled
    assert pack({}, 10) == {} and pack({10: 3}, 10) == {((10, 1),): 3}
    with pytest.raises(ValueError):
        pack({11: 1}, 10)


def test_completions_are_the_undominated_fillings():
    """Against all fillings, and dominance by trying every way to deal pieces out."""
    import itertools
    import random

    from spanforge.llm.binpack import completions, dominates

    def brute_dominates(a, b):
        return any(all(sum(x for x, g in zip(b, ways, strict=True) if g == i) <= n for i, n in enumerate(a)) for ways in itertools.product(range(len(a)), repeat=len(b)))

    as_pairs = lambda x: tuple(sorted(collections.Counter(x).items(), reverse=True))
    rng = random.Random(8)
    for _ in range(60):
        cap = rng.choice([12, 20])
        items = sorted((rng.randint(1, cap) for _ in range(rng.randint(2, 7))), reverse=True)
        longest, rest = items[0], items[1:]
        fits = {tuple(sorted(x, reverse=True)) for k in range(len(rest) + 1) for x in itertools.combinations(rest, k) if sum(x) <= cap - longest}
        for a, b in itertools.product(fits, repeat=2):
            if a and b:
                assert dominates(as_pairs(a), as_pairs(b)) == brute_dominates(a, b)
        good = {b for b in fits if not any(a != b and (brute_dominates(a, b) if a else not b) for a in fits)}
        got = list(completions(collections.Counter(items), longest, cap, cap))
        assert {tuple(n for n, k in p for _ in range(k)) for p in got} == {(longest, *b) for b in good}
        sums = [sum(n * k for n, k in p) for p in got]
        assert sums == sorted(sums, reverse=True)


def test_bin_completion_builds_the_packing(monkeypatch):
    """The packing is bin completion's even where best fit reaches the bound; triplets, which best fit misses, fill every bin."""
    import random

    from spanforge.llm import binpack

    assert binpack.pack({6: 2, 4: 2}, 10) == {((6, 1), (4, 1)): 2}
    rng = random.Random(2)
    for bins in (4, 6, 10, 20):
        counts = collections.Counter()
        for _ in range(bins):
            a = rng.randint(1025, 2047)
            b = rng.randint(1025, max(1025, 4096 - a - 1024))
            counts.update([a, b, 4096 - a - b])
        assert sum(binpack.best_fit_decreasing(counts, 4096).values()) > bins == sum(binpack.pack(counts, 4096).values())
    called = []
    real = binpack.completions
    monkeypatch.setattr(binpack, "completions", lambda *a, **k: called.append(1) or real(*a, **k))
    binpack.pack({7: 1, 3: 1}, 10)
    assert called


def brute_scores(texts, order, alpha=None, corpus=None):
    """(doc_id, n_words, log_score) by the corpus' counts; of other texts with alpha, unseen words with half a count."""
    grams, seen = collections.Counter(), [words(t) for _, t in (corpus or texts)]
    for w in seen:
        for n in range(1, order + 1):
            grams.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total, out = sum(map(len, seen)), []
    for d, t in texts:
        w, s = words(t), 0.0
        for i in range(len(w)):
            f = 1.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if grams[g]:
                    s += math.log10(f * grams[g] / (grams[g[:-1]] if n > 1 else total))
                    break
                f *= alpha if n > 1 else 1
            else:
                s += math.log10(f * 0.5 / total)
        out.append((str(d), len(w), s))
    return sorted(out)


def same_scores(found, wanted):
    found = sorted((str(r["doc_id"]), r["n_words"], r["log_score"], r["mean_score"]) for r in found)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 and (a[3] is None if not a[1] else abs(a[3] - b[2] / a[1]) < 1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_scores(docs, none, order):
    from spanforge.llm.lm_score import Model, backoff_scores

    same_scores(backoff_scores(docs, Model(order=order, sample=1, salt=3)).collect(), brute_scores(TEXTS, order))
    if order == 3:
        assert backoff_scores(none).count() == 0


def test_backoff_scores_of_hot_grams(spark, monkeypatch):
    """Hot n-grams, dealt out over several places, count as any other; so do documents of one and two words."""
    from spanforge.llm import lm_score

    texts = [(i, " ".join(["of the of"] * (i % 4) + ["end"] * (i % 3))) for i in range(60)] + [(90, "of"), (91, "of the"), (92, "Of"), (90, "of"), (93, "once")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    o = lm_score.Model(sample=1, salt=5)
    assert lm_score.hot_grams(df.selectExpr("doc_id as key", "text"), 3, o).count() > 0
    same_scores(lm_score.backoff_scores(df, o).collect(), brute_scores(texts, 3))


def test_backoff_of_other_documents(spark, docs):
    from spanforge.llm.lm_score import Model, ngram_counts, score_others

    others = [(1, "the quick brown cat jumps over a dog"), (2, "unseen words only"), (3, None), (4, SENTENCE), (4, "of of of the"), (None, "one")]
    counts = ngram_counts(docs, Model(order=3)).cache()
    got = score_others(spark.createDataFrame(others, "doc_id long, text string"), counts, Model(order=3)).collect()
    same_scores(got, brute_scores(others, 3, 0.4, TEXTS))


def test_rules(docs, none):
    from spanforge.llm.quality_rules import judge, references

    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)

    got = judge(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted((str(d), *brute(t)) for d, t in TEXTS)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    classes, keys, counts = references(docs)["en"]
    assert counts.sum() == sum(len(words(t)) for _, t in TEXTS) and len(keys) == 24
    assert judge(none).count() == 0


def test_classifier(spark, docs, none):
    from spanforge.llm.classifier import Settings, fit, score

    good = [(i, " ".join(f"w{(i * k) % 50}" for k in range(60)), 1) for i in range(300)]
    bad = [(i, " ".join(f"w{(i * k) % 50}$$$" for k in range(60)), 0) for i in range(300, 600)]
    rows = spark.createDataFrame([(i, t, "x") for i, t, _ in good + bad] + [(None, None, "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in good + bad] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    weights = fit(rows, labels, Settings(bits=12, rows=150))
    got = {r["doc_id"]: r for r in score(rows, weights, Settings(bits=12)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == (i < 300) for i in held) > 0.95 * len(held)
    assert 0 <= got[None]["score"] <= 1
    flat = fit(none, labels)
    assert not flat.any() and {r["score"] for r in score(docs, flat).collect()} == {0.5}
    assert score(none, flat).count() == 0


def test_classifier_by_scalars(spark):
    """Features, learning and scores against plain Python: FTRL-proximal a coordinate at a time."""
    import numpy as np

    import pyarrow as pa

    from spanforge.llm.classifier import Settings, features, fit, score, vector
    from spanforge.llm.words import text_bytes

    s = Settings(bits=10, rows=60, epochs=2)
    rows = [(i, f"w{i % 5} alpha{i % 3} alpha{i % 3} x{i} $$ !", int(i % 5 < 2)) for i in range(90)] + [(5, "another row of the same id", 1), (6, None, 1), (7, "", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows[:90]], "doc_id long, quality int, toxic int")
    weights = fit(docs, labels, s)

    def parts(t):
        number, at = features(*text_bytes(pa.array([t])), s.bits)
        f, v = vector(number, s.scale)
        counts = collections.Counter(number.tolist())
        plain = {k: 1 + math.log(n) for k, n in counts.items()}
        length = math.sqrt(sum(x * x for x in plain.values())) or 1
        assert {int(k): x for k, x in zip(f, v)} == pytest.approx({k: x * s.scale / length for k, x in plain.items()})
        return {int(k): float(x) for k, x in zip(f, v)}

    w = re.findall(r"[0-9A-Za-z]+|[^0-9A-Za-z\x20\x09-\x0D]+", "w1 a a $$")
    assert len(features(*text_bytes(pa.array(["w1 a a $$"])), 18)[0]) == len(w) + len(w) - 1 + 1  # words, pairs, one repeat
    hashed = {r["doc_id"]: r["h"] for r in labels.selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}
    text_hash = {r["text"]: r["h"] for r in docs.filter("text is not null").selectExpr("text", "xxhash64(text) as h").collect()}
    known = sorted((hashed[i], i, y) for i, _, y in rows[:90] if zlib.crc32(str(i).encode()) % 3 != 1)[: s.rows]
    texts = collections.defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(t)
    bias, z, n = 1 << s.bits, collections.Counter(), collections.Counter()

    def weight(k):
        return 0.0 if abs(z[k]) <= s.l1 else (math.copysign(s.l1, z[k]) - z[k]) / ((s.beta + math.sqrt(n[k])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for _, i, y in known:
            t = min((x for x in texts[i] if x is not None), key=lambda x: text_hash[x], default=None)
            if None in texts[i]:  # a null text has hash 42, of the seed
                t = min(texts[i], key=lambda x: 42 if x is None else text_hash[x])
            x = parts(t) | {bias: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
            for k, v in {k: (p - y) * v for k, v in x.items()}.items():
                old = weight(k)
                z[k] += v - (math.sqrt(n[k] + v * v) - math.sqrt(n[k])) / s.alpha * old
                n[k] += v * v
    assert np.allclose(weights, [weight(k) for k in range(bias + 1)], atol=1e-5)
    for r in score(docs, weights, s, keep=["doc_id", "text"]).collect():
        total = weight(bias) + sum(weight(k) * v for k, v in parts(r["text"]).items())
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-4 and r["predicted"] == (r["score"] >= 0.5)


def test_verdicts_by_scalars(spark):
    """Divergences and verdicts against plain Python, for own, pooled and null languages, with the guards of short texts."""
    import random

    from spanforge.llm.quality_rules import Rules, judge

    rng, rows = random.Random(11), []
    for i in range(60):
        lang = rng.choice(["en", "de", "xx", None])
        vocabulary = [f"{lang}{k}" for k in range(12)] + (["A$", "7", "é."] if i % 4 == 0 else [])
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 30, 80, 200]))) + rng.choice(["", "\n"]), lang))
    rows += [(100, None, "en"), (101, "", None), (102, "same " * 100, "de"), (103, "dup line here\n" * 40, "en")]
    o = Rules(common=5, reference_words=1000, class_chars=60, word_words=20)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kind = lambda c: 8 if ord(c) >= 128 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 4 if c == "\n" else 6 if c in "#*$%&|<>" else 5 if c in ".,;:?'\"()-" else 7
    shape = lambda t: [sum(kind(c) == k for c in t) for k in range(9)]

    def js(p, q):
        p, q = [x / max(1, sum(p)) for x in p], [x / max(1, sum(q)) for x in q]
        part = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x)
        return math.sqrt(max(0.0, part(p, q) + part(q, p)) / 2) if sum(p) else 0.0

    def reference(texts):
        counts = collections.Counter(x for t in texts for x in words(t))
        return [sum(k) for k in zip(*map(shape, texts))], counts

    pooled = reference([t or "" for _, t, _ in rows])
    own = {x: reference([t or "" for _, t, y in rows if y == x]) for x in ("en", "de", "xx")}
    # which of equally frequent words are common is settled by their hashes: the check leaves such references out
    clear = lambda c: len(c) <= o.common or sorted(c.values())[-o.common] > sorted(c.values())[-o.common - 1]
    checked = 0
    for r in judge(docs, rules=o).collect():
        text, lang = next((t or "", x) for d, t, x in rows if d == r["doc_id"])
        classes, counts = own[lang] if lang and sum(own[lang][1].values()) >= o.reference_words else pooled
        w = words(text)
        assert (r["class_js"] is None) == (len(text) < o.class_chars) and (r["word_js"] is None) == (len(w) < o.word_words)
        if r["class_js"] is not None:
            assert abs(r["class_js"] - js(shape(text), classes)) < 1e-9
        if r["word_js"] is not None and clear(counts):
            common = [x for x, _ in counts.most_common(o.common)]
            hist = lambda c: [c[x] for x in common] + [sum(c.values()) - sum(c[x] for x in common)]
            assert abs(r["word_js"] - js(hist(collections.Counter(w)), hist(counts))) < 1e-9
            checked += 1
        over = (r["class_js"] or 0) > o.class_limit or (r["word_js"] or 0) > o.word_limit
        assert r["kept"] == (not r["base_failed"] and not over)
    assert checked > 10


@pytest.mark.parametrize("n", [1, 3, 10, 101, 5000])
def test_places_by_scalars(spark, n):
    """The permutation a number at a time: four rounds on halves in base m, walked on until the place is inside."""
    import struct

    import xxhash
    from pyspark.sql import functions as F

    from spanforge.llm.sharding import permute

    m = max(1, math.isqrt(n - 1) + 1)

    def half(k, r):
        h = 42
        for part in (struct.pack("<i", 17), struct.pack("<i", k), struct.pack("<q", r)):
            h = xxhash.xxh64(part, seed=h).intdigest()
        return (h - (1 << 64) if h >> 63 else h) % m

    def place(x):
        while True:
            left, right = divmod(x, m)
            for k in range(4):
                left, right = right, (left + half(k, right)) % m
            x = left * m + right
            if x < n:
                return x

    got = [r[1] for r in spark.range(n).select("id", permute(F.col("id"), n)).orderBy("id").collect()]
    assert got == [place(i) for i in range(n)]
