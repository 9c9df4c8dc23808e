"""Cases in which an operator once did less than the whole job."""

import shutil

import pytest


def test_component_joined_through_a_later_link(spark):
    """A1~A2 is found by the hubs, A2~B only afterwards: A1 follows A2 into B's component."""
    import pyarrow as pa

    from spanforge.llm.jaccard_join import Similar, similar_components, token_sets

    t = sorted((f"w{i}" for i in range(40)), key=lambda w: int(token_sets(pa.array([w]), 1)[0][0]))
    hub, b = t[1:4] + t[30:37], t[1:10] + t[20:21]
    a1, a2 = t[0:9] + t[21:22], t[0:10]
    texts = [(i, " ".join(x)) for i, x in enumerate((hub, b, a1, a2))]
    found = similar_components(spark.createDataFrame(texts, "doc_id long, text string"), Similar(words=1, percent=80))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {0: 0, 1: 1, 2: 1, 3: 1}


def test_backoff_query_counts_every_ngram(spark, tmp_path):
    """An n-gram that occurs once is scored by its own count."""
    import collections
    import math

    from spanforge.llm.queries import op8_stupid_backoff

    texts = ["a b c d e", "a b c x y", "a b q", "z", "", "only here once"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    grams = collections.Counter(tuple(w[i : i + n]) for w in map(str.split, texts) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(len(t.split()) for t in texts)
    for r in op8_stupid_backoff(spark, str(tmp_path)).collect():
        w, wanted = texts[r["doc_id"]].split(), 0.0
        for i in range(len(w)):
            g = tuple(w[max(0, i - 2) : i + 1])
            wanted += math.log10(grams[g] / (grams[g[:-1]] if len(g) > 1 else total))
        assert r["n_words"] == len(w) and abs(r["log_score"] - wanted) < 1e-4


def test_every_text_has_prefixes(spark):
    """Runs of spaces and line feeds, the space mark and long runs without spaces."""
    import sentencepiece

    from spanforge.llm.encode import tokenizer_path
    from spanforge.llm.token_counts import prefix_token_counts, within_budget

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = ["two  spaces " * 300, "def f(x):\n    return x\n\n" * 200, "\n\nafter feeds  " * 90, " \n " * 200, "▁marks ▁ and▁more" * 50, "日本語の文" * 400, "abcxyz0189/+" * 200, "x" * 3000, " " * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = prefix_token_counts(docs).cache()
    for r in counted.collect():
        text = texts[r["doc_id"]]
        assert r["ends"] == sorted(set(r["ends"])) and r["ends"][-1] == len(text) and r["counts"][-1] == r["n_tokens"]
        for e, n in list(zip(r["ends"], r["counts"], strict=True))[:: max(1, len(r["ends"]) // 40)]:
            assert len(model.encode(text[:e])) == n
    for r in within_budget(counted, 50).collect():
        assert len(model.encode(texts[r["doc_id"]][: r["kept_chars"]])) == r["kept_tokens"]
        assert 20 < r["kept_tokens"] <= 50 or not texts[r["doc_id"]].strip(" ")


def test_every_character_of_long_runs_has_a_prefix(spark):
    import sentencepiece

    from spanforge.llm.encode import tokenizer_path
    from spanforge.llm.token_counts import prefix_token_counts, within_budget

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = ["日本語の文" * 30, "abcxyz0189/+" * 20, "some words, then " + "internationalisation" * 9 + " and after", "\n" + "x" * 100, " " * 90]
    counted = prefix_token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    for r in counted.collect():
        text = texts[r["doc_id"]]
        assert r["counts"] == [len(model.encode(text[:e])) for e in r["ends"]]
        first = text.find("international") if "international" in text else 1  # where the long run's own characters begin
        last = text.index(" and") if "international" in text else len(text)
        assert set(range(first + 1, last + 1)) <= set(r["ends"])
    for r in within_budget(counted, 30).collect():
        text = texts[r["doc_id"]]
        fits = max(e for e in range(len(text) + 1) if len(model.encode(text[:e])) <= 30)
        assert r["kept_chars"] == fits


def test_prefix_query_returns_prefixes(spark):
    from spanforge.llm.queries import op6_prefix_token_counts

    for r in op6_prefix_token_counts(spark, "/root/testdata/sf0.001").collect():
        assert (r["n_tokens"], r["over_limit"]) == ((r["counts"] or [0])[-1], r["n_tokens"] > 4096) and len(r["ends"]) == len(r["counts"])


def test_rules_judge_every_language(spark):
    """Junk in a rare or null language is judged by references of all documents, and languages aren't cut off by number."""
    import random

    from spanforge.llm.quality_rules import Rules, judge, references

    rng = random.Random(1)
    vocabulary = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ge") for b in ("lor", "men", "tas", "nil", "rop", "sut")]
    good = lambda: " ".join(rng.choice(vocabulary) for _ in range(150)) + "."
    junk = lambda: " ".join(f"{rng.randrange(10**6)}$|{rng.randrange(10**6)}" for _ in range(150))
    rows = [(i, good(), "en") for i in range(40)] + [(100, junk(), None), (101, junk(), "rare"), (102, good(), None), (103, good(), "rare"), (104, junk(), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in judge(docs).collect()}
    assert [got[i]["kept"] for i in (100, 101, 102, 103, 104)] == [False, False, True, True, False]
    assert all(r["class_js"] is not None and r["word_js"] is not None for r in got.values())
    many = spark.createDataFrame([(i, "some words here", f"l{i}") for i in range(600)], "doc_id long, text string, lang string")
    assert len(references(many, Rules(reference_words=1))) == 601


def near_copies(n, words, seed, most=3):
    import random

    rng = random.Random(seed)
    texts = []
    for i in range(n):
        w = [f"b{k}" for k in range(words)]
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(words)] = f"x{i}"
        texts.append((i * 7 % n, " ".join(w)))
    return texts


def test_classes_are_told_apart_by_all_that_makes_them(spark, monkeypatch):
    """Sets whose first sums clash stay different classes, and no document gets two rows."""
    from test_llm_operators import brute_components

    from spanforge.llm import jaccard_join

    whole = jaccard_join._identity
    monkeypatch.setattr(jaccard_join, "_identity", lambda t: (whole(t)[0] & 3, whole(t)[1]))
    texts = near_copies(24, 20, 2) + [(100 + i, f"other text number {i} of some that are all alone {i * i}") for i in range(12)]
    found = jaccard_join.similar_components(spark.createDataFrame(texts, "doc_id long, text string"), jaccard_join.Similar(words=2, percent=80)).collect()
    assert sorted(map(tuple, found), key=str) == brute_components(texts, 2, 80)


def test_crowds_are_dealt_out(spark, monkeypatch):
    """150 near copies, of which four at most are compared in pairs."""
    from test_llm_operators import brute_components

    from spanforge.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "FEW", 4)
    levels, deal = [], jaccard_join._apart
    monkeypatch.setattr(jaccard_join, "_apart", lambda a, b: (levels.append(b), deal(a, b))[1])
    texts = near_copies(150, 60, 5)
    found = jaccard_join.similar_components(spark.createDataFrame(texts, "doc_id long, text string"), jaccard_join.Similar(words=3, percent=90, crowd=4)).collect()
    assert sorted(map(tuple, found), key=str) == brute_components(texts, 3, 90)
    assert "of_pivot" in levels and len({r["component_id"] for r in found}) > 1


def test_sets_short_of_rare_tokens_are_stored_once(spark, monkeypatch):
    """However often sets get more tokens, the folder never holds more of them than the sets have."""
    from pyspark.sql import functions as F

    from spanforge.llm import jaccard_join

    class Done(Exception):
        pass

    def done(*_):
        raise Done

    alive, most, store, gone = {}, [], jaccard_join.materialise, jaccard_join.drop

    def stored(df, name, **counts):
        out = store(df, name, **counts)
        lists = [c for c, kind in out.dtypes if kind == "array<bigint>" and name not in ("sets", "signed")]
        alive[out.stored_at] = sum(out.agg(F.sum(F.size(c))).first()[0] or 0 for c in lists)
        most.append(sum(alive.values()))
        return out

    monkeypatch.setattr(jaccard_join, "materialise", stored)
    monkeypatch.setattr(jaccard_join, "drop", lambda *tables: ([alive.pop(t.stored_at, 0) for t in tables], gone(*tables)))
    monkeypatch.setattr(jaccard_join, "_met", done)
    texts = [(i, " ".join([f"p{k}" for k in range(150)] + [f"o{i}_{k}" for k in range(20)])) for i in range(12)]
    with pytest.raises(Done):
        jaccard_join.similar_components(spark.createDataFrame(texts, "doc_id long, text string"), jaccard_join.Similar(words=1, percent=90, frequent=1))
    assert 12 * 29 < max(most) <= 12 * 170  # prefixes of 29, sets of 170


def test_crowds_are_dealt_out_by_rare_differences(spark, monkeypatch):
    """Copies with words of their own share few tokens that are rare among their differences, so the crowd is dealt out into few rows."""
    import random

    from spanforge.llm import jaccard_join

    class Done(Exception):
        pass

    rows, store = [], jaccard_join.materialise

    def stored(df, name, **counts):
        out = store(df, name, **counts)
        rows.extend([out.seen["rows"]] if name == "dealt" else [])
        if rows:
            raise Done
        return out

    monkeypatch.setattr(jaccard_join, "materialise", stored)
    monkeypatch.setattr(jaccard_join, "FEW", 4)
    rng, texts = random.Random(5), []
    for i in range(120):
        w = [f"w{k}" for k in range(60)]
        for at in rng.sample(range(60), rng.randint(1, 4)):
            w[at] = f"own{i}_{at}"
        texts.append((i, " ".join(w)))
    with pytest.raises(Done):
        jaccard_join.similar_components(spark.createDataFrame(texts, "doc_id long, text string"), jaccard_join.Similar(words=3, percent=80, crowd=4))
    assert 0 < rows[0] <= 5 * 120


def test_short_items_are_found_whole(spark):
    """Items of fewer words than a mask has, and of fewer than may differ, are found where all their words stand in a row; the shortest condemn no document."""
    from spanforge.llm.decontaminate import find_overlaps, remove_contaminated

    items = [(i, " ".join(f"t{k}" for k in range(i))) for i in range(1, 9)] + [(20, "t1 t2"), (21, "none here"), (22, "")]
    docs = [(n, "x " + " ".join(f"t{k}" for k in range(n)) + " y") for n in range(10)] + [(50, "T0, T1 x t2 t3 t4 t5"), (51, "t0"), (52, "")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["doc_word"], r["matched_words"]) for r in find_overlaps(a, b).collect()}
    wanted = {(n, i): (1, i) for n in range(10) for i in range(1, 9) if n >= i} | {(n, 20): (2, 2) for n in range(3, 10)}
    wanted |= {(7, 8): (1, 7), (50, 1): (0, 1), (50, 2): (0, 2), (51, 1): (0, 1)}  # one of eight words may differ
    assert got == wanted
    assert sorted(r["doc_id"] for r in remove_contaminated(a, b).collect()) == [0, 1, 2, 3, 4, 50, 51, 52]


def test_references_are_counted_once(spark):
    """Texts go to Python once for a language's words, whatever is made of them."""
    from spanforge.llm import quality_rules

    docs = spark.createDataFrame([(i, f"some words of text {i}", "en") for i in range(50)], "doc_id long, text string, lang string")
    calls = spark.sparkContext.accumulator(0)
    find = quality_rules.find_words

    def counted(data, at):
        calls.add(1)
        return find(data, at)

    quality_rules.find_words = counted
    try:
        quality_rules.reference_table(docs.coalesce(1)).collect()
    finally:
        quality_rules.find_words = find
    assert calls.value == 1


def test_rows_by_shard(spark):
    """Whole rows with the places that are computed for them; an empty table gives none."""
    from spanforge.llm.sharding import assign_shards, sharded_rows

    docs = spark.createDataFrame([(i, f"text {i}", i * i) for i in range(50)], "doc_id long, text string, other long")
    where = {r["doc_id"]: (r["shard"], r["slot"]) for r in assign_shards(docs, 7).collect()}
    got = sharded_rows(docs, 7).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == where and all(r["other"] == r["doc_id"] ** 2 for r in got) and len(got) == 50
    assert sharded_rows(docs.filter("doc_id > 99"), 7).count() == 0


def test_backoff_in_many_parts(spark):
    """Sums of a document come from many partitions and buckets, and are the same as from one."""
    import random

    from spanforge.llm.lm_score import Model, backoff_scores

    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 40)))) for i in range(80)], "doc_id long, text string")
    one, many = ({r["doc_id"]: r["log_score"] for r in backoff_scores(docs, m).collect()} for m in (Model(), Model(rows=60, turns=3, sample=1, salt=2)))
    assert len(one) == 80 and all(abs(one[i] - many[i]) < 1e-9 for i in one)


def test_encoders_give_the_library_s_ids_by_every_way():
    """Single words, words with signs and digits, capitals, accents, and characters of which bytes have signs of their own."""
    from array import array

    from spanforge.llm.encode import byte_encoder, tokenizer_path, word_encoder

    texts = ["plain words only", "it's don't x_y a1b2 Ünïcode ÿ­ß çà", "\nfeed after\nfeed", "~tilde |bar ¡¿ ¬® – €5", "CAPS and Straße naïve", "", " ", "ª no º"]
    for encoder, name in ((byte_encoder, "byte_bpe_50k.json"), (word_encoder, "word_bpe_49k.json")):
        e = encoder(tokenizer_path(name))
        e.forget()
        assert e.encode(texts) == [array("I", x.ids).tobytes() for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _listed(spark):
    """Files of listings that the driver holds."""
    import gc
    import re
    import subprocess

    gc.collect()
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    table = subprocess.run(["jcmd", str(pid), "GC.class_histogram"], capture_output=True, text=True, check=True).stdout
    return sum(int(n) for n in re.findall(r"\d+:\s+(\d+)\s+\d+\s+org\.apache\.hadoop\.fs\.\S*FileStatus\b", table))


def test_listings_of_dropped_tables_go(spark):
    """Spark's cache kept the list of every materialised table's files on the driver, 60 of 8 files each here."""
    from spanforge.llm.storage import LISTINGS, drop, materialise

    if not shutil.which("jcmd"):
        pytest.skip("no jcmd")
    before, limit = _listed(spark), spark.conf.get(LISTINGS)
    for _ in range(60):
        drop(table := materialise(spark.range(0, 80, 1, 8), "listed"))
        assert table.seen["rows"] == 80
    del table
    after = _listed(spark)
    assert after < before + 240 and spark.conf.get(LISTINGS) == limit


def test_packing_search_holds_little():
    """The views of a search over 3,500 lengths took 2 MB each, as every length had its sums for itself, and the driver's Python kept them."""
    import tracemalloc
    from collections import Counter

    import numpy as np

    from spanforge.llm.binpack import _of_bins, _View, pack

    rng = np.random.default_rng(7)
    counts = Counter(np.clip(rng.lognormal(6, 1, 20_000).astype(int) + 1, 1, 4096).tolist())
    view = _View(counts, 4096)
    sums, mask = 1, (1 << 4097) - 1
    for i in range(len(view.lengths) - 1, -1, -1):
        n = view.lengths[i]
        for _ in range(min(counts[n], 4096 // n)):
            sums |= sums << n & mask
        assert view.reach[i] == sums
    assert len({id(x) for x in view.reach}) < len(view.reach) // 4
    tracemalloc.start()
    found = pack(counts, 4096)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert _of_bins(found) == counts and most < 40 << 20
