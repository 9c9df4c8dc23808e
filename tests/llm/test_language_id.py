"""Language identification: the path against a search over all paths, planted mixed texts, odd rows, held-out accuracy."""

import itertools

import numpy as np

EN = "the cat sat on the mat while it was raining and nobody in the house had thought of closing the window that night".split()
DE = "der hund schläft unter dem tisch während draußen schnee fällt und niemand möchte heute noch nach draußen gehen".split()
RU = "кошка сидит на окне и смотрит как падает снег а в доме тепло и тихо горит свет".split()
BG = "котката стои на прозореца и гледа как вали сняг а в къщата е топло и свети лампа".split()
ZH = "猫坐在窗边看着外面的雪慢慢落下屋子里很暖和灯亮着"


def samples(words, n, rng):
    return [" ".join(rng.choice(words, int(rng.integers(5, 60)))) + "." for _ in range(n)]


def test_path_against_all_paths():
    from spanforge.llm.language_id import best_path

    rng = np.random.default_rng(4)
    sizes = [0, 1, 2, 5, 6, 0, 7, 6, 3, 7, 7]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.integers(-6, 7, (first[-1], 3)).astype("f4")
    scores[first[6] : first[7], 1] += 9  # one that stays
    path = best_path(scores, first, 4.0)
    worth = lambda p, own: sum(own[i, x] for i, x in enumerate(p)) - 4.0 * sum(a != b for a, b in itertools.pairwise(p))
    for i, n in enumerate(sizes):
        own = scores[first[i] : first[i + 1]]
        assert worth(path[first[i] : first[i + 1]], own) == max((worth(p, own) for p in itertools.product(range(3), repeat=n)), default=0)


def test_languages(spark):
    from spanforge.llm.language_id import Settings, fit, identify

    rng = np.random.default_rng(7)
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ws in (("en", EN), ("de", DE), ("ru", RU), ("bg", BG), ("zh", list(ZH))) for t in samples(ws, 60, rng))]
    docs = spark.createDataFrame([(*r, "s", 0.5) for r in rows] + [(None, "x y z", "qq", "s", 0.5), (900, None, "qq", "s", 0.5), (901, "a b", None, "s", 0.5), (0, "other text", "en", "s", 0.5)], "doc_id long, text string, lang string, source string, score double")
    model = fit(docs)
    assert model.langs == ["bg", "de", "en", "ru", "zh"] and fit(docs, Settings(rows=5, cells=1 << 12)).bits == 9
    mixed = " ".join(EN) + ". " + " ".join(DE) + " — " + " ".join(RU)
    cases = [
        (1, " ".join(EN).upper(), "en"), (2, " ".join(DE), "de"), (3, " ".join(RU), "ru"), (4, " ".join(BG), "bg"), (5, ZH * 3, "zh"), (6, mixed, None), (7, None, "und"), (8, "", "und"), (9, "12 34 — … 🙂 ½", "und"),
        (10, "ª", "bg"), (11, " ".join(DE * 4000), "de"), (11, " ".join(EN), "en"), (None, " ".join(RU), "ru"), (12, "ελληνικά", None), (13, "x" * 100_000, None), (14, "́١", "und"),
    ]
    found = identify(spark.createDataFrame([(i, t, "x", [1]) for i, t, _ in cases], "doc_id long, text string, lang_pred string, spans array<int>"), model).collect()
    texts = {t: want for _, t, want in cases}
    got = {t: r for (_, t, _), r in zip(cases, found, strict=True)}
    for t, want in texts.items():
        r = got[t]
        assert want is None or r["lang_pred"] == want, (t and t[:20], r["lang_pred"])
        assert 0 <= r["score"] <= 1 and (r["score"] == 0) == (r["lang_pred"] == "und") and (r["lang_pred"] == "und" or r["lang_pred"] in model.langs)
    assert [(s["lang"], mixed[s["start"] : s["end"]]) for s in got[mixed]["spans"]] == [("en", " ".join(EN)), ("de", " ".join(DE)), ("ru", " ".join(RU))]
    assert got[mixed]["lang_pred"] == max((("en", EN), ("de", DE), ("ru", RU)), key=lambda x: len("".join(x[1])))[0]
    empty = fit(docs.filter("doc_id > 9999"))
    assert [tuple(r) for r in identify(docs.limit(1), empty).collect()] == [(0, "und", 0.0, [])] and identify(docs.filter("doc_id > 9999"), model).count() == 0
    assert sorted(r["lang_pred"] for r in identify(docs, model).filter("lang_pred in ('und', 'ru')").collect()) == ["ru"] * 60 + ["und"]


def test_held_out_documents(spark):
    """Documents that nothing was learnt from."""
    from spanforge.llm.queries import op11_viterbi_languages

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = op11_viterbi_languages(spark, d).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) > 0.99 * len(held)
