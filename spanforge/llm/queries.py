"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.decontaminate import find_overlaps

    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.warc import round_trip

    back = round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_combination_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.jaccard_join import Similar, similar_components

    return similar_components(table(spark, sf_dir, "documents"), Similar(words=3, percent=90))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.sharding import assign_shards

    found = assign_shards(table(spark, sf_dir, "documents"), shards=40)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.planes import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.token_counts import prefix_token_counts

    counted = prefix_token_counts(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op7_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.lm_score import backoff_scores

    found = backoff_scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_score", 5).alias("mean_score"))


def op9_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.classifier import fit, score

    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op11_viterbi_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return identify(docs, fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.ranked_search import build_index, search

    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spaced_seed_overlaps": op1_spaced_seed_overlaps,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_combination_prefix_join": op3_combination_prefix_join,
    "op4_feistel_shards": op4_feistel_shards,
    "op5_token_planes": op5_token_planes,
    "op6_prefix_token_counts": op6_prefix_token_counts,
    "op8_stupid_backoff": op8_stupid_backoff,
    "op9_ftrl_quality": op9_ftrl_quality,
    "op10_divergence_rules": op10_divergence_rules,
    "op7_bin_completion_packing": op7_bin_completion_packing,
    "op11_viterbi_languages": op11_viterbi_languages,
    "op12_block_max_search": op12_block_max_search,
    "op13_filter_audit": op13_filter_audit,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    # all pairs that share a shingle, and what is reachable by links
    "op3_combination_prefix_join": f"""
        with recursive d as (select row_number() over () as r, doc_id, {_SPLIT.format(_LOWER)} as ws from documents),
        sh as (select distinct r, array_to_string(case when len(ws) < 3 then ws else ws[i : i + 2] end, ' ') as s from (select r, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) as i from d where len(ws) > 0)),
        n as (select r, count(*) as n from sh group by r),
        pairs as (select a.r as a, b.r as b, count(*) as same from sh a join sh b using (s) where a.r <> b.r group by a.r, b.r),
        link as (select a, b from pairs join n x on x.r = a join n y on y.r = b where 100 * same >= 90 * (x.n + y.n - same)),
        reach as (select r as a, r as b from d union select reach.a, link.b from reach join link on reach.b = link.a)
        select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(o.doc_id) as component_id
        from d join reach on reach.a = d.r join d o on o.r = reach.b left join n on n.r = d.r group by d.r, d.doc_id""",
    # each word's n-gram of at most three words, and its context
    "op8_stupid_backoff": f"""
        with d as (select row_number() over () as r, doc_id, {_SPLIT.format(_LOWER)} as ws from documents),
        t as (select r, unnest(range(1, len(ws) + 1)) as i, ws from d),
        g as (select r, i, ws[i] as g1, case when i > 1 then ws[i - 1] || ' ' || ws[i] end as g2, case when i > 2 then ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] end as g3 from t),
        c1 as (select g1, count(*) as c from g group by g1), c2 as (select g2, count(*) as c from g where g2 is not null group by g2), c3 as (select g3, count(*) as c from g where g3 is not null group by g3),
        n as (select count(*) as n from g),
        p as (select g.r, case when i > 2 then c3.c else coalesce(c2.c, c1.c) end as c, g.i, c1.c as a1, c2.c as a2, lag(c1.c) over (partition by g.r order by g.i) as b1, lag(c2.c) over (partition by g.r order by g.i) as b2
            from g join c1 using (g1) left join c2 on c2.g2 = g.g2 left join c3 on c3.g3 = g.g3),
        s as (select r, sum(log10(c::double / case when i = 1 then (select n from n) when i = 2 then b1 else b2 end)) as s from p group by r)
        select doc_id, cast(len(ws) as bigint) as n_words, round(coalesce(s, 0), 4) as log_score, case when len(ws) > 0 then round(s / len(ws), 5) end as mean_score from d left join s using (r)""",
    # every pair of equal words lies on a diagonal; windows of it are counted
    "op1_spaced_seed_overlaps": """
        with iw as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from benchmark where item_id is not null),
        it as (select item_id, len(ws) as m, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as j from iw),
        dw as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from documents where doc_id is not null),
        dt as (select doc_id, len(ws) as k, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from dw),
        diag as (select doc_id, item_id, i - j as d, k, m, list(j) as js from dt join it using (w)
            group by doc_id, item_id, i - j, k, m having count(*) >= case when m < 8 then m else least(13, m) - 2 end),
        best as (select *, list_max(list_transform(range(0, m - least(13, m) + 1), lambda s:
            case when d + s >= 0 and d + s + least(13, m) <= k
            then len(list_filter(js, lambda x: x >= s and x < s + least(13, m))) else 0 end)) as agree from diag),
        good as (select * from best where agree >= case when m < 8 then m when m < 13 then m - 1 else 11 end)
        select doc_id, item_id, cast(min(greatest(d, 0)) as int) as doc_word, cast(max(m) as int) as item_words,
            cast(max(agree) as int) as matched_words
        from good group by doc_id, item_id""",
    # base 32: five hexadecimal digits of the digest are four letters
    "op2_warc_round_trip": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, strlen(html) as payload_bytes, sha1(html) as hex, min(page_id) over (partition by html) as first_id from p)
        select page_id, cast(payload_bytes as bigint) as payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 +
                ((('0x' || substr(hex, cast(1 + 5 * (i // 4) as int), 5))::int >> cast(15 - 5 * (i % 4) as int)) & 31) as int), 1)), '') as payload_digest,
            case when page_id = first_id then 'response' else 'revisit' end as record_type,
            case when page_id <> first_id then first_id end as refers_to
        from d""",
    # every document's score for every item
    "op12_block_max_search": r"""
        with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
        a as (select count(*) filter (len(ts) > 0) as n, sum(len(ts))::bigint as l from d),
        p as (select r, term, count(*) as tf from (select r, unnest(ts) as term from d) group by r, term),
        q as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from benchmark where item_id is not null) group by item_id, term),
        w as (select term, floor(1000 * ln((2 * n + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from p group by term), a),
        m as (select r, doc_id, 25 + (75 * len(ts) * n) // l as m from d, a where len(ts) > 0),
        s as (select item_id, r, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score from q join w using (term) join p using (term) join m using (r) group by item_id, r, doc_id)
        select item_id, cast(rank as int) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id, r) as rank from s where score > 0) where rank <= 10""",
    # failures by document, then every order over the counts of equal sets of failures
    "op13_filter_audit": f"""
        with w as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part, {_SPLIT.format("coalesce(text, '')")} as ws from documents),
        l as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id),
        f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
            cast(len(ws) < 200 as int) + 2 * cast(100 * len(list_distinct(ws)) < 50 * len(ws) as int) + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) as int)
            + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(coalesce(w.doc_id > min(w.doc_id) over (partition by t), false) as int) as mask from w left join l on l.doc_id = w.doc_id),
        c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, mask),
        x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit),
        o as (select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from x a, x b, x c, x d, x e
            where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        s as (select filter_order, step, bits[step] as own, coalesce(list_sum(bits[: step - 1]), 0)::int as before from (select *, unnest([1, 2, 3, 4, 5]) as step from o)),
        r as (select part, filter_order, step, own, sum(n) filter (mask & (before | own) = 0) as kept, sum(n) filter (mask & before = 0 and mask & own > 0) as removed,
            sum(n) filter (mask & before > 0 and mask & own > 0) as redundant, sum(n) filter (mask = own) as unique_fails,
            sum(good) filter (mask & before = 0 and mask & own > 0) as good_lost, sum(toxic) filter (mask & before = 0 and mask & own > 0) as toxic_lost from c, s group by part, filter_order, step, own)
        select part, filter_order, cast(step as int) as step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant,
            cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
            cast(coalesce(sum(removed) over (partition by part, own), 0) as bigint) as shapley from r""",
}
