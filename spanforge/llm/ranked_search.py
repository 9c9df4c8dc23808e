"""Ranked lexical search: an inverted index in shards, its posting lists cut into blocks of variable length, searched exactly with block maxima (WAND)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.batches import lean, slices, text_slices
from spanforge.llm.storage import if_small, materialise
from spanforge.llm.words import LOWER, find_words, hash_words, text_bytes

#: Terms are runs of ASCII letters and digits and of all longer characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAPS = np.ones(256, bool)
GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Layout:
    shard_bytes: int = 16 << 20  # text of a shard, or a single document
    overhead: int = 8  # what one more block costs, in postings of the list's largest impact
    longest: int = 64  # postings of a block at most
    items: int = 500  # items that one task searches a shard for, about


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # shard, term, n; docs and impacts, a posting each; ends (places after a block) and tops (its largest impact), a block each
    members: DataFrame  # shard, doc (its number there), doc_id
    n_docs: int  # documents with a term
    layout: Layout


def block_ends(values: np.ndarray, first: np.ndarray, overhead: int, longest: int) -> np.ndarray:
    """Places after the blocks' last postings; list i is values[first[i] : first[i + 1]].

    Dynamic programming finds the cut of each list with the least bound error: the sum over blocks of length * maximum, less the list's sum,
    plus `overhead` times the list's maximum for each block. Lists of like lengths are solved together.
    """
    lens = np.diff(first)
    last = np.zeros(len(values) + 1, bool)
    last[first[1:][lens > 0]] = True
    for k in range(1, int(lens.max(initial=0)).bit_length() + 1):
        like = np.flatnonzero((lens > 1) & (lens <= 1 << k) & (lens > 1 << (k - 1)))
        step = max(1, (1 << 20) // ((1 << k) + 4 * min(longest, 1 << k)))
        for i in range(0, len(like), step):
            own = like[i : i + step]
            n, width, most = lens[own], int(lens[own].max()), min(longest, int(lens[own].max()))
            at = first[own] + np.minimum(np.arange(width)[:, None], n - 1)
            a = values[at]  # a list's last value again beyond its end
            price = overhead * a.max(axis=0)
            cost, back = np.zeros((width + 1, len(own)), "i8"), np.zeros((width + 1, len(own)), "i4")
            tops, sizes = np.zeros((most, len(own)), "i8"), np.arange(1, most + 1)[:, None]
            for j in range(1, width + 1):
                w = min(j, most)
                tops[1:w] = np.maximum(tops[: w - 1], a[j - 1])
                tops[0] = a[j - 1]
                total = cost[j - w : j][::-1] + tops[:w] * sizes[:w]
                back[j] = total.argmin(axis=0)
                cost[j] = total[back[j], np.arange(len(own))] + price
            left = n.copy()
            while (open_ := np.flatnonzero(left)).size:
                last[first[own[open_]] + left[open_]] = True
                left[open_] -= back[left[open_], open_] + 1
    return np.flatnonzero(last)


def _shard(texts: pa.Array, ids: pa.Array, n_docs: int, n_terms: int, layout: Layout) -> tuple[dict, pa.Array]:
    """One shard's posting lists, and its doc_ids in ascending order, nulls first; a document's number is its place there."""
    order = pc.sort_indices(ids, null_placement="at_start")
    ids, (data, at) = ids.take(order), text_bytes(texts.take(order))
    data = LOWER[data]
    words = find_words(data, at, GAPS)
    hashes, doc, n = hash_words(data, words.starts, words.ends), words.doc, np.diff(words.first)
    by = np.argsort(hashes, kind="stable")
    hashes, doc = hashes[by], doc[by]
    new_term = np.ones(len(by), bool)
    new_term[1:] = hashes[1:] != hashes[:-1]
    new = new_term.copy()
    new[1:] |= doc[1:] != doc[:-1]
    begins = np.flatnonzero(new)
    tf, doc = np.diff(np.append(begins, len(by))), doc[begins]
    m = 25 + (75 * n * n_docs) // max(1, n_terms)
    impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    first = np.append(np.flatnonzero(new_term[begins]), len(begins))
    ends = block_ends(impacts, first, layout.overhead, layout.longest)
    blocks = np.searchsorted(ends, first, side="right")
    tops = np.maximum.reduceat(impacts, np.concatenate([[0], ends[:-1]])) if len(ends) else impacts
    one = by[new_term]  # an occurrence of each term
    size = words.ends[one] - words.starts[one]
    places = np.concatenate([[0], np.cumsum(size)])
    letters = data[np.arange(places[-1]) + np.repeat(words.starts[one] - places[:-1], size)]
    term = pa.LargeStringArray.from_buffers(len(one), pa.py_buffer(places.astype("i8")), pa.py_buffer(np.ascontiguousarray(letters))).cast(pa.string())
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.array(values.astype("i4")))
    inner = ends - np.repeat(first[:-1], np.diff(blocks))
    cols = {"term": term, "n": pa.array(np.diff(first).astype("i4")), "docs": lists(first, doc), "impacts": lists(first, impacts), "ends": lists(blocks, inner), "tops": lists(blocks, tops)}
    return cols, ids


POSTINGS = "term string, n int, docs array<int>, impacts array<int>, ends array<int>, tops array<int>"


def terms_in(texts: Column) -> Column:
    """How many terms a text has; null has none."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        for column in batches:
            found = [np.diff(find_words(*text_bytes(part), GAPS).first) for part in text_slices(column)]
            yield pa.array(np.concatenate([np.zeros(0, "i8"), *found]).astype("i8"))

    return F.arrow_udf(count, "long")(texts)


def build_index(docs: DataFrame, layout: Layout = Layout(), doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents' terms, A-Z in lower case, written to the shared folder.

    A first pass counts documents with a term and terms; impacts, (10^9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L, follow from them. A shard is up to
    layout.shard_bytes of text as it lies in one partition, so building shuffles nothing and no list is longer than its shard. Terms of a shard are told apart by 64-bit
    hashes, terms of the whole table by their letters. Rows with a null or empty text are members without postings; each row counts, repeated or without doc_id.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = rows.select(terms_in(F.col("text")).alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = seen[0], seen[1]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean()
        number = TaskContext.get().partitionId() << 32

        def shard() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            cols, ids = _shard(whole.column("text").combine_chunks(), whole.column("doc_id").combine_chunks(), n_docs, n_terms, layout)
            kinds = {c: t for c, t in schema if c not in ("shard", "ids")}
            for i in range(0, len(cols["term"]), 1 << 15):
                part = [cols[c].slice(i, 1 << 15).cast(t) for c, t in kinds.items()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), number)), *part, pa.nulls(len(part[0]), schema[-1][1])], [c for c, _ in schema])
            yield pa.RecordBatch.from_arrays([pa.array([number]), *[pa.nulls(1, t) for t in kinds.values()], pa.ListArray.from_arrays([0, len(ids)], ids)], [c for c, _ in schema])

        ints = pa.list_(pa.int32())
        schema = [("shard", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("docs", ints), ("impacts", ints), ("ends", ints), ("tops", ints), ("ids", pa.list_(pa.int64()))]
        held, size = [], 0
        for b in slices(batches, most=layout.shard_bytes):
            more = b.column(b.schema.get_field_index("text")).nbytes
            if held and size + more > layout.shard_bytes:
                yield from shard()
                held, size, number = [], 0, number + 1
            held.append(b)
            size += more
        if held:
            yield from shard()

    stored = materialise(rows.mapInArrow(index, f"shard long, {POSTINGS}, ids array<long>"), "index")
    members = stored.filter("term is null").select("shard", F.posexplode("ids").alias("doc", "doc_id"))
    return Index(stored.filter("term is not null").drop("ids"), members, n_docs, layout)


def best(lists: list[tuple[np.ndarray, ...]], weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the k best documents of a shard, best first, equal ones by number. lists: (docs, impacts, ends, tops) of each term.

    Lists go from the heaviest bound to the lightest. The first ones with k documents give a threshold; behind the pivot, where the
    remaining lists' bounds together stay below it, no document that only they hold can enter. Documents before it are bounded by the maxima of
    the blocks that hold their place, and scored, from the best bound on, in growing portions, until the next bound is below the threshold.
    """
    bound = weights * np.array([t.max() for *_, t in lists])
    order = np.argsort(-bound, kind="stable")
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # of lists i, i + 1, ...
    lists, weights = [lists[i] for i in order], weights[order]

    def exact(docs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), "i8")
        for (own, impacts, _, _), w in zip(lists, weights, strict=True):
            at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            out += np.where(own[at] == docs, w * impacts[at].astype("i8"), 0)
        return out

    def bounds(docs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), "i8")
        for (own, _, ends, tops), w in zip(lists, weights, strict=True):
            at = np.searchsorted(own[ends - 1], docs)  # the first block that ends there or later
            inside = np.minimum(at, len(ends) - 1)
            starts = np.concatenate([[0], ends[:-1]])
            out += np.where((at < len(ends)) & (own[starts[inside]] <= docs), w * tops[inside].astype("i8"), 0)
        return out

    def kept(docs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.lexsort((docs, -scores))[:k]
        return docs[top], scores[top]

    some, i = np.zeros(0, "i4"), 0
    while len(some) < k and i < len(lists):
        some, i = np.union1d(some, lists[i][0]), i + 1
    docs, scores = kept(some, exact(some))
    least = scores[-1] if len(docs) == k else 0
    while i < len(lists) and rest[i] >= max(least, 1):
        i += 1
    more = np.setdiff1d(np.unique(np.concatenate([own for own, *_ in lists[:i]])), some)
    most = bounds(more)
    by, at, portion = np.argsort(-most, kind="stable"), 0, 4 * k
    while at < len(by) and most[by[at]] >= max(least, 1):
        part = more[by[at : at + portion]]
        docs, scores = kept(np.concatenate([docs, part]), np.concatenate([scores, exact(part)]))
        least = scores[-1] if len(docs) == k else 0
        at, portion = at + portion, 2 * portion
    return docs[scores > 0], scores[scores > 0]


def search(index: Index, queries: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents with the highest scores above 0, equal scores by ascending doc_id.

    A score sums, over the item's terms with repeats, floor(1000 ln((2 N + 2) / (2 df + 1))) * impact. Only lists of terms that are asked for leave their
    shard's files, dealt out by shard and group of items; each group finds its shard's k best, and these are merged by rank.
    Items without id, text or any known term have no rows; rows that repeat an item_id are one item with the terms of all. An empty index gives no rows.
    """
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = queries.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term"))
    asked = materialise(asked.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    items = max(1, asked.select("item_id").distinct().count())
    terms = asked.select("term").distinct()
    df = index.postings.select("term", "n").join(if_small(terms, of=asked), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1))) * F.col("times")
    group = F.pmod(F.xxhash64("item_id"), F.lit(-(-items // index.layout.items))).alias("group")
    entry = F.collect_list(F.struct(F.col("item_id").cast("long").alias("item"), weight.alias("weight")))
    wanted = materialise(asked.join(df, "term").groupBy("term", group).agg(entry.alias("of")), "wanted")
    wanted = wanted.select("term", "group", F.col("of.item").alias("item"), F.col("of.weight").alias("weight"))
    found = index.postings.join(if_small(wanted, 300_000), "term").select("shard", "group", "docs", "impacts", "ends", "tops", "item", "weight")

    def look(table: pa.Table) -> pa.Table:
        lean()
        table = table.combine_chunks()
        parts = []
        for c in ("docs", "impacts", "ends", "tops", "item", "weight"):
            column = table.column(c).chunk(0)
            parts.append((column.offsets.to_numpy(), column.values.to_numpy()))
        rows = np.repeat(np.arange(table.num_rows), np.diff(parts[4][0]))
        item, weights = (values[offsets[0] : offsets[-1]] for offsets, values in parts[4:])
        by = np.argsort(item, kind="stable")
        cuts = np.flatnonzero(np.diff(item[by])) + 1
        out = {"item_id": [], "doc": [], "score": []}
        for own in np.split(by, cuts):
            lists = [tuple(values[offsets[r] : offsets[r + 1]] for offsets, values in parts[:4]) for r in rows[own]]
            docs, scores = best(lists, weights[own], k)
            out["item_id"].append(np.full(len(docs), item[own[0]]))
            out["doc"].append(docs.astype("i4"))
            out["score"].append(scores)
        cols = {c: np.concatenate(v) for c, v in out.items()}
        return pa.table({"shard": np.full(len(cols["doc"]), table.column("shard")[0].as_py()), **cols})

    tops = found.groupBy("shard", "group").applyInArrow(look, "shard long, item_id long, doc int, score long")
    tops = materialise(tops, "tops")
    named = index.members.join(if_small(tops), ["shard", "doc"])
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "shard", "doc"))
    return named.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
