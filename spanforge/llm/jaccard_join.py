"""Exact Jaccard join of documents' word n-grams with prefixes of token combinations.

A document's tokens are the hashes of its distinct n-grams, in one order for all:
rare tokens by hash, then frequent ones by hash. A set of n tokens that is similar enough to another
misses at most e = floor((1 - threshold) * n) of its tokens there, and the two differ in at most d tokens.

Single tokens for rare ones: a set with more than e rare tokens is indexed by its e + 1 smallest, any other by all
of its r. Combinations for frequent ones: two sets that share no rare token differ in at most d - r
frequent ones, of which at most e - r are the set's own. So the prefix is extended to its e + d - 2 * r + 2 smallest
frequent tokens and indexed by the pairs of neighbours in it: a token that only this set has
parts two such pairs, one that only the other has parts one, and one pair at least is left. The first pair of neighbours
that both sets have is in both prefixes. The number of pairs grows with n, not with its square, and boilerplate
that many documents mix differently doesn't bring them together.

Sets that meet are first compared with the smallest of those that meet there. Where that
leaves several components, few sets are compared in pairs, and crowds by what sets them apart (see `_crowds`).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.batches import lean, slices
from spanforge.llm.components import connect
from spanforge.llm.storage import drop, if_small, materialise
from spanforge.llm.words import _U, LOWER, find_words, hash_words, mix, text_bytes, windows

NO_ID = (1 << 63) - 1
FEW, TURNS, LEVELS = 64, 8, 20  # see `_crowds`


@dataclass(frozen=True)
class Similar:
    words: int = 5  # in an n-gram
    percent: int = 80  # least similarity: 100 * intersection >= percent * union
    frequent: int = 8  # prefixes that hold a token beyond which it is frequent
    crowd: int = 8  # sets in one place beyond which they aren't compared in pairs

    def misses(self, n):
        """Most tokens that a set of n has and one similar enough hasn't."""
        return n * (100 - self.percent) // 100

    def differ(self, n):
        """Most tokens in which a set of n and one similar enough differ."""
        return (100 - self.percent) * (n + n * 100 // self.percent) // (100 + self.percent)


def token_sets(column, n: int) -> list[np.ndarray]:
    """Each document's distinct n-gram hashes in ascending order; of a text with fewer words, the one of all its words."""
    data, at = text_bytes(column)
    words = find_words(data, at)
    hashes = hash_words(LOWER[data], words.starts, words.ends)
    found, where = windows(hashes, words.first, n)
    ends = np.searchsorted(where, words.first)
    found = found.view("i8")
    out = []
    for d in range(len(at) - 1):
        a, b = words.first[d], words.first[d + 1]
        if 0 < b - a < n:
            out.append(windows(hashes[a:b], np.array([0, b - a]), int(b - a))[0].view("i8"))
        else:
            out.append(np.unique(found[ends[d] : ends[d + 1]]))
    return out


def _identity(tokens: np.ndarray) -> tuple[int, int]:
    """Two sums that equal sets share."""
    t = tokens.view("u8")
    return int(t.sum(dtype="u8").view("i8")), int(mix(t ^ _U(0x5851F42D4C957F2D)).sum(dtype="u8").view("i8"))


def _longs(lists: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype("i4")
    flat = np.concatenate(lists) if lists else np.zeros(0, "i8")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype("i8", copy=False)))


def _shingled(rows: DataFrame, s: Similar) -> DataFrame:
    """(doc_id, h, n, c, c2, tokens): hash of the text, set size, identity and the tokens that a prefix is likely to need."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in slices(batches):
            sets = token_sets(b.column(1), s.words)
            cols = [pa.array([len(t) for t in sets], pa.int64())]
            cols += [pa.array(x, pa.int64()) for x in zip(*map(_identity, sets), strict=True)]
            sets = [t[: s.misses(len(t)) * 5 // 4 + 8] for t in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols, _longs(sets)], ["doc_id", "h", "n", "c", "c2", "tokens"])

    return rows.mapInArrow(cut, "doc_id long, h long, n long, c long, c2 long, tokens array<long>")


def signatures(n: int, tokens: np.ndarray, frequent: np.ndarray, s: Similar) -> tuple[np.ndarray, np.ndarray, int]:
    """The rare tokens and the hashes of frequent ones that a set is indexed by, and how many rare ones it has if it has the latter.

    tokens: ascending, all of them unless e + 1 of them are rare; frequent: those that are. Two similar sets that share no
    rare token share one of the hashes."""
    rare = tokens[~np.isin(tokens, frequent)] if len(frequent) else tokens
    e, r = s.misses(n), len(rare)
    if r > e:
        return rare[: e + 1], frequent[:0], 0
    d = s.differ(n)
    common = np.sort(frequent)
    near = common[: e + d - 2 * r + 2].view("u8")
    out = [mix(mix(near[:-1] + _U(2)) + near[1:]).view("i8")]
    if n + r < e + d + 2:  # low thresholds: no pair of neighbours need be left
        out.append(common[: e + 1 - r])
    return rare, np.concatenate(out), r


def _many(tokens: DataFrame, s: Similar) -> DataFrame:
    """(t): tokens in more than s.frequent rows."""
    return tokens.groupBy("t").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > s.frequent).select("t")


def _signed(docs: DataFrame, classes: DataFrame, s: Similar) -> DataFrame:
    """(id, rare, pairs, own) of each class, see `signatures`.

    Frequent is a token that more than s.frequent prefixes hold, or tokens added for sets short of rare ones; those
    sets get as many tokens more as they have, until none is short. Any such rule is right, as it's one for all sets. What
    is added, and what is frequent in it, is stored once, so that the folder holds no set twice, however many sets are short.
    """
    first = classes.select("id", F.explode("tokens").alias("t"))
    known = materialise(_many(first, s), "frequent")
    parts, added, every = [materialise(first.join(if_small(known), "t").select("id", "t"), "held")], [], first
    union = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    while True:
        marks = union(parts).groupBy("id").agg(F.count(F.lit(1)).alias("marked"))
        now = classes.join(marks, "id").select("id", "c", "rep", "h", "n", "marked", F.size("tokens").alias("has"))
        if added:
            more = union(added).groupBy("id").agg(F.sum(F.size("fresh")).alias("more"))
            now = now.join(more, "id", "left").withColumn("has", F.expr("int(has + coalesce(more, 0))"))
        e = F.expr(f"n * {100 - s.percent} div 100")
        short = materialise(now.filter((F.col("has") - F.col("marked") <= e) & (F.col("has") < F.col("n"))).select("id", "c", "rep", "h", "has"), "short")
        if not short.seen["rows"]:
            break
        added.append(materialise(whole_sets(docs, short, s, "has").select("id", F.slice("tokens", F.col("has") + 1, F.col("has")).alias("fresh")), "added"))
        drop(short)
        fresh = added[-1].select("id", F.explode("fresh").alias("t"))
        every = every.unionByName(fresh)
        parts.append(materialise(fresh.join(if_small(known), "t").select("id", "t"), "held"))
        more = materialise(_many(fresh, s).join(known, "t", "left_anti"), "frequent")
        parts.append(materialise(every.join(if_small(more), "t").select("id", "t"), "held"))
        last, known = known, materialise(known.unionByName(more), "frequent")
        drop(last, more)
    rows = classes.join(union(parts).groupBy("id").agg(F.collect_list("t").alias("frequent")), "id", "left")
    if added:  # by size, as each part begins beyond the one before
        rows = rows.join(union(added).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("fresh"))).alias("fresh")), "id", "left")
        rows = rows.withColumn("tokens", F.when(F.col("fresh").isNull(), F.col("tokens")).otherwise(F.concat("tokens", "fresh")))
    rows = rows.select("id", "n", "tokens", "frequent")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            out = []
            for n, t, f in zip(b.column("n").to_pylist(), b.column("tokens"), b.column("frequent"), strict=True):
                out.append(signatures(n, t.values.to_numpy(), f.values.to_numpy() if f.is_valid else np.zeros(0, "i8"), s))
            lists = [_longs([x[i] for x in out]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *lists, pa.array([x[2] for x in out], pa.int64())], ["id", "rare", "pairs", "own"])

    signed = materialise(rows.mapInArrow(sign, "id long, rare array<long>, pairs array<long>, own long"), "signed")
    drop(short, known, *parts, *added)
    return signed


def whole_sets(docs: DataFrame, wanted: DataFrame, s: Similar, *more: str) -> DataFrame:
    """(id, tokens, more) of the classes in wanted (id, c, rep, h, more), from the texts of the documents that stand for them."""
    ids = wanted.select("rep", "h", F.col("c").alias("want"), "id", *more)
    rows = docs.withColumn("rep", F.coalesce("doc_id", F.lit(NO_ID))).join(if_small(ids), ["rep", "h"]).select("doc_id", "text", "want", "id", *more)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in slices(batches):
            sets, want = token_sets(b.column(1), s.words), b.column(2).to_pylist()
            kept = [i for i, (c, t) in enumerate(zip(want, sets, strict=True)) if len(t) and _identity(t)[0] == c]
            own = b.select(["id", *more]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), _longs([sets[i] for i in kept]), *own.columns[1:]], ["id", "tokens", *more])

    kinds = dict(wanted.dtypes)
    found = rows.mapInArrow(cut, "id long, tokens array<long>" + "".join(f", {c} {kinds[c]}" for c in more))
    return found.dropDuplicates(["id"])


def _apart(a: str, b: str | Column) -> Column:
    """The tokens that only one of two arrays has."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def _of(classes: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """(id, columns) of the classes with these ids."""
    few = materialise(ids.distinct(), "ids")
    found = materialise(classes.select("id", *columns).join(if_small(few), "id"), "wanted")
    drop(few)
    return found


def _pair_up(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """(a, b) with the columns of both, as a_... and b_..."""
    end = lambda x: sets.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])
    return pairs.join(end("a"), "a").join(end("b"), "b")


def _links(docs: DataFrame, pairs: DataFrame, classes: DataFrame, s: Similar) -> DataFrame:
    """Of pairs (a, b) those whose sets are similar enough.

    First by the lists of smallest tokens: two lists show all tokens up to where the first of them ends, and similar sets can't differ in
    more of them than in all. Whole sets are made, once each, for what is left.
    """
    pairs = materialise(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    lists = _of(classes, ends, "n", "tokens")
    known = lists.withColumn("upto", F.when(F.size("tokens") < F.col("n"), F.element_at("tokens", -1)).otherwise(NO_ID))
    both = _pair_up(pairs, known, "n", "tokens", "upto").withColumn("upto", F.least("a_upto", "b_upto"))
    seen = lambda x: F.filter(f"{x}_tokens", lambda t: t <= F.col("upto"))
    both = both.select("a", "b", "a_n", "b_n", seen("a").alias("x"), seen("b").alias("y"))
    differing = F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))
    likely = materialise(both.filter(_alike(differing, F.col("a_n"), F.col("b_n"), s)).select("a", "b"), "likely")
    wanted = _of(classes, likely.select(F.col("a").alias("id")).union(likely.select("b")), "c", "rep", "h")
    sets = materialise(whole_sets(docs, wanted, s), "sets")
    whole = _pair_up(likely, sets, "tokens")
    same = F.size(F.array_intersect("a_tokens", "b_tokens"))
    links = materialise(whole.filter(100 * same >= s.percent * (F.size("a_tokens") + F.size("b_tokens") - same)).select("a", "b"), "links")
    drop(pairs, lists, likely, wanted, sets)
    return links


def _alike(differing: Column, n: Column, m: Column, s: Similar) -> Column:
    """Whether sets of n and m tokens that differ in `differing` tokens are similar enough."""
    return (100 + s.percent) * differing <= (100 - s.percent) * (n + m)


def _possible(n: str, own: str, m: str, other: str, s: Similar) -> Column:
    """Whether sets of n and m tokens can be similar enough, if `own` and `other` of them are not shared."""
    most = F.least(F.col(n) - F.col(own), F.col(m) - F.col(other))
    return (100 * F.least(n, m) >= s.percent * F.greatest(n, m)) & (100 * most >= s.percent * (most + F.col(own) + F.col(other)))


def _met(signed: DataFrame, s: Similar) -> DataFrame:
    """(sig, id, own, hub, k): classes that meet, the smallest id there and how many meet.

    Few sets hold a rare token, so a window may gather them; how many share a pair of frequent ones isn't
    bounded, so these are counted before they are shuffled.
    """
    rare = signed.select(F.explode("rare").alias("sig"), "id").withColumn("own", F.lit(0).cast("long"))
    there = Window.partitionBy("sig")
    rare = rare.withColumns({"hub": F.min("id").over(there), "k": F.count(F.lit(1)).over(there)}).filter("k > 1")
    pairs = materialise(signed.filter(F.size("pairs") > 0).select(F.explode("pairs").alias("sig"), "id", "own"), "pairs")
    hubs = materialise(pairs.groupBy("sig").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("k")).filter("k > 1"), "hubs")
    columns = ["sig", "id", "own", "hub", "k"]
    met = materialise(rare.select(columns).unionByName(pairs.join(hubs, "sig").select(columns)), "met")
    drop(pairs, hubs)
    return met


def similar_components(docs: DataFrame, s: Similar = Similar(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Words are runs of anything but ASCII white space, A-Z in lower case; a set's tokens are 64-bit hashes.
    Equal sets are one class, of which only one text goes on. Classes that meet are compared with the
    one of smallest id there first; where that doesn't bring all of them together, the
    classes of different components are compared. So no link between components is
    lost, though not all pairs are made. component_id: the smallest doc_id reachable. A null or empty
    text, or one of white space, has an empty set and is linked with nothing. A row
    without doc_id takes part; its component_id is null only if no row of its component has one. Rows that repeat a doc_id
    are compared each by its own text. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    sets = materialise(_shingled(rows, s), "sets")
    classes = sets.filter("n > 0").groupBy("c", "c2", "n").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)), "h")).alias("rep"), F.first("tokens").alias("tokens"))
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "c", "c2", "n", F.col("rep.col1").alias("rep"), F.col("rep.h").alias("h"), "tokens")
    classes = materialise(classes, "classes")
    of_docs = materialise(sets.select("doc_id", "n", "c", "c2"), "of_docs")
    drop(sets)
    signed = _signed(rows, classes, s)
    met = _met(signed, s)
    drop(signed)
    sizes = classes.select("id", "n")
    named = met.join(if_small(sizes, of=classes), "id").join(if_small(sizes, of=classes).select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.lit(0).alias("hub_own")), "hub")
    star = named.filter((F.col("id") != F.col("hub")) & _possible("n", "own", "hub_n", "hub_own", s))
    links = _links(rows, star.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), classes, s)
    links = _rest(rows, met, classes, links, s)
    labels = connect(_ends(links, classes), links)
    near = labels.select("id", F.col("label.rep").alias("found"))
    own = materialise(classes.select("id", "c", "c2", "n", "rep").join(if_small(near, of=labels), "id", "left").select("c", "c2", "n", F.coalesce("found", "rep").alias("component")), "own")
    out = of_docs.join(own, ["c", "c2", "n"], "left")
    drop(met, links, classes, labels)
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("component") != NO_ID, F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _ends(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, label) of the classes in links, each its own label."""
    ends = links.select(F.col("a").alias("id")).union(links.select("b"))
    found = classes.select("id", "rep").join(if_small(materialise(ends.distinct(), "ends")), "id")
    return materialise(found.select("id", F.struct("rep", "id").alias("label")), "nodes")


def _rest(docs: DataFrame, met: DataFrame, classes: DataFrame, links: DataFrame, s: Similar) -> DataFrame:
    """links and those between classes that meet, but aren't in one component by links."""
    labels = connect(_ends(links, classes), links)
    known = if_small(labels.select("id", F.col("label.id").alias("known")), of=labels)
    named = met.join(if_small(classes.select("id", "n"), of=classes), "id").join(known, "id", "left")
    named = materialise(named.select("sig", "own", "id", "n", "hub", "k", F.coalesce("known", "id").alias("label")), "named")
    mixed = named.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("sig")
    left = materialise(named.join(mixed, "sig"), "left")
    drop(named, labels)
    few = left.filter((F.col("k") <= s.crowd) & (F.col("id") != F.col("hub")))
    other = few.select("sig", *[F.col(c).alias("b_" + c) for c in ("id", "n", "own", "label")])
    pairs = few.join(other, "sig").filter((F.col("id") < F.col("b_id")) & (F.col("label") != F.col("b_label")) & _possible("n", "own", "b_n", "b_own", s))
    more = _links(docs, pairs.select(F.col("id").alias("a"), F.col("b_id").alias("b")).distinct(), classes, s)
    found = materialise(links.union(more).union(_crowds(docs, left.filter(F.col("k") > s.crowd), classes, s)), "links")
    drop(left, links, more)
    return found


def _merged(members: DataFrame, sets: DataFrame, s: Similar) -> DataFrame:
    """members (g, id, n, label) with crowds put together whose hubs are in each other's and much alike, as those of one family of copies are."""
    tokens = sets.select("id", "tokens")
    hubs = members.select("g").distinct()
    held = members.join(hubs.select(F.col("g").alias("id")), "id").filter(F.col("id") != F.col("g")).select("g", "id", "n")
    near = held.join(tokens, "id").join(tokens.select(F.col("id").alias("g"), F.col("tokens").alias("of_hub")), "g")
    edges = near.filter((100 + s.percent) * F.size(_apart("tokens", "of_hub")) <= 6 * (100 - s.percent) * F.col("n")).select(F.col("g").alias("a"), F.col("id").alias("b"))
    roots = connect(materialise(hubs.select(F.col("g").alias("id"), F.struct(F.col("g").alias("id")).alias("label")), "hubs"), materialise(edges, "edges"))
    of_root = members.join(if_small(roots.select(F.col("id").alias("g"), F.col("label.id").alias("root")), of=roots), "g")
    return of_root.select(F.col("root").alias("g"), "id", "n", "label").distinct()


def _crowds(docs: DataFrame, left: DataFrame, classes: DataFrame, s: Similar) -> DataFrame:
    """(a, b): links between the classes of each hub in left (hub, id, n, label) that don't have one label yet.

    First crowds are taken apart: sets that differ from the hub in few tokens are near it, the others go on with a hub of their own, and
    those in between are in both parts, so that no two similar sets are parted. At most FEW that are left together are compared in pairs.

    What sets near a hub share says nothing, so each is held as its difference from a
    centre. Two sets of x and y tokens whose differences have p and q
    tokens, r of them in common, differ in p + q - 2r tokens; so they are similar enough if
    w(p, x) + w(q, y) <= 2 (100 + percent) r, where w(p, x) = (100 + percent) p - (100 - percent) x. With r = 0 that
    holds only if both are linked with the set of least w. Any others share a token of their differences, and
    one among the prefixes that the least r leaves. So the crowd is dealt out again
    by those tokens, until no more than FEW sets meet; these are compared in pairs, by their differences.

    Any centre and any order of tokens is right. The centre is the set nearest to the last centre, but for what more than half of the crowd differ in;
    tokens are counted throughout the crowd, and those that the fewest have come first, so that a prefix meets few others. A token that all of a crowd
    differ in is what it was dealt out by, and is in the centre from then on. After LEVELS rounds the centre is the nearest set itself. Sets linked with
    the set of least w are in one component, so they look only for sets that aren't.
    """
    members = materialise(left.select(F.col("hub").alias("g"), "id", "n", "label").distinct(), "members")
    if not members.seen["rows"]:
        drop(members)
        return classes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    wanted = _of(classes, members.select("id").union(members.select("g")), "c", "rep", "h")
    sets = materialise(whole_sets(docs, wanted, s), "sets")
    rest, near, pairs, turn = materialise(_merged(members, sets, s), "crowds"), [], [], 0
    drop(members, wanted)
    most = lambda n: F.expr(f"int({100 - s.percent} * ({n} + {n} * 100 div {s.percent}) div {100 + s.percent})")
    while True:
        limit = FEW if turn == 0 else 4 * FEW  # what is far from a hub has little in common
        size = rest.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("hub"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi")
        sized = materialise(rest.join(size, "g").select("g", "id", "n", "label", "size", "hub"), "sized", large=F.col("size") > limit)
        few = sized.filter(F.col("size") <= limit)
        other = few.select("g", *[F.col(c).alias("b_" + c) for c in ("id", "n", "label")])
        both = few.join(other, "g").filter((F.col("id") < F.col("b_id")) & (F.col("label") != F.col("b_label")) & (100 * F.least("n", "b_n") >= s.percent * F.greatest("n", "b_n")))
        pairs.append(materialise(both.select(F.col("id").alias("a"), F.col("b_id").alias("b")).distinct(), "pairs"))
        large = sized.filter(F.col("size") > limit)
        if not sized.seen["large"]:
            break
        hubs = sets.select(F.col("id").alias("hub"), F.col("tokens").alias("of_hub"))
        held = large.join(sets, "id").join(hubs, "hub").select("g", "hub", "id", "n", "label", F.array_sort(_apart("tokens", "of_hub")).alias("delta"), (4 * most("size(of_hub)")).alias("close"))
        held = materialise(held, "held")
        kept = held if turn == TURNS else held.filter(F.size("delta") <= F.col("close") + most("n"))
        near.append(materialise(kept.select("g", "id", "n", "label", "delta"), "near"))
        drop(rest, sized)
        rest = materialise(held.filter((F.size("delta") > F.col("close")) & (turn < TURNS)).select(F.xxhash64("g", "hub").alias("g"), "id", "n", "label"), "crowds")
        drop(held)
        turn += 1
    drop(rest, sized, sets)
    by_pairs = pairs[0]
    for x in pairs[1:]:
        by_pairs = by_pairs.union(x)
    out, level = [_links(docs, by_pairs.distinct(), classes, s)], 0
    drop(*pairs)
    if not near:
        return out[0]
    now = near[0]
    for x in near[1:]:
        now = now.union(x)
    now = materialise(now, "crowd")
    drop(*near)
    up, down, nothing = 100 + s.percent, 100 - s.percent, F.expr("cast(array() as array<long>)")
    while True:
        size = now.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min_by("delta", F.struct(F.size("delta"), "id")).alias("of_pivot"))
        sized = materialise(now.join(size, "g"), "sized")
        few = sized.filter(F.col("size") <= FEW)
        other = few.select("g", *[F.col(c).alias("b_" + c) for c in ("id", "n", "label", "delta")])
        both = few.join(other, "g").filter((F.col("id") < F.col("b_id")) & (F.col("label") != F.col("b_label")))
        apart = F.size("delta") + F.size("b_delta") - 2 * F.size(F.array_intersect("delta", "b_delta"))
        good = both.filter(_alike(apart, F.col("n"), F.col("b_n"), s))
        out.append(materialise(good.select(F.col("id").alias("a"), F.col("b_id").alias("b")).distinct(), "found"))
        large = materialise(sized.filter(F.col("size") > FEW).withColumn("delta", F.array_sort(_apart("delta", "of_pivot"))).drop("of_pivot"), "large")
        drop(now, sized)
        if not large.seen["rows"]:
            drop(large)
            break
        there = large.select("g", "size", F.explode("delta").alias("t")).groupBy("g", "t").agg(F.count(F.lit(1)).alias("k"), F.first("size").alias("size"))
        flipped = (2 * F.col("k") > F.col("size")) & (level < LEVELS)
        there = there.filter("k > 1").select("g", "t", flipped.alias("flipped"), F.when(flipped, F.col("size") - F.col("k")).otherwise(F.col("k")).alias("k"))
        there = materialise(there, "there")
        flip = materialise(there.filter("flipped").groupBy("g").agg(F.collect_list("t").alias("flip")), "flip")
        moved = large.join(if_small(flip), "g", "left").select("g", "id", "n", "label", _apart("delta", F.coalesce("flip", nothing)).alias("delta"))
        moved = materialise(moved.withColumn("w", up * F.size("delta") - down * F.col("n")), "moved")
        least = moved.groupBy("g").agg(F.min(F.struct("w", "id", "label")).alias("least"))
        led = moved.join(least, "g").withColumn("near", F.col("w") + F.col("least.w") <= 0)
        led = led.join(led.filter("not near").groupBy("g").agg(F.min("w").alias("far_w")), "g", "left")
        partner = F.when(F.col("near"), F.col("far_w")).otherwise(F.col("least.w"))
        shared = F.greatest(
            F.lit(1), F.ceil((F.col("w") + partner) / (2 * up)), F.ceil((F.col("w") - down * F.floor(F.col("n") * 100 / s.percent)) / F.lit(up))
        ).cast("int")
        led = led.select(
            "g", "id", "n", "delta", F.when(F.col("near"), F.col("least.label")).otherwise(F.col("label")).alias("label"),
            F.when(F.col("near") & (F.col("id") != F.col("least.id")), F.col("least.id")).alias("linked"), F.when(F.col("far_w").isNotNull(), F.size("delta") - shared + 1).otherwise(0).alias("take"),
        )
        led = materialise(led, "led")
        out.append(materialise(led.filter("linked is not null").select(F.col("linked").alias("a"), F.col("id").alias("b")), "near"))
        held = led.filter("take > 0").select("g", "id", "label", "take", F.size("delta").alias("own"), F.explode("delta").alias("t"))
        held = held.join(if_small(there.filter("k > 1").select("g", "t", "k"), of=there), ["g", "t"])
        held = held.groupBy("g", "id").agg(F.first("label").alias("label"), F.first(F.col("take") - F.col("own")).alias("spare"), F.array_sort(F.collect_list(F.struct("k", "t"))).alias("common"))
        prefix = F.slice("common", F.lit(1), F.greatest(F.size("common") + F.col("spare"), F.lit(0)))  # tokens that no other has come first, and meet none
        dealt = held.select("g", "id", "label", F.explode(prefix).alias("of")).select(F.xxhash64("g", "of.t").alias("to"), "g", "of.t", "id", "label")
        dealt = materialise(dealt, "dealt")
        mixed = dealt.groupBy("to").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who"))
        mixed = materialise(mixed.filter("lo != hi").groupBy("k", "who").agg(F.min("to").alias("to")).select("to"), "mixed")  # one of those in which the same sets meet
        now = dealt.join(mixed, "to").join(led.select("g", "id", "n", "delta"), ["g", "id"])
        now = materialise(now.select(F.col("to").alias("g"), "id", "n", "label", F.array_remove("delta", F.col("t")).alias("delta")), "crowd")
        drop(large, there, flip, moved, led, dealt, mixed)
        level += 1
    links = out[0]
    for x in out[1:]:
        links = links.union(x)
    found = materialise(links.distinct(), "links")
    drop(*out)
    return found
