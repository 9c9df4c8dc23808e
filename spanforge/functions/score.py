"""Scores of judged predictions: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = (0.0, 0.4, 0.9, 1.0)  # fixed values of the snapped scale
OVERRIDDEN = "char_match_override"  # fixed value of a reason
RELATIONS = ("unknown", "neither", "previous_subtask", "next_subtask")


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.when(b > 0, a.cast("double") / b), F.lit(0.0))


def judge_scores(subtask: Column, memory: Column, total: Column, rating: Column, verdict: Column) -> dict[str, Column]:
    """Scores on the scale of 5 and 10, whatever scale the judge answered in."""
    only = subtask.isNull() & memory.isNull()
    s, m = F.coalesce(F.when(only, rating), subtask, F.lit(0.0)), F.coalesce(F.when(only, rating), memory, F.lit(0.0))
    unit = s.between(0, 1) & m.between(0, 1)
    s, m = F.when(unit, s * 5).otherwise(s), F.when(unit, m * 5).otherwise(m)
    t = F.coalesce(total, s + m)
    t = F.when(t.between(0, 2), t * 5).otherwise(t)
    t = F.when(t <= 0, s + m).otherwise(t)
    v = F.lower(F.trim(F.coalesce(verdict, F.lit(""))))
    word = F.when(v.isin("correct", "partial", "wrong"), v).when(t >= 9, "correct").when(t >= 5, "partial").otherwise("wrong")
    return {"subtask_score": s, "memory_score": m, "total_score": t, "verdict": word}


def snap(score: Column) -> Column:
    """The nearest of the four levels, the smaller of two equally near, after scores over 1 and over 5 are scaled."""
    unit = F.when(score > 5, score / 10).when(score > 1, score / 5).otherwise(score)
    near = F.least(*[F.struct(F.round(F.abs(unit - x), 9).alias("d"), F.lit(x).alias("x")) for x in LEVELS])
    return near["x"]


def exact_override(subtask: Column, memory: Column, same_subtask: Column, same_memory: Column, verdict: Column, reason: Column | None = None) -> dict[str, Column]:
    """A part that matches exactly scores 5; total, verdict and reason follow."""
    s, m = F.when(same_subtask, 5.0).otherwise(subtask), F.when(same_memory, 5.0).otherwise(memory)
    t, hit = s + m, same_subtask | same_memory
    word = F.when(~hit, verdict).when(t >= 9.999, "correct").when(t <= 0, "wrong").otherwise("partial")
    said = F.lit(None).cast("string") if reason is None else reason
    return {"subtask_score": s, "memory_score": m, "total_score": t, "verdict": word, "overridden": hit, "reason": F.when(hit, OVERRIDDEN).otherwise(said)}


def neighbor_relation(score: Column, before: Column, after: Column, threshold: float = 0.5) -> Column:
    """Which neighbour a low-scored prediction resembles; before and after are null where there is none."""
    best = F.greatest(F.coalesce(before, F.lit(-1.0)), F.coalesce(after, F.lit(-1.0)))
    return (
        F.when(score >= threshold, "not_needed")
        .when(before.isNull() & after.isNull(), "unknown")
        .when(best < threshold, "neither")
        .when(after.isNull(), "previous_subtask")
        .when(before.isNull(), "next_subtask")
        .when(F.abs(before - after) < 1e-6, "neither")
        .when(before > after, "previous_subtask")
        .otherwise("next_subtask")
    )


def scale_index(i: Column, n: Column, m: Column) -> Column:
    """Index i of n in a stream of m: round half to even, clipped."""
    scaled = F.bround(i * (m - 1) / F.greatest(n - 1, F.lit(1)), 0).cast("long")
    return F.when((n <= 1) | (m == 1), F.lit(0)).when(n == m, F.least(F.greatest(i, F.lit(0)), m - 1)).otherwise(F.least(F.greatest(scaled, F.lit(0)), m - 1)).cast("long")


def dataset_seed(seed: int, name: Column, path: Column) -> Column:
    """A dataset's seed: the first 8 bytes of the SHA-256 of seed, name and path, by 2 ** 32."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), name, path), 256)
    return F.conv(F.substr(digest, F.lit(9), F.lit(8)), 16, 10).cast("long")  # what is left of 8 bytes by 2 ** 32 is the last 4


def hash_seed(text: Column) -> Column:
    """The first 8 hexadecimal digits of the text's MD5 as a number."""
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("long")


def combine(state: Column, visual: Column, weights: tuple[float, float] = (0.45, 0.55)) -> Column:
    """Weighted sum of what states and images say."""
    return weights[0] * state + weights[1] * visual


def candidate_reach(longest: Column, ratio: float = 0.55, least: int = 65, most: int = 460) -> Column:
    """Frames on either side of an expected boundary in which it is looked for. longest: expected length of the longer neighbour."""
    return F.greatest(F.lit(least), F.least(F.lit(most), ratio * longest)).cast("long")


def boundary_confidence(pause: Column, off: Column, reach: Column) -> Column:
    """From 0 to 1: how much of a pause a boundary is, and how near to where it was expected."""
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.55 * pause + 0.45 * F.exp(-F.abs(off) / reach))), 4)
