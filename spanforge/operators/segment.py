"""Segmentation of episodes by labelled ones: templates are fitted, each episode gets the nearest, and its boundaries are the path of least cost.

Samples: (episode_index, frame_index, state, visual) of sampled frames. Motion: (episode_index, frame_index, motion) of all frames.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.features import by_modality, descriptors, last_frames, standardised
from spanforge.operators.intervals import boundaries_to_segments
from spanforge.operators.stats import FLOOR, mode_nonempty, nearest, ratio_priors
from spanforge.operators.tables import SMALL_CELLS, small
from spanforge.sinks.writers import kept

MODALITIES = ("state", "visual")


@dataclass(frozen=True)
class Search:
    duration_weight: float = 0.85
    motion_weight: float = 0.25
    least: int = 30  # frames of a segment
    # Reach, refine's 80 and near, and the weights here and in `refine`, `confidences` and `segment_path` (0.08, 0.45, 0.55).
    keep: int = 45  # candidates of a boundary, besides the expected one
    reach: tuple[float, int, int] = (0.55, 65, 460)  # of a window: part of the longer neighbour's expected length; at least; at most
    refine: int = 55  # frames a boundary may move afterwards
    near: int = 90  # frames on either side that a boundary's motion is held against
    length_weight: float = 2.0
    weights: tuple[float, float] = (0.45, 0.55)  # of state and visual


@dataclass(frozen=True)
class Template:
    """start: where each segment begins; part and least: median and least length; all as parts of the episode."""

    start: np.ndarray
    part: np.ndarray
    least: np.ndarray

    def expected(self, n: int) -> list[int]:
        return [int(round(float(x) * n)) for x in self.start[1:]]


def labelled_samples(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """Samples of labelled episodes with template (number of segments) and seg_id; a segment with under two has the one nearest its middle too."""
    n = F.count(F.lit(1)).over(Window.partitionBy("episode_index"))
    s = segments.select("episode_index", "seg_id", "start_frame", "end_frame").withColumn("template", n)
    pairs = samples.select("episode_index", "frame_index").join(s, "episode_index")
    inside = (F.col("frame_index") >= F.col("start_frame")) & (F.col("frame_index") < F.col("end_frame"))
    middle = F.floor((F.col("start_frame") + F.col("end_frame")) / 2)
    per = pairs.groupBy("episode_index", "seg_id", "template").agg(F.collect_set(F.when(inside, F.col("frame_index"))).alias("held"), F.min_by("frame_index", F.struct(F.abs(F.col("frame_index") - middle), "frame_index")).alias("middle"))
    held = F.when(F.size("held") < 2, F.array_union("held", F.array("middle"))).otherwise(F.col("held"))
    return per.select("episode_index", "seg_id", "template", F.explode(held).alias("frame_index")).join(samples, ["episode_index", "frame_index"])


def fit_models(samples: DataFrame, segments: DataFrame, episodes: DataFrame) -> DataFrame:
    """(template, modality, seg_id, dim, mean, var, all_mean, all_std): values standardised over all samples of a template's episodes, then means and variances by segment."""
    n = segments.groupBy("episode_index").agg(F.count(F.lit(1)).alias("template"))
    whole = by_modality(samples.join(small(n), "episode_index"), ["template"]).groupBy("template", "modality", "dim")
    whole = whole.agg(F.avg("x").alias("all_mean"), F.greatest(F.stddev_pop("x"), F.lit(FLOOR)).alias("all_std"))
    one = by_modality(labelled_samples(samples, segments), ["template", "seg_id"]).groupBy("template", "modality", "seg_id", "dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    both = one.join(whole, ["template", "modality", "dim"])
    var = F.greatest(F.col("v") / (F.col("all_std") * F.col("all_std")), F.lit(FLOOR))
    name = F.element_at(F.array(*map(F.lit, MODALITIES)), F.col("modality") + 1)
    return both.select("template", name.alias("modality"), "seg_id", "dim", ((F.col("m") - F.col("all_mean")) / F.col("all_std")).alias("mean"), var.alias("var"), "all_mean", "all_std")


def template_texts(segments: DataFrame, text: str = "text") -> DataFrame:
    """(template, seg_id, text, skill): the most frequent of each place of each template, of equally frequent ones that of the smaller episode."""
    n = F.count(F.lit(1)).over(Window.partitionBy("episode_index"))
    s = segments.withColumn("template", n).withColumn("__k", F.concat_ws(":", "template", "seg_id"))
    s = s.withColumns({"text": F.trim(F.coalesce(text, F.lit(""))), "skill": F.trim(F.coalesce("skill", F.lit("")))})
    keys = s.select("__k", "template", "seg_id").distinct()
    for c in ("text", "skill"):
        keys = keys.join(mode_nonempty(s, "__k", c, "episode_index").select("__k", F.col("mode").alias(c)), "__k", "left")
    return keys.select("template", "seg_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("skill", F.lit("")).alias("skill"))


def first_tasks(labels: DataFrame) -> DataFrame:
    """(template, tasks): the tasks of the first labelled episode of a template that has any. labels: (episode_index, template, tasks)."""
    return labels.filter(F.size("tasks") > 0).groupBy("template").agg(F.min_by("tasks", "episode_index").alias("tasks"))


def match_templates(samples: DataFrame, lengths: DataFrame, segments: DataFrame, s: Search = Search()) -> DataFrame:
    """(episode_index, matched, template, score): the labelled episode that each of the others is nearest to, by standardised descriptors and length."""
    d = kept(standardised(kept(descriptors(samples, lengths), "descriptors"), "v"), "standardised")
    n = segments.groupBy("episode_index").agg(F.count(F.lit(1)).alias("template"))
    models = d.join(n, "episode_index").select(F.col("episode_index").alias("model"), F.col("v").alias("mv"), F.col("length").alias("mlength"))
    targets = d.join(n, "episode_index", "left_anti").select(F.col("episode_index").alias("id"), "v", "length")
    found = nearest(targets, models, s.length_weight)
    return found.join(n.withColumnRenamed("episode_index", "model"), "model").select(F.col("id").alias("episode_index"), F.col("model").alias("matched"), "template", "score")


def row_costs(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """(samples, segments): mean negative log likelihood, from 0 for a sample's best segment to 1 at its 90th percentile."""
    cost = np.stack([(0.5 * ((x - m) ** 2 / v + np.log(v))).mean(axis=1) for m, v in zip(mean, var, strict=True)], axis=1)
    cost -= cost.min(axis=1, keepdims=True)
    return cost / np.maximum(np.percentile(cost, 90, axis=1, keepdims=True), 1e-6)


def local_minima(values: np.ndarray, lo: int, hi: int) -> np.ndarray:
    f = np.arange(max(1, lo) + 1, min(len(values) - 2, hi))
    return f[(values[f] <= values[f - 1]) & (values[f] <= values[f + 1])]


def candidates(motion: np.ndarray, samples: np.ndarray, expected: int, reach: int, keep: int) -> np.ndarray:
    """Sampled frames and minima of motion around the expected boundary, the `keep` of least motion, and the expected one."""
    n = len(motion)
    lo, hi = max(1, expected - reach), min(n - 1, expected + reach)
    pool = np.unique(np.concatenate([samples[(samples >= lo) & (samples <= hi)], local_minima(motion, lo, hi), [expected]]).astype("i8"))
    order = np.lexsort((pool, np.abs(pool - expected), motion[np.clip(pool, 0, n - 1)]))
    return np.unique(np.clip(np.append(pool[order][:keep], expected), 1, n - 1))


def emission(prefix: np.ndarray, samples: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mean cost of the samples in [start, end), or of the next one from its middle on where it holds none. prefix: of one segment, from 0 on."""
    a, b = np.searchsorted(samples, start), np.searchsorted(samples, end)
    middle = np.minimum(np.searchsorted(samples, (start + end) // 2), len(samples) - 1)
    empty = b <= a
    a, b = np.where(empty, middle, a), np.where(empty, middle + 1, b)
    return (prefix[b] - prefix[a]) / (b - a)


def segment_path(motion: np.ndarray, samples: np.ndarray, cost: np.ndarray, t: Template, s: Search = Search()) -> list[int]:
    """Boundaries between the template's segments, of least total cost; none for a single segment. Raises ValueError where no path keeps all least lengths."""
    n, k = len(motion), len(t.part)
    if k == 1:
        return []
    prefix = np.vstack([np.zeros(k), np.cumsum(cost, axis=0)])
    wanted, shortest = np.maximum(t.part * n, s.least), np.maximum(t.least * n * 0.45, s.least)
    ratio, near, far = s.reach
    places = [np.zeros(1, "i8")]
    for b, at in enumerate(t.expected(n)):
        places.append(candidates(motion, samples, at, int(max(near, min(far, ratio * max(t.part[b], t.part[b + 1]) * n))), s.keep))
    places.append(np.array([n]))
    total, back = np.zeros(1), []
    for seg in range(k):
        a, b = np.broadcast_arrays(places[seg][None, :], places[seg + 1][:, None])
        span = b - a
        step = emission(prefix[:, seg], samples, a, b) + s.duration_weight * ((span - wanted[seg]) / max(wanted[seg], 1.0)) ** 2
        held = np.where(span >= shortest[seg], total[None, :] + step, np.inf)
        back.append(held.argmin(axis=1))  # the first of equal costs
        total = held.min(axis=1) + (s.motion_weight * motion[places[seg + 1]] if seg < k - 1 else 0)
    if not np.isfinite(total[0]):
        raise ValueError("no boundaries keep the least lengths")
    at, path = 0, []
    for seg in range(k - 1, 0, -1):
        at = back[seg][at]
        path.append(int(places[seg][at]))
    return refine(motion, path[::-1], t.expected(n), s)


def refine(motion: np.ndarray, path: list[int], expected: list[int], s: Search) -> list[int]:
    """Moves each boundary, from the left, to the frame of least motion nearby, nearness to the expected one counting a little."""
    out, n = [], len(motion)
    for i, b in enumerate(path):
        lo = max(b - s.refine, (out[-1] if out else 0) + s.least)
        hi = min(b + s.refine, (path[i + 1] if i + 1 < len(path) else n) - s.least)
        f = np.arange(lo, hi + 1)
        out.append(int(f[np.argmin(motion[f] + 0.08 * np.abs(f - expected[i]) / max(1, hi - lo))]) if len(f) else b)
    return out


def confidences(motion: np.ndarray, path: list[int], t: Template, s: Search) -> list[float]:
    """How far each boundary is a pause in the motion around it, and how near where it was expected; from 0 to 1."""
    n, out = len(motion), []
    for i, (b, e) in enumerate(zip(path, t.expected(n), strict=True)):
        local = motion[max(0, b - s.near) : b + s.near + 1]
        high = np.percentile(local, 80)
        pause = (high - motion[b]) / max(high - local.min(), 1e-6)
        reach = max(80.0, 0.55 * max(t.part[i], t.part[i + 1]) * n)
        out.append(round(float(np.clip(0.55 * pause + 0.45 * np.exp(-abs(b - e) / reach), 0, 1)), 4))
    return out


FOUND = "episode_index long, length long, boundaries array<long>, confidences array<double>, expected array<long>, mean_confidence double, error string"


def _arrays(models: DataFrame) -> dict:
    """(mean, var) by segment and dimension, (mean, std) of all by dimension, of each modality of each template."""
    one = F.array_sort(F.collect_list(F.struct("seg_id", "dim", "mean", "var", "all_mean", "all_std")))
    out: dict = {}
    for r in models.groupBy("template", "modality").agg(one.alias("m")).collect():
        dims = 1 + max(x["dim"] for x in r["m"])
        columns = [np.array([x[c] for x in r["m"]], float).reshape(-1, dims) for c in ("mean", "var", "all_mean", "all_std")]
        out.setdefault(r["template"], {})[r["modality"]] = (columns[0], columns[1], columns[2][0], columns[3][0])
    return out


def sample_costs(samples: DataFrame, assigned: DataFrame, models: DataFrame, s: Search = Search(), cells: int = SMALL_CELLS) -> DataFrame:
    """(episode_index, template, frame_index, cost): what each sample costs in each segment of its episode's template.

    Costs are made where the samples lie, so of a sample's thousands of numbers only as many go on as the template has segments. Templates' models are sent to all tasks in
    turns of about `cells` numbers; samples of a template without a model give no row.
    """
    size, turns = {r[0]: r[1] for r in models.groupBy("template").count().orderBy("template").collect()}, [[]]
    for t, n in size.items():
        if turns[-1] and sum(size[x] for x in turns[-1]) + n > cells:
            turns.append([])
        turns[-1].append(t)
    schema, out = "episode_index long, template long, frame_index long, cost array<double>", None
    rows = samples.join(small(assigned.select("episode_index", "template")), "episode_index").select("episode_index", F.col("template").cast("long").alias("template"), "frame_index", *[F.col(m).cast("array<double>").alias(m) for m in MODALITIES])
    for turn in turns:
        held = _arrays(models.filter(F.col("template").isin(turn))) if turn else {}

        def price(batches, held=held):
            for b in batches:
                template = b.column("template").to_numpy()
                for t in np.unique(template):
                    own = np.flatnonzero(template == t)
                    for i in range(0, len(own), 512):
                        part = b.take(pa.array(own[i : i + 512]))
                        cost = 0.0
                        for m, weight in zip(MODALITIES, s.weights, strict=True):
                            mean, var, center, spread = held[t][m]
                            x = part.column(m).flatten().to_numpy().reshape(part.num_rows, -1)
                            cost = cost + weight * row_costs((x - center) / spread, mean, var)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype="i4") * cost.shape[1]), pa.array(cost.reshape(-1)))
                        yield pa.RecordBatch.from_arrays([part.column("episode_index").cast(pa.int64()), part.column("template"), part.column("frame_index").cast(pa.int64()), lists], ["episode_index", "template", "frame_index", "cost"])

        one = rows.filter(F.col("template").isin(turn)).mapInArrow(price, schema)
        out = one if out is None else out.unionByName(one)
    return out


def solve(samples: DataFrame, motion: DataFrame, assigned: DataFrame, models: DataFrame, priors: DataFrame, s: Search = Search()) -> DataFrame:
    """FOUND for each episode in assigned (episode_index, template): its boundaries by its template, or error.

    An episode is one row: its frames' motion, and for each sample as many costs as the template has segments (see `sample_costs`), so an hour takes a few MB.
    Episodes of a template that has no model give no rows.
    """
    prior = priors.groupBy("template").agg(F.array_sort(F.collect_list(F.struct("seg_id", "start", "part", "least"))).alias("prior"))
    moved = motion.groupBy("episode_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "motion"))), lambda x: x["motion"]).alias("motion"))
    costs = sample_costs(samples, assigned, models, s).groupBy("episode_index", "template").agg(F.array_sort(F.collect_list(F.struct("frame_index", "cost"))).alias("c"))
    costs = costs.select("episode_index", "template", F.transform("c", lambda x: x["frame_index"]).alias("frames"), F.flatten(F.transform("c", lambda x: x["cost"])).alias("cost"))
    rows = costs.join(moved, "episode_index").join(small(prior, 1000), "template").select("episode_index", "motion", "frames", "cost", "prior")

    def run(batches):
        for b in batches:
            found = []
            for r in b.itertuples(index=False):
                t = Template(*(np.array([x[c] for x in r.prior], float) for c in ("start", "part", "least")))
                found.append((r.episode_index, len(r.motion), *_solved(np.asarray(r.motion, float), np.asarray(r.frames, "i8"), np.asarray(r.cost, float), t, s)))
            yield pd.DataFrame(found, columns=[c.split()[0] for c in FOUND.split(", ")])

    return rows.mapInPandas(run, FOUND)


def _solved(motion: np.ndarray, frames: np.ndarray, cost: np.ndarray, t: Template, s: Search) -> tuple:
    try:
        path = segment_path(motion, frames, cost.reshape(len(frames), -1), t, s)
    except ValueError as e:
        return None, None, None, None, str(e)
    sure = confidences(motion, path, t, s)
    return path, sure, t.expected(len(motion)), round(float(np.mean(sure)), 4) if sure else None, None


def annotate(samples: DataFrame, motion: DataFrame, segments: DataFrame, episodes: DataFrame, s: Search = Search()) -> tuple[DataFrame, DataFrame]:
    """(documents, summary) of the episodes that have no segments yet, by those that have.

    segments: (episode_index, seg_id, start_frame, end_frame, text, skill) of labelled episodes; episodes: (episode_index, length, tasks). Documents have
    their own tasks or else the template's. Episodes that could not be segmented are in the summary, with error.
    """
    samples, motion, segments = kept(samples, "samples"), kept(motion, "motion"), kept(segments, "segments")
    lengths = last_frames(motion)
    labelled = segments.groupBy("episode_index").agg(F.max("end_frame").alias("length"), F.count(F.lit(1)).alias("template"))
    known = samples.join(labelled.select("episode_index"), "episode_index", "left_semi")
    assigned = kept(match_templates(samples, lengths, segments, s), "assigned")
    models = kept(fit_models(known, segments, episodes), "models")
    found = kept(solve(samples, motion, assigned, models, ratio_priors(segments, labelled), s), "found")
    summary = found.join(assigned, "episode_index").select(
        "episode_index", "length", F.concat(F.col("template").cast("string"), F.lit("-subtasks")).alias("template_key"), F.col("template").alias("num_subtasks"), F.col("matched").alias("matched_manual_episode"),
        F.col("score").alias("template_match_score"), "mean_confidence", "boundaries", "error",
    )
    good = found.filter("error is null").join(assigned.select("episode_index", "template"), "episode_index")
    rows = boundaries_to_segments(good.select("episode_index", "boundaries", "length")).join(good.select("episode_index", "template"), "episode_index")
    rows = rows.join(small(template_texts(segments)), ["template", "seg_id"])
    config = F.array_sort(F.collect_list(F.struct("seg_id", "start_frame", "end_frame", F.col("text").alias("action_text"), "skill")))
    fallback = first_tasks(episodes.join(labelled.select("episode_index", "template"), "episode_index"))
    docs = rows.groupBy("episode_index", "template").agg(config.alias("action_config")).join(good.select("episode_index", "length"), "episode_index")
    docs = docs.join(episodes.select("episode_index", "tasks"), "episode_index", "left").join(small(fallback.withColumnRenamed("tasks", "__t")), "template", "left")
    tasks = F.when(F.size(F.coalesce("tasks", F.array())) > 0, F.col("tasks")).otherwise(F.coalesce("__t", F.array().cast("array<string>")))
    return docs.select("episode_index", tasks.alias("tasks"), "length", "action_config"), summary
