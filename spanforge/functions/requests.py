"""Requests, prompts, paths and labels: Column -> Column."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.text import any_of, normalize, strip


# Skills in prompts, aliases of modes, store prefixes, kinds of samples, and the texts around a request.
STORE = r"^(?:[^/]+:)?s3://"
POLICY_BACKENDS = {"local": "local", "model": "local", "websocket": "websocket", "ws": "websocket", "remote": "websocket"}
SAMPLE_MODES = {
    "global": "global", "merged": "global", "combined": "global", "overall": "global",
    "per_dataset_equal": "per_dataset_equal", "per_dataset": "per_dataset_equal", "dataset_equal": "per_dataset_equal", "split_by_dataset": "per_dataset_equal",
}
VIEW_MODES = {"head": "head", "head_only": "head", "single": "head", "head_wrists": "head_wrists", "head+wrists": "head_wrists", "multiview": "head_wrists", "multi": "head_wrists"}
SAMPLE_KINDS = {"uniform": "subtask", "transition_dense": "transition", "final_tail_dense": "final_tail"}
ANSWER_FORM = (
    "Choose exactly one atomic skill from the candidate list when the task is in progress; if the task is already completed, set current_skill to null and current_subtask to task_completed. "
    'Predict the subtask and active language memory that should be active now. Return JSON only with keys "current_skill", "current_subtask", and "active_language_memory".'
)

HEADS = ("Global Task Goal: ", "Input Language Memory: ", "Detailed Global Task Instruction: ", "Candidate Atomic Skills: [")
QUESTION = ("[Question]\nTask Goal: ", "\nInput Language Memory: ", "\n\n[Reference Answer]\n", "\n\n[Assistant Answer]\n", "\n\nNow output JSON only.")
UNROUTED = ("Unsupported message type '", "Payload must be a dict")
COMPARE = ("\n[Reference Subtask]\n", "\n\n[Assistant Subtask]\n", "\n\nNow output JSON only.")
NOTES = ("Follow the instruction where the rules allow it.", "Each image shows the head view above the wrist views, left before right.")


def contains_any(c: Column, terms: list[str]) -> Column:
    """Whether the normalised text holds any of the normalised terms."""
    plain = normalize(c)
    return any_of([F.contains(plain, normalize(F.lit(t))) for t in terms]) if terms else F.lit(False)


def alias_of(c: Column, aliases: dict[str, str], default: str, what: str = "value") -> Column:
    """The name that an alias stands for, default for an empty one, an error for any other."""
    key = F.coalesce(F.nullif(strip(F.lower(c)), F.lit("")), F.lit(default))
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.raise_error(F.concat(F.lit(f"unsupported {what}: "), key)))


def sample_kind(block_kind: Column) -> Column:
    """What the samples of a block are called."""
    table = F.create_map(*[F.lit(x) for kv in SAMPLE_KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, block_kind), F.lit("unknown"))


def session_name(prefix: Column, episode: Column) -> Column:
    """prefix-episode-000001, other signs than letters, digits, dots, dashes and underscores as one underscore; `eval` for an empty prefix."""
    safe = F.btrim(F.regexp_replace(F.coalesce(F.nullif(prefix, F.lit("")), F.lit("eval")), "[^A-Za-z0-9_.-]+", "_"), F.lit("._-"))
    return F.format_string("%s-episode-%06d", F.coalesce(F.nullif(safe, F.lit("")), F.lit("eval")), episode)


def session_folder(session: Column) -> Column:
    """A session's id with other signs than letters, digits, dashes and underscores as underscores, one each."""
    return F.regexp_replace(F.coalesce(F.nullif(session, F.lit("")), F.lit("default")), r"[^\p{L}\p{N}_-]", "_")


def head_view(keys: Column) -> Column:
    """The place (from 0) of the first camera key of a head view; an error if there is none."""
    hit = F.transform(keys, lambda k: F.contains(F.lower(F.trim(k)), F.lit("head")) | F.contains(F.lower(F.trim(k)), F.lit("cam_high")))
    place = F.array_position(hit, True)
    return F.when(place > 0, place - 1).otherwise(F.raise_error(F.concat(F.lit("no head view among "), F.array_join(keys, ","))))


def main_video_key(listed: Column) -> Column:
    """Of a comma-separated list the first key with `head` or `front` in it, else the first; an error for an empty list."""
    keys = F.filter(F.transform(F.split(listed, ","), lambda k: F.trim(k)), lambda k: k != "")
    front = F.filter(keys, lambda k: F.contains(F.lower(k), F.lit("head")) | F.contains(F.lower(k), F.lit("front")))
    return F.coalesce(F.get(front, F.lit(0)), F.get(keys, F.lit(0)), F.raise_error(F.lit("no video keys")))


def ordered_plan(plan: Column) -> Column:
    """The steps of a plan: what bars part, else its lines."""
    parts = lambda by: F.filter(F.transform(F.split(F.coalesce(plan, F.lit("")), by), strip), lambda x: x != "")
    return F.when(F.contains(F.coalesce(plan, F.lit("")), F.lit("|")) & (F.size(parts(r"\|")) > 0), parts(r"\|")).otherwise(parts(r"\r\n|\n|\r"))


def ordered_list(items: Column, default: Column) -> Column:
    """A list's non-empty items, else those of the default."""
    kept = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x != "")
    return F.when(F.size(kept(items)) > 0, kept(items)).otherwise(kept(default))


def plan_text(steps: Column) -> Column:
    """A single step as it is, several with numbers."""
    return F.when(F.size(steps) == 1, steps[0]).otherwise(F.array_join(F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n"))


def policy_header(task: Column, memory: Column, plan: Column, detailed: Column, skills: tuple[str, ...], use_detailed: bool = False) -> Column:
    """What a policy is told before the images. The detailed instruction stands in only without a plan, and if it says more than the task."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    lines = [F.when(given(task), F.concat(F.lit(HEADS[0]), task)), F.when(given(memory), F.concat(F.lit(HEADS[1]), memory))]
    if use_detailed:
        lines.append(F.when(given(detailed) & (detailed != F.coalesce(task, F.lit(""))) & ~given(plan), F.concat(F.lit(HEADS[2]), detailed)))
    else:
        lines.append(F.when(given(plan), plan))
    return F.concat_ws("\n", *lines, F.lit(HEADS[3] + ", ".join(skills) + "]"))


def policy_prompt(header: Column, views: Column) -> Column:
    """The header, a line for each view's image, and the form of the answer."""
    images = F.transform(views, lambda v, i: F.concat(F.lit("Image "), (i + 1).cast("string"), F.lit(" ("), v, F.lit("):")))
    return F.concat_ws("\n", header, F.array_join(images, "\n"), F.lit(ANSWER_FORM))


def judge_prompt(rules: str, task: Column, memory: Column, subtask: Column, active: Column, answer: Column) -> Column:
    """Question, reference answer as JSON and the assistant's answer, after the rules."""
    reference = F.to_json(F.struct(subtask.alias("current_subtask"), active.alias("active_language_memory")))
    parts = [F.lit(rules), *[x for q, a in zip(QUESTION, (task, memory, reference, answer), strict=False) for x in (F.lit(q), a)], F.lit(QUESTION[4])]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def compare_prompt(rules: list[str], reference: Column, candidate: Column) -> Column:
    """What a judge is asked about two subtasks: the rules, a line each, the reference, the candidate. Null texts are empty."""
    parts = [F.lit("".join(f"{r}\n" for r in rules)), F.lit(COMPARE[0]), reference, F.lit(COMPARE[1]), candidate, F.lit(COMPARE[2])]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def annotation_prompt(rules: list[str], sample: Column, frames: Column, fps: Column, skills: tuple[str, ...], instruction: Column, stitched: Column, notes: tuple[str, str] = NOTES) -> Column:
    """What an annotator is told of a video: what it is given, the rules with numbers, and an answer's form filled with what is known.

    instruction: taken in only if it isn't blank, with notes[0]; stitched: whether images show several views, which notes[1] explains.
    """
    some = F.nullif(strip(instruction), F.lit(""))
    given = [
        F.concat(F.lit("- sample_id: "), sample), F.concat(F.lit("- total_frames: "), frames.cast("string")), F.concat(F.lit("- fps: "), fps.cast("string")), F.lit(f"- allowed_atomic_skills: [{', '.join(skills)}]"),
        F.concat(F.lit("- task_instruction: "), some, F.lit(f"\n{notes[0]}")), F.when(stitched, F.lit(notes[1])),
    ]
    numbered = "\n".join(f"{i}. {r}" for i, r in enumerate(rules, 1))
    segment = F.struct(F.lit(0).alias("seg_id"), F.lit(0).alias("start_frame"), (frames - 1).alias("end_frame"), F.lit("").alias("substask"), F.lit("").alias("primitive_skill"))
    form = F.to_json(F.struct(sample.alias("sample_id"), frames.alias("nframes"), fps.alias("fps"), F.lit("").alias("task"), F.array(segment).alias("segments")))
    return F.concat_ws("\n", F.lit("Input:"), *given, F.lit(f"Rules:\n{numbered}"), F.lit("Answer with JSON alone, in this form:"), form)


def join_path(base: Column, rel: Column) -> Column:
    """rel under base; as it is if it is absolute or names a store itself. Local paths lose `.` and `..`."""
    absolute = F.regexp_like(rel, F.lit(STORE)) | F.startswith(rel, F.lit("/"))
    far = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(F.regexp_replace(rel, r"^\./", ""), F.lit("/")))
    return F.when(absolute, rel).when(F.regexp_like(base, F.lit(STORE)), far).otherwise(plain_path(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), rel)))


def plain_path(path: Column) -> Column:
    """A path without empty parts, `.` and `..`."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, p)))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(kept, "/"))


def portable_path(path: Column, root: str) -> Column:
    """The path from root on if it lies there, else the whole."""
    plain, at = plain_path(path), F.lit(root.rstrip("/") + "/")
    return F.when(F.startswith(plain, at), F.substr(plain, F.length(at) + 1)).otherwise(plain)


def offset_label(seconds: Column) -> Column:
    """t, t-0.5s, t+1.0s"""
    return F.when(F.abs(seconds) < 1e-9, "t").when(seconds < 0, F.format_string("t-%.1fs", F.bround(F.abs(seconds), 1))).otherwise(F.format_string("t+%.1fs", F.bround(seconds, 1)))


def time_label(seconds: Column) -> Column:
    return F.format_string("%.1fs", F.bround(seconds.cast("double"), 1))


def byte_range(header: Column, size: Column) -> Column:
    """(status, start, end, length) of a request for part of a file: 200 without a range, 206, or 416 with nulls."""
    m = lambda i: F.nullif(F.regexp_extract(F.trim(header), r"^bytes=(\d*)-(\d*)$", i), F.lit("")).cast("long")
    a, b, matched = m(1), m(2), F.regexp_like(F.trim(header), F.lit(r"^bytes=(\d*)-(\d*)$"))
    start = F.when(a.isNull(), F.greatest(F.lit(0), size - b)).otherwise(a)
    end = F.when(a.isNull(), size - 1).otherwise(F.coalesce(b, size - 1))
    good = matched & (a.isNotNull() | b.isNotNull()) & (start < size) & (end >= start)
    last = F.least(end, size - 1)
    one = lambda status, x, y: F.struct(F.lit(status).alias("status"), x.cast("long").alias("start"), y.cast("long").alias("end"), (y - x + 1).cast("long").alias("length"))
    none = F.lit(None).cast("long")
    return F.when(F.coalesce(header, F.lit("")) == "", one(200, F.lit(0), size - 1)).when(good, one(206, start, last)).otherwise(one(416, none, none))


def timeline(frame: Column, length: Column, width: int) -> Column:
    """The pixel of a frame on a line of this width."""
    return F.floor(frame / F.greatest(length, F.lit(1)) * width).cast("long")


def wrapped(prefix: str, c: Column, width: int = 72) -> Column:
    """prefix: text, wrapped and set in; <empty> for a blank text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str:
            lines = textwrap.wrap((t or "").strip() or "<empty>", width=width) or ["<empty>"]
            return "\n".join([f"{prefix}: {lines[0]}", *(" " * (len(prefix) + 2) + x for x in lines[1:])])

        return texts.map(one, na_action=None)

    return run(c)


def visual_fps(own: Column, interval_sec: Column, fps: Column, interval: Column) -> Column:
    """Rate of a drawn video: its own, else that of samples by seconds, else by frames; 1 at least."""
    rate = F.when(own.isNotNull(), own).when(interval_sec > 0, 1.0 / interval_sec).otherwise(fps / F.greatest(F.lit(1), interval))
    return F.greatest(F.lit(1.0), rate.cast("double"))


def request_task(task: Column, instruction: Column, instructions: Column, default: Column) -> Column:
    """A request's task: its text, else its instruction, else the first of its instructions, else the default."""
    some = lambda c: F.nullif(strip(c), F.lit(""))
    return F.coalesce(some(task), some(instruction), some(F.get(instructions, F.lit(0))), strip(default))


def first_setting(settings: dict[str, str], names: list[str], default: str) -> str:
    """The first of the named settings that isn't blank, trimmed; else default."""
    return next((v.strip() for n in names if (v := settings.get(n)) and v.strip()), default)


def endpoints(listed: str | None, default: str) -> list[str]:
    """The parts of a comma-separated list, else the default alone."""
    return [p.strip() for p in (listed or "").split(",") if p.strip()] or [default]


def chat_text(response: Column) -> Column:
    """(text, error) of a chat response: content of the first choice, its text parts joined by line feeds; JSON within a JSON text is opened once; a web page is an error."""
    opened = F.coalesce(F.try_variant_get(F.try_parse_json(response), "$", "string"), response)
    inner = F.when(F.startswith(F.ltrim(opened), F.lit("{")), opened).otherwise(response)
    content = F.get_json_object(inner, "$.choices[0].message.content")
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda x: x.isNotNull()), "\n")
    text = F.when(F.startswith(content, F.lit("[")) & parts.isNotNull(), joined).otherwise(content)
    html = F.regexp_like(response, F.lit(r"(?is)^\s*<(!doctype html|html)"))
    error = F.when(html, "html").when(F.try_parse_json(inner).isNull(), "no_json").when(text.isNull(), "no_content")
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def routed(message: Column) -> Column:
    """(status, ok, type, request_id, payload, error) of a request as JSON; what is wrong is said, never raised."""
    get = lambda p: F.get_json_object(message, p)
    kind = F.coalesce(get("$.type"), F.lit("infer"))
    payload = F.coalesce(get("$.payload"), message)
    is_object = F.startswith(F.coalesce(F.schema_of_variant(F.try_parse_json(payload)), F.lit("")), F.lit("OBJECT"))
    request = F.coalesce(F.when(is_object, F.get_json_object(payload, "$.request_id")), get("$.request_id"), F.lit("default"))
    error = (
        F.when(F.try_parse_json(message).isNull(), "no_json").when(kind == "ping", None).when(kind != "infer", F.concat(F.lit(UNROUTED[0]), kind, F.lit("'")))
        .when(~is_object, UNROUTED[1])
    )
    name = F.when(kind == "ping", "ping").when(kind == "infer", "inference_result").otherwise("unknown")
    return F.struct(
        F.when(error.isNull(), "ok").otherwise("error").alias("status"), error.isNull().alias("ok"), name.alias("type"), request.alias("request_id"),
        F.when(error.isNull() & (kind == "infer"), payload).alias("payload"), error.alias("error"),
    )
