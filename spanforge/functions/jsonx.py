"""JSON in noisy text: Column -> Column."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def outer_braces(c: Column) -> Column:
    """From the first { to the last }, or null."""
    a, b = F.instr(c, "{"), F.length(c) - F.instr(F.reverse(c), "}") + 1
    return F.when((a > 0) & (F.instr(F.reverse(c), "}") > 0) & (b >= a), F.substr(c, a, b - a + 1))


def inline_config(c: Column) -> Column:
    """k=v;k=v as a map, keys and values trimmed."""
    pairs = F.filter(F.split(c, ";"), lambda x: F.contains(x, F.lit("=")))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.split_part(x, F.lit("="), F.lit(1))), F.trim(F.regexp_replace(x, "^[^=]*=", "")))))


def field(c: Column, key: str) -> Column:
    """The text value of "key": "..." or 'key': '...', or null."""
    both = [F.nullif(F.regexp_extract(c, rf"{q}{key}{q}\s*:\s*{q}([^{q}]*){q}", 1), F.lit("")) for q in "\"'"]
    return F.coalesce(*both)


# How a judge's answer in plain text names its fields.
SCORE, VERDICT, REASON = r"{}\s*[:=]\s*([-+]?[0-9]+(?:\.[0-9]+)?)", r"verdict\s*[:=]\s*(correct|partial|wrong)", r"reason\s*[:=]\s*(.+)"


def judge_fields(c: Column) -> dict[str, Column]:
    """Scores, verdict and reason of a judge's answer that is no JSON."""
    part = lambda p: F.nullif(F.regexp_extract(c, "(?i)" + p, 1), F.lit(""))
    out = {k: part(SCORE.format(k)).try_cast("double") for k in ("subtask_score", "memory_score", "total_score")}
    return out | {"verdict": F.lower(part(VERDICT)), "reason": F.btrim(F.trim(part(REASON)), F.lit('"'))}


def first_object(text: str | None) -> str | None:
    """The first JSON object that begins at some { of the text, keys in order."""
    decoder, at = json.JSONDecoder(), (text or "").find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False, sort_keys=True)
        except ValueError:
            at = text.find("{", at + 1)
    return None


def extract_json(c: Column) -> Column:
    """The first JSON object, keys in order."""

    @F.pandas_udf("string")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return scan(c)


def current_subtask(c: Column) -> Column:
    """From the text as JSON, from its outer braces, or by pattern."""
    return F.coalesce(*[F.get_json_object(x, "$.current_subtask") for x in (c, outer_braces(c))], field(c, "current_subtask"))
