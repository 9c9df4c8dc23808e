"""Array functions: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked(items: Column, mask: Column) -> Column:
    """Items whose mask holds; all where none does."""
    kept = F.transform(F.filter(F.arrays_zip(items.alias("x"), mask.alias("m")), lambda p: p["m"]), lambda p: p["x"])
    return F.when(F.size(kept) == 0, items).otherwise(kept)


def pad_keys(keys: Column, n: Column) -> Column:
    """The first n keys, with camera_0, camera_1, ... by place where there are fewer."""
    named = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(F.get(keys, i), F.concat(F.lit("camera_"), i.cast("string"))))
    return F.when(n > 0, named).otherwise(F.array().cast("array<string>"))


def pad_mask(items: Column, n: int, filler: Column) -> tuple[Column, Column]:
    """n items, filled up, and which of them are real."""
    padded = F.slice(F.concat(items, F.array_repeat(filler, n)), 1, n)
    return padded, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < F.size(items))


def numbered_list(items: Column, header: str = "Subtasks:") -> Column:
    """A header and `i. item` lines; blank items leave their number out; without any, the task is completed."""
    lines = F.transform(items, lambda x, i: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", F.concat((i + 1).cast("string"), F.lit(". "), F.trim(x))))
    kept = F.filter(lines, lambda x: x.isNotNull())
    body = F.when(F.size(kept) == 0, F.array(F.lit("1. task_completed"))).otherwise(kept)
    return F.array_join(F.concat(F.array(F.lit(header)), body), "\n")
