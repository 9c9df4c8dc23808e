"""Which datasets to read, and with which settings: a registry, a JSON file, or a line of text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.jsonx import inline_config
from spanforge.operators.tables import small

# Suffixes of a dataset's name that say what kind of task it holds.
TASK_TYPES = ("_spatial", "_counting", "_long")


def from_registry(registry: DataFrame, names: list[str]) -> DataFrame:
    """The registry's rows (dataset_name, ...) of these names with sampling_rate; a final %NN of a name is its rate in percent.

    ["all"] is every row. A name that isn't there is an error.
    """
    if names == ["all"]:
        return registry.withColumn("sampling_rate", F.lit(1.0))
    asked = [(i, re.sub(r"%\d+$", "", n), int(m[1]) / 100 if (m := re.search(r"%(\d+)$", n)) else 1.0) for i, n in enumerate(names)]
    wanted = registry.sparkSession.createDataFrame(asked, "__pos int, dataset_name string, sampling_rate double")
    unknown = [r["dataset_name"] for r in wanted.join(registry, "dataset_name", "left_anti").collect()]  # of the names asked for
    if unknown:
        raise ValueError(f"no such datasets: {unknown}")
    return registry.join(F.broadcast(wanted), "dataset_name").orderBy("__pos").drop("__pos")


def from_text(spark: SparkSession, source: str) -> DataFrame:
    """(pos, config): `key=value;key=value,...` as maps; data_path is the annotation's folder unless given. Needs annotation_path."""
    items = [x.strip() for x in source.split(",") if x.strip()]
    if not items or not all("=" in x for x in items):
        raise ValueError("expected key=value;key=value,... or a file")
    for x in items:
        if bad := [p for p in x.split(";") if p.strip() and "=" not in p]:
            raise ValueError(f"not key=value: {bad}")
    rows = spark.createDataFrame(list(enumerate(items)), "pos long, item string")
    return rows.select("pos", with_data_path(inline_config(F.col("item"))).alias("config"))


def with_data_path(config: Column) -> Column:
    path = F.coalesce(config["annotation_path"], F.raise_error(F.lit("annotation_path is needed")))
    parent = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/+[^/]*$", "")).otherwise(".")
    return F.when(F.map_contains_key(config, "data_path"), config).otherwise(F.map_concat(config, F.create_map(F.lit("data_path"), parent)))


def from_file(spark: SparkSession, path: str) -> DataFrame:
    """(pos, config) of a JSON file: an object, a list of them, or an object with such a list under `datasets`."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.datasets", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    each = whole.select(F.posexplode(listed).alias("pos", "x"))
    return each.select(F.col("pos").cast("long").alias("pos"), F.from_json(F.to_json("x"), "map<string,string>").alias("config"))


def resolve_configs(spark: SparkSession, source: str = "", path: str = "") -> DataFrame:
    """(pos, config) from a JSON file, named as path or as source, or from a line of text."""
    if path or source.lower().endswith(".json"):
        return from_file(spark, path or source)
    if not source.strip():
        raise ValueError("a source or a file is needed")
    return from_text(spark, source)


def normal_name(c: Column) -> Column:
    return F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("-"), F.lit("_")))


def base_name(c: Column) -> Column:
    """A name without what it says of the kind of task."""
    return F.regexp_replace(normal_name(c), f"(?:{'|'.join(TASK_TYPES)})$", "")


def pick_config(configs: DataFrame, tag: str, name: str = "", order: str = "pos") -> DataFrame:
    """The one config of this name, or without a name the first whose base is the tag (or tag_subtask_val), else whose name begins with it; no row if there is none."""
    own, norm = normal_name(F.col("dataset_name")), lambda x: x.replace("-", "_").lower()
    if name:
        tier = F.when(own == norm(name), 0)
    else:
        base = base_name(F.col("dataset_name"))
        tier = F.when(base.isin(norm(tag), norm(tag) + "_subtask_val"), 0).when(F.startswith(own, F.lit(norm(tag) + "_")), 1)
    return configs.withColumn("__tier", tier).filter("__tier is not null").orderBy("__tier", order).limit(1).drop("__tier")


def slice_configs(configs: DataFrame, task_type: str = "", tag: str = "") -> DataFrame:
    """Configs of a task type (the whole type, or a name that ends with it) and of a dataset (the tag, or a name that begins with it); an error if none is left."""
    kept = configs
    if task_type:
        kept = kept.filter((F.col("task_type") == task_type) | F.endswith("dataset_name", F.lit("_" + task_type)))
    if tag:
        kept = kept.filter((F.col("dataset_name") == tag) | F.startswith("dataset_name", F.lit(tag + "_")))
    if kept.limit(1).count() == 0:
        raise ValueError(f"no dataset of type {task_type!r} and tag {tag!r}")
    return kept


def with_config(episodes: DataFrame, configs: DataFrame) -> DataFrame:
    """Each episode with its dataset's settings; both have dataset_name. Configs are sent to all tasks if they are few."""
    return episodes.join(small(configs), "dataset_name")
