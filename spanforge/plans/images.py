"""Queries on images: embeddings drawn as 8 x 8 pixels, 100 to a video."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions.images import features_of
from spanforge.operators import decode as dc
from spanforge.operators import features as ft
from spanforge.plans.registry import query
from spanforge.sinks.writers import scratch
from spanforge.sources import proxies as px

SIZE = 8


def _drawn(spark, d):
    """(video, frame_index, width, height, pixels): value v of each place as red and green, 255 - v as blue."""
    e = px.table(spark, d, "embeddings")
    v = F.transform("embedding", lambda x: F.pmod(F.floor(F.abs(x.cast("double")) * 997), F.lit(256)).cast("int"))
    rgb = F.flatten(F.transform(v, lambda x: F.array(x, x, 255 - x)))
    pixels = F.unhex(F.array_join(F.transform(rgb, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return e.select(F.floor(F.col("vec_id") / 100).alias("video"), F.pmod("vec_id", F.lit(100)).alias("frame_index"), F.lit(SIZE).alias("width"), F.lit(SIZE).alias("height"), pixels.alias("pixels"))


DRAWN = "with v as (select vec_id // 100 as video, vec_id % 100 as frame_index, list_transform(embedding, lambda x: cast(floor(abs(x::double) * 997) as bigint) % 256) as v from embeddings),\n"


@query("s_decode_frames", DRAWN + """o as (select video, frame_index from v where frame_index % 7 = 3 and frame_index < 80)
select video, frame_index, 8::bigint as width, 8::bigint as height, list_aggregate(list_transform(v, lambda x: printf('%02X%02X%02X', x, x, 255 - x)), 'string_agg', '') as pixels from v join o using (video, frame_index)""", views=False)
def decode_frames(spark, d):
    root = scratch(spark, "videos")
    made = dc.write_videos(_drawn(spark, d), root)
    asked = made.select("path", F.explode(F.sequence(F.lit(3), F.lit(79), F.lit(7))).alias("frame_index"))
    asked.write.parquet(f"{root}-asked")
    found = dc.decode(spark.read.schema(asked.schema).parquet(f"{root}-asked"))
    video = F.regexp_extract("path", r"video-(-?\d+)\.npy$", 1).cast("long")
    return found.select(video.alias("video"), "frame_index", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.hex("pixels").alias("pixels"))


@query("a_image_features", DRAWN + """p as (select video, frame_index, unnest(v) as x, generate_subscripts(v, 1) - 1 as i from v),
c as (select video, frame_index, (i // 16) * 4 + (i % 8) // 2 as cell, avg(x) / 255 as rg, avg(255 - x) / 255 as b from p group by all),
h as (select video, frame_index, least(9, (772 * x + 29070) // 25500) as part, count(*) / 64.0::double as n from p group by all),
m as (select video, frame_index, avg(x) / 255 as rg_mean, avg(255 - x) / 255 as b_mean, stddev_pop(x) / 255 as deviation from p group by all),
f as (select video, frame_index, 3 * cell as place, rg as x from c union all select video, frame_index, 3 * cell + 1, rg from c union all select video, frame_index, 3 * cell + 2, b from c
    union all select g.video, g.frame_index, 57 + k, coalesce(n, 0) from (select video, frame_index, unnest(range(10)) as k from v) g left join h on (h.video, h.frame_index, h.part) = (g.video, g.frame_index, g.k)
    union all select video, frame_index, 48 + unnest([0, 1, 2, 3, 4, 5]), unnest([rg_mean, rg_mean, b_mean, deviation, deviation, deviation]) from m
    union all select video, frame_index, 54 + unnest([0, 1, 2]), unnest([avg(x) / 255, avg(x) / 255, avg(255 - x) / 255]) from p where i // 8 between 2 and 5 and i % 8 between 2 and 5 group by video, frame_index)
select video, frame_index, cast(place as bigint) as place, round(x, 6) as x from f""", views=False)
def image_features(spark, d):
    f = _drawn(spark, d).select("video", "frame_index", features_of(F.col("pixels"), F.col("width"), F.col("height"), (SIZE, SIZE)).alias("f"))
    return f.select("video", "frame_index", F.posexplode(F.slice("f", 1, 67)).alias("place", "x")).select("video", "frame_index", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query("w_visual_motion", DRAWN + """g as (select video, frame_index, list_transform(v, lambda x: round_even((772 * x + 29070) / 1000.0, 0)) as g from v),
d as (select video, frame_index, g, lag(g) over (partition by video order by frame_index) as b from g)
select video, frame_index, round(coalesce(list_avg(list_transform(range(1, 65), lambda i: abs(g[i] - b[i]))), 0), 6) as motion from d""", views=False)
def visual_motion(spark, d):
    rows = _drawn(spark, d).withColumnRenamed("video", "episode_index").withColumn("camera", F.lit("head"))
    found = ft.visual_motion(rows, ["head"], ft.Settings(smooth=1, size=(SIZE, SIZE)))
    return found.select(F.col("episode_index").alias("video"), "frame_index", F.round("visual_motion", 6).alias("motion"))
