"""Frames of stored videos as a table function: a file is opened where its frames are asked for, and read up to the last of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "path string, frame_index long, width int, height int, pixels binary"


def stored_frames(file: BinaryIO) -> Iterator[np.ndarray]:
    """The frames of a NumPy file (n, height, width, 3) of bytes, read one after the other."""
    version = np.lib.format.read_magic(file)
    shape, order, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if order or kind != np.uint8 or len(shape) != 4 or shape[3] != 3:
        raise ValueError(f"no frames: {shape} of {kind}")
    size = int(np.prod(shape[1:]))
    for _ in range(shape[0]):
        yield np.frombuffer(file.read(size), "u1").reshape(shape[1:])


def frame_reader(decoder: Callable[[BinaryIO], Iterator[np.ndarray]] = stored_frames, opens: Callable[[str], BinaryIO] | None = None) -> type:
    """A table function's class for rows (path, frame_index) partitioned by path: PIXELS of the frames that are asked for, each once, in order.

    decoder: gives a file's frames in order; it is left at the last asked frame. Frames that a video hasn't, negative or null ones, give no row.
    """

    class Frames:
        def __init__(self) -> None:
            self.path, self.asked = None, set()

        def eval(self, row) -> None:
            self.path = row["path"]
            if row["frame_index"] is not None and row["frame_index"] >= 0:
                self.asked.add(row["frame_index"])

        def terminate(self) -> Iterator[tuple]:
            if self.path is None or not self.asked:
                return
            last = max(self.asked)
            with (opens or open_stored)(self.path) as file:
                for i, frame in enumerate(decoder(file)):
                    if i in self.asked:
                        yield self.path, i, frame.shape[1], frame.shape[0], np.ascontiguousarray(frame).tobytes()
                    if i >= last:
                        return

    return Frames


def open_stored(path: str) -> BinaryIO:
    from spanforge.sources.episodes import _open

    store, at = _open(path)
    return store.open_input_file(at)


def decode(asked: DataFrame, decoder: Callable[[BinaryIO], Iterator[np.ndarray]] = stored_frames) -> DataFrame:
    """PIXELS of asked (path, frame_index). A path's requests meet in one task, which opens its file once; nothing else of any file moves."""
    reader = F.udtf(frame_reader(decoder), returnType=PIXELS)
    return reader(asked.select("path", F.col("frame_index").cast("long").alias("frame_index")).asTable().partitionBy("path"))


def write_videos(frames: DataFrame, root: str) -> DataFrame:
    """(path, frames) of NumPy files, one for each video of frames (video, frame_index, width, height, pixels) in order of frame_index; videos are of bounded length."""
    import pandas as pd

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        from spanforge.sources.episodes import _open

        rows = rows.sort_values("frame_index")
        held = np.stack([np.frombuffer(p, "u1").reshape(h, w, 3) for p, w, h in zip(rows["pixels"], rows["width"], rows["height"], strict=True)])
        path = f"{root}/video-{key[0]}.npy"
        store, at = _open(path)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(at) as out:
            np.lib.format.write_array(out, held, allow_pickle=False)
        return pd.DataFrame({"video": [key[0]], "path": [path], "frames": [len(held)]})

    return frames.groupBy("video").applyInPandas(write, "video long, path string, frames long")


def videos(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the videos in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(root).select("path")
