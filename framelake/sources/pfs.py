"""The native float container: header, channel names and raw planes of 32-bit floats."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

CHANNELS = ("X", "Y", "Z")


def encode(width: int, height: int, planes: dict[str, np.ndarray], tags: dict[str, str] | None = None) -> bytes:
    """Bytes of a frame: magic, size, channel count, tags, channels with theirs, ENDH, planes in order."""
    pairs = [f"{k}={v}" for k, v in (tags or {}).items()]
    head = ["PFS1", f"{width} {height}", str(len(planes)), str(len(pairs)), *pairs]
    for name in planes:
        head += [name, "0"]
    return ("\n".join(head) + "\nENDH").encode() + b"".join(np.asarray(p, "<f4").tobytes() for p in planes.values())


def decode(content: bytes) -> tuple[int, int, dict[str, np.ndarray], dict[str, str]]:
    at = 0

    def line() -> str:
        nonlocal at
        end = content.index(b"\n", at)
        text, at = content[at:end].decode(), end + 1
        return text

    if line() != "PFS1":
        raise ValueError("no frame container: wrong magic")
    width, height = map(int, line().split())
    count = int(line())
    tags = dict(line().split("=", 1) for _ in range(int(line())))
    names = []
    for _ in range(count):
        names.append(line())
        for _ in range(int(line())):
            line()
    if content[at : at + 4] != b"ENDH":
        raise ValueError("no frame container: header does not end")
    planes = np.frombuffer(content, "<f4", width * height * count, at + 4).reshape(count, height, width)
    return width, height, dict(zip(names, planes, strict=True)), tags


def read_pfs(spark: SparkSession, glob: str) -> DataFrame:
    """(path, x, y, r, g, b, error) of all files; a broken one is a row with its error."""
    return pixels_of(spark.read.format("binaryFile").load(glob).select("path", "content"))


def pixels_of(files: DataFrame) -> DataFrame:
    """The same of (path, content)."""

    def rows(batches: Iterator):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    width, height, planes, _ = decode(content)
                    y, x = np.divmod(np.arange(width * height), width)
                    yield pd.DataFrame({"path": path, "x": x, "y": y, **{c: planes[n].ravel().astype(float) for c, n in zip("rgb", CHANNELS, strict=True)}, "error": None})
                except (ValueError, KeyError) as e:
                    yield pd.DataFrame({"path": [path], "x": [None], "y": [None], "r": [None], "g": [None], "b": [None], "error": [str(e)]})

    return files.mapInPandas(rows, "path string, x int, y int, r double, g double, b double, error string")


def to_pfs_bytes(pixels: DataFrame) -> DataFrame:
    """(frame_id, content): a container for each frame; a frame is the unit of a file and so of a task."""

    def pack(frame):
        import pandas as pd

        frame = frame.sort_values(["y", "x"])
        width, height = int(frame["x"].max()) + 1, int(frame["y"].max()) + 1
        planes = {n: frame[c].to_numpy() for c, n in zip("rgb", CHANNELS, strict=True)}
        return pd.DataFrame({"frame_id": [frame["frame_id"].iat[0]], "content": [encode(width, height, planes)]})

    return pixels.groupBy("frame_id").applyInPandas(pack, "frame_id bigint, content binary")


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, x, y, r, g, b) of a folder of <frame_id>.pfs, as other formats give them. A broken file fails the job; read_pfs tells it in a row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfs").load(path).select("path", "content")
    told = F.raise_error(F.concat("path", F.lit(": "), "error"))
    rows = pixels_of(files).withColumn("frame_id", F.when(F.col("error").isNotNull(), told.cast("string")).otherwise(F.regexp_extract("path", r"([^/]*)\.pfs$", 1)))
    return rows.select(F.col("frame_id").cast("bigint").alias("frame_id"), "x", "y", "r", "g", "b")


def write_pixels(df: DataFrame, path: str) -> None:
    """A folder of <frame_id>.pfs. Files appear whole and together, when all tasks are done."""
    df.sparkSession.dataSource.register(FrameContainers)
    to_pfs_bytes(df).write.format(FrameContainers.name()).mode("append").save(path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FrameContainers(DataSource):
    """Sink of (frame_id, content): a file a frame in a new folder."""

    @classmethod
    def name(cls) -> str:
        return "frame_containers"

    def schema(self) -> str:
        return "frame_id bigint, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FrameContainerWriter(self.options["path"])


class FrameContainerWriter(DataSourceWriter):
    """Tasks write under _temporary; the commit moves the files of the tasks that count. Files of lost or repeated tasks go with the folder."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex
        system, at = self.system()
        if system.get_file_info(at).type != fs.FileType.NotFound:
            raise ValueError(f"{path} exists already")

    def system(self) -> tuple[fs.FileSystem, str]:
        system, at = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system, at.rstrip("/")

    def write(self, rows: Iterator) -> Written:
        system, at = self.system()
        folder, files = f"{at}/_temporary/{self.job}", []
        system.create_dir(folder)
        for row in rows:
            place = f"{folder}/{uuid.uuid4().hex}"
            with system.open_output_stream(place) as out:
                out.write(bytes(row["content"]))
            files.append((place, f"{at}/{row['frame_id']}.pfs"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = self.system()
        system.create_dir(at)
        for message in messages:
            for place, final in message.files if message else ():
                system.move(place, final)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, at = self.system()
        if system.get_file_info(f"{at}/_temporary").type != fs.FileType.NotFound:
            system.delete_dir(f"{at}/_temporary")
