"""Frames in files: the format follows the extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder  # noqa: F401
from . import pfs


def extension(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2].rpartition(".")[2].lower()


READERS = {
    "parquet": lambda spark, path: spark.read.parquet(path), "orc": lambda spark, path: spark.read.orc(path), "json": lambda spark, path: spark.read.schema(PIXELS).json(path),
    "csv": lambda spark, path: spark.read.schema(PIXELS).csv(path, header=True), "pfs": pfs.read_pixels,
}
WRITERS = {
    "parquet": lambda df, path: df.write.parquet(path), "orc": lambda df, path: df.write.orc(path), "json": lambda df, path: df.write.json(path), "csv": lambda df, path: df.write.csv(path, header=True),
    "pfs": pfs.write_pixels,
}
PIXELS = "frame_id bigint, x int, y int, r double, g double, b double"


def known(formats: dict, path: str):
    try:
        return formats[extension(path)]
    except KeyError:
        raise ValueError(f"unknown format of frames {extension(path)!r}; known: {', '.join(sorted(formats))}") from None


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of a path by its extension; an unknown one is an error."""
    return known(READERS, path)(spark, path)


def write_pixels(df: DataFrame, path: str) -> None:
    """Write pixels by the path's extension. Rows stay where they are: a frame may lie in several files."""
    known(WRITERS, path)(df, path)


def as_floats(df: DataFrame, columns=("r", "g", "b")) -> DataFrame:
    """Samples as a container of 32-bit floats gives them back."""
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})
