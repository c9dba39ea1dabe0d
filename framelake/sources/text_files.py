"""Text formats: camera responses, weights and tone-mapping settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_OF_ZERO = -6.0


def numbers(lines: DataFrame, names: list[str]) -> DataFrame:
    """(file, names) of the lines (file, value) that hold that many numbers."""
    parts = F.split(F.trim("value"), r"\s+")
    data = lines.where(~F.trim("value").startswith("#") & (F.length(F.trim("value")) > 0)).select("file", parts.alias("p"))
    return data.where(F.size("p") >= len(names)).select("file", *[F.col("p")[i].cast("double").alias(c) for i, c in enumerate(names)])


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.input_file_name().alias("file"), "value")


def parse_response(lines: DataFrame) -> DataFrame:
    """(file, m, logR, R, logG, G, logB, B) of lines (file, value); a file whose row count is not the one it states fails when it is read."""
    names = ["m", "log_r", "r", "log_g", "g", "log_b", "b"]
    text = F.trim("value")
    parts, number = F.split(text, r"\s+"), F.regexp_extract("value", r"^#\s*rows:\s*(\d+)", 1)
    is_row = ~text.startswith("#") & (F.length(text) > 0) & (F.size(parts) >= len(names))
    own = Window.partitionBy("file")  # some thousand lines at most, read once
    read = lines.select("file", "value", is_row.alias("is_row"), F.when(number != "", number.cast("bigint")).alias("n"))
    read = read.withColumns({"found": F.count_if("is_row").over(own), "stated": F.max("n").over(own)})
    error = F.raise_error(F.lit("row count of the response file differs from its header")).cast("boolean")
    right = F.when(F.coalesce("stated", "found") == F.col("found"), F.lit(True)).otherwise(error)
    return read.where("is_row").where(right).select("file", *[parts[i].cast("double").alias(c) for i, c in enumerate(names)])


def read_response(spark: SparkSession, path: str) -> DataFrame:
    return parse_response(text_lines(spark, path))


def response_text(response: DataFrame, *keys: str) -> DataFrame:
    """(keys, m, line): lines `m logR R logG G logB B` of (keys, m, r, g, b), to be written in the order of m, under their header."""
    log = lambda c: F.when(F.col(c) == 0, LOG_OF_ZERO).otherwise(F.log10(c))
    cells = [F.col("m").cast("string")]
    for c in ("r", "g", "b"):
        cells += [F.format_string("%.6f", log(c)), F.format_string("%.6f", F.col(c))]
    return response.select(*keys, "m", F.concat_ws(" ", *cells).alias("line"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return numbers(text_lines(spark, path), ["weight", "level"])


def weights_text(weights: DataFrame) -> DataFrame:
    """Lines ` weight level` of (level, weight), in the order of the level, under their header."""
    return weights.select("level", F.format_string(" %15.9f %4d", F.col("weight").cast("double"), F.col("level").cast("bigint")).alias("line"))


def read_basis_lut(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(base, i, y) of a table of comma-separated rows: luminance, then k functions of it; i is the row's place by luminance, which is log2(light) in `x`."""
    names = [f"y{b}" for b in range(1, k + 1)]
    table = spark.read.schema(", ".join(f"{n} double" for n in ["light", *names])).csv(path)
    return basis_rows(table, k)


def basis_rows(table: DataFrame, k: int) -> DataFrame:
    """(base, i, x, y) of (light, y1, ..., yk)."""
    place = F.row_number().over(Window.orderBy("light")) - 1  # some dozens of rows
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(f"y{b}").alias("y")) for b in range(1, k + 1)]))
    return table.withColumn("i", place).select("i", F.log2("light").alias("x"), each.alias("e")).select("e.base", "i", "x", "e.y")


# What RANGE means by tone mapper.
RANGE_OF = {"Durand02": "durand_range", "Reinhard02": "reinhard_range"}


def parse_settings(lines: DataFrame) -> DataFrame:
    """(file, version, tmo, numbers, switches, texts) of lines (file, i, value): KEY=VALUE, # starts a comment, the last of equal keys holds.

    Values that are numbers are doubles, YES and NO switches, others texts. RANGE is renamed by the file's tone mapper.
    """
    kept = lines.select("file", "i", F.trim(F.substring_index("value", "#", 1)).alias("v"))
    pairs = kept.where(F.col("v").contains("=")).select("file", "i", F.upper(F.trim(F.substring_index("v", "=", 1))).alias("k"), F.expr("trim(substring(v, instr(v, '=') + 1))").alias("x"))
    last = pairs.groupBy("file", "k").agg(F.max_by("x", "i").alias("x"))
    heads = last.groupBy("file").agg(F.max(F.when(F.col("k") == "VERSION", F.col("x"))).alias("version"), F.max(F.when(F.col("k") == "TMO", F.col("x"))).alias("tmo"))
    at = last.join(heads, "file").where(~F.col("k").isin("VERSION", "TMO"))
    renamed = F.lower("k")
    for tmo, name in RANGE_OF.items():
        renamed = F.when((F.col("k") == "RANGE") & (F.col("tmo") == tmo), name).otherwise(renamed)
    switch, number = F.upper("x").isin("YES", "NO"), F.expr("try_cast(x as double)")
    at = at.select("file", "version", "tmo", renamed.alias("k"), "x", switch.alias("is_switch"), number.alias("number"))
    entries = lambda cond, value: F.map_from_entries(F.array_sort(F.array_compact(F.collect_list(F.when(cond, F.struct("k", value.alias("v")))))))
    is_number = ~F.col("is_switch") & F.col("number").isNotNull()
    return at.groupBy("file", "version", "tmo").agg(
        entries(is_number, F.col("number")).alias("numbers"), entries(F.col("is_switch"), F.upper("x") == "YES").alias("switches"),
        entries(~F.col("is_switch") & F.col("number").isNull(), F.col("x")).alias("texts"),
    )


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    return parse_settings(text_lines(spark, path).withColumn("i", F.monotonically_increasing_id()))
