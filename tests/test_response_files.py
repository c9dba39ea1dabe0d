"""Response files are written and read in one pass over what they are made of, and checked file by file."""

import pytest
from conftest import SF

from framelake.plans import catalogue
from framelake.sources import text_files

HEAD = [("a", "# rows: 2"), ("a", "0 -6.0 0 -6.0 0 -6.0 0"), ("a", " 1 0.0 1 0.0 1 0.0 1 "), ("a", "# end"), ("b", "5 1 2 3 4 5 6"), ("c", "# rows: 4")]


def test_one_pass(spark):
    """The lines are neither made nor shuffled again for the header, the cells or the check, and no join brings a whole table to one of 256 values."""
    text = catalogue.QUERIES["response_file"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == text.count("Scan parquet") == 1 or text.count("FileScan") == 1
    assert "Join" not in "".join(line for line in text.splitlines() if "Cartesian" not in line and "BroadcastNestedLoop" not in line)


def test_counts_by_file(spark):
    lines = spark.createDataFrame(HEAD, "file string, value string")
    got = sorted((r["file"], r["m"], r["b"]) for r in text_files.parse_response(lines).collect())
    assert got == [("a", 0.0, 0.0), ("a", 1.0, 1.0), ("b", 5.0, 6.0)]
    with pytest.raises(Exception, match="row count"):
        text_files.parse_response(spark.createDataFrame([*HEAD, ("a", "2 0 0 0 0 0 0")], "file string, value string")).collect()
