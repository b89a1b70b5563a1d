"""Dates of free text: the sources' own shapes, and what is none."""

import pytest
from gleaner.functions.date_grammar import free_dates, read_dates
from pyspark.sql import functions as F

ASOF = "2024-01-15 12:00:00"
SHAPES = {
    "2024-08-01, 09:00–13:00": ["2024-08-01 09:00"],
    "2024-08-01–2024-08-03, 09:00–13:00": ["2024-08-01 09:00", "2024-08-03 09:00"],
    "Saturday, August 3 at 7:30 PM - 10:00 PM": ["2024-08-03 19:30"],
    "Saturday, August 3  •  7:30pm - 10pm": ["2024-08-03 19:30"],
    "Starts on Saturday, August 3 at 7:30 PM": ["2024-08-03 19:30"],
    "Sat, Aug 3 - Sun, Aug 4  •  7:30pm - 10pm": ["2024-08-03 19:30", "2024-08-04 19:30"],
    "Sat 3 Aug 2024, 6:30PM": ["2024-08-03 18:30"],
    "Sat 3 Aug, 6:30PM - Sun 4 Aug, 10PM 2025": ["2025-08-03 18:30", "2025-08-04 22:00"],
    "Sat, 03 Aug, 2024 at 07:30 pm - Sun, 04 Aug, 2024 at 09:30 pm (NZST)": ["2024-08-03 19:30", "2024-08-04 21:30"],
    "Sat, Aug 03, 2024 • 7:30 PM (NZST)": ["2024-08-03 19:30"],
    "Sat 3 Aug 2024 - Sun 4 Aug 2024": ["2024-08-03 01:01", "2024-08-04 01:01"],
    "3 Aug 2024, 8:00 PM": ["2024-08-03 20:00"],
    "1-3 Feb": ["2024-02-01 01:01", "2024-02-03 01:01"],
    "28 Jan-3 Feb": ["2024-01-28 01:01", "2024-02-03 01:01"],
    "Today | 3 Aug": ["2024-08-03 01:01"],
    "28 Dec - 3 Jan 2025": ["2024-12-28 01:01", "2025-01-03 01:01"],
    "March 5-7, 10am": ["2024-03-05 10:00", "2024-03-07 10:00"],
    "August 2024 3 7.30 pm": ["2024-08-03 19:30"],
    "3rd of August": ["2024-08-03 01:01"],
    "doors 7-9, room 12, 30 Feb 2024, mayor 3": [],
    "12:30": [],
    "": [],
}


def told(spark, text, **how):
    found = free_dates(F.lit(text), F.lit(ASOF).cast("timestamp"), **how)
    stamps = F.transform(found, lambda d: F.date_format(d, "yyyy-MM-dd HH:mm"))
    return spark.range(1).select(stamps).first()[0]


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(t,) for t in SHAPES], "t string")
    stamps = F.transform(free_dates(F.col("t"), F.lit(ASOF).cast("timestamp")), lambda d: F.date_format(d, "yyyy-MM-dd HH:mm"))
    return {r[0]: r[1] for r in df.select("t", stamps).collect()}


@pytest.mark.parametrize("text", list(SHAPES))
def test_shapes(read, text):
    assert read[text] == SHAPES[text]


def test_ranges_zones_and_halves(spark):
    assert told(spark, "28 Jan-30 Jan 7:00", daily=True) == ["2024-01-28 07:00", "2024-01-29 07:00", "2024-01-30 07:00"]
    assert told(spark, "28 Jan 7:30pm", halves=False) == ["2024-01-28 07:30"]
    assert told(spark, "Sat, Aug 03, 2024 • 7:30 PM (NZST)", tag="nzst") == ["2024-08-04 05:30"]
    assert told(spark, "Sat, 03 Aug, 2024 at 7:30 pm - Sun, 04 Aug, 2024 at 9:30 pm (NZST)", tag="nzst") == ["2024-08-03 19:30", "2024-08-05 07:30"]
    assert told(spark, "3 Aug 2022", bump=True) == ["2024-08-03 01:01"]
    assert told(spark, "3 Aug 2024", clocked=True) == []
    assert told(spark, None) == []


def test_fields_of_dates(spark):
    rows = spark.range(1).select(read_dates(F.lit("3 Aug to 5 Aug 2024"), F.lit(2020))).first()[0]
    assert [(r["clock"], r["linked"]) for r in rows] == [(False, True), (False, False)]
