"""The point-in-time table against its SQL twin, in many small slices, and on odd rows."""

import datetime

import duckdb
import pytest
from gleaner.llm import asof
from gleaner.llm.sql import SQL
from pyspark.sql import functions as F

TABLES = ("sales", "clicks", "sale_lines")


def told(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def agree(spark, frames, **how):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toArrow())
    cur = con.execute(SQL["op11_point_in_time"])
    want = told(cur.fetchall(), [d[0] for d in cur.description])
    df = asof.feature_table(frames["sales"], frames["clicks"], frames["sale_lines"], **how)
    got = told([tuple(r) for r in df.collect()], df.columns)
    assert got == want
    return got


@pytest.mark.parametrize("slice_rows", [asof.SLICE_ROWS, 300])
def test_whole_tables(spark, sf_dir, slice_rows):
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    assert agree(spark, frames, slice_rows=slice_rows)


def day(x):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=x)


SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, extra string"
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def odd(spark):
    sales = [(i, 7, "done", 10.005, day(i / 3), day(i / 3 + (i % 4)), 1, "x") for i in range(60)]
    sales += [(i, 7, "done", None, day(3), day(3), 1, None) for i in range(60, 75)]  # one moment
    sales += [(100, None, "done", 1.0, day(2), day(2), 1, None), (101, 7, "done", 1.0, None, day(2), 1, None), (102, 8, None, -3.14, day(5), None, None, None), (103, 9, "x", float("nan"), day(5), day(4), 0, "y")]
    sales += [(104, 9, "x", 5.0, day(40), day(1), 0, "y")] * 2  # the same row twice
    clicks = [(i, day(i / 10), day(i / 10 + (20 if i % 7 == 0 else 0)), 7, ("purchase", "view", None)[i % 3], i / 3, "{}") for i in range(200)]
    clicks += clicks[:50] + [(None, day(6), day(6), 7, "purchase", 1.0, None), (500, None, day(1), 7, "view", 1.0, None), (501, day(1), None, 7, "view", 1.0, None), (502, day(4.9), day(4.9), 9, "view", None, None)]
    lines = [(i % 75, i, i % 5, 1, 1, i * 1.005, 0.0, "a", day((i % 75) / 3 + i % 9)) for i in range(400)]
    lines += lines[:40] + [(3, 1, None, 1, 1, 2.0, 0.0, "a", day(1)), (3, 1, 2, 1, 1, None, 0.0, "a", day(1)), (3, 1, 2, 1, 1, 1.0, 0.0, "a", None), (None, 1, 2, 1, 1, 1.0, 0.0, "a", day(1)), (104, 1, 2, 1, 1, 1.0, 0.0, "a", day(1)), (103, 2, 2, 1, 1, float("nan"), 0.0, "a", day(5))]
    return {"sales": spark.createDataFrame(sales, SALES), "clicks": spark.createDataFrame(clicks, CLICKS), "sale_lines": spark.createDataFrame(lines, LINES)}


@pytest.mark.parametrize("slice_rows", [10_000, 40])
def test_odd_rows(spark, slice_rows):
    got = agree(spark, odd(spark), slice_rows=slice_rows)
    assert len(got) == 2 * (75 + 2 + 2)


@pytest.mark.parametrize("gone", [("clicks",), ("sale_lines",), ("sales",), TABLES])
def test_empty_tables(spark, gone):
    frames = odd(spark)
    agree(spark, frames | {t: frames[t].limit(0) for t in gone})


def test_a_sale_with_most_lines_is_spread(spark):
    many = spark.range(5000).select(F.when(F.col("id") % 2 == 0, 3).otherwise(F.col("id")).alias("k"), "id")
    one = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert asof.heavy_keys(many, "k") == [3]
    got = asof.spread_join(many, one, "k", F.xxhash64("id"))
    assert got.count() == 5000 and got.agg(F.sum("v")).first()[0] == many.join(one, "k").agg(F.sum("v")).first()[0]


def test_times_without_a_zone_ignore_the_session(spark):
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.000001' AS t, TIMESTAMP_NTZ'1969-12-31 23:59:59.5' AS u")
        assert tuple(df.select(asof.micros(df, "t"), asof.micros(df, "u")).first()) == (1710037800000001, -500000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
