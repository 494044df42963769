"""Sizes beyond the sample's, and routes that stand still."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from atlasframe import catalog
from atlasframe.functions import calendar, text


def test_a_route_without_length_holds_no_position(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, k, 5, 7, 1.0, 10.0, "N", "O", at) for k in (1, 2)] + [(2, 1, 5, 7, 1.0, 10.0, "N", "O", at), (2, 2, 5, 7, 1.0, 10.0, "N", "O", at), (2, 3, 6, 7, 1.0, 10.0, "N", "O", at)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {(x.route, x.key): x.distance for x in catalog.QUERIES["j16_matched_positions"](spark, str(tmp_path)).collect()}
    assert found[1, 0] is None and found[2, 0] == 0.0


def test_sizes_stop_at_the_largest_unit(spark, tmp_path):
    n = spark.createDataFrame([(2**30,), (2**40,), (1536,)], "n long")
    assert [tuple(r) for r in n.select(text.byte_size(F.col("n")), text.byte_size(F.col("n"), "MiB")).collect()] == [("1.0 GiB", "1024.0 MiB"), ("1.0 TiB", "1048576.0 MiB"), ("1.5 KiB", "1.5 KiB")]
    spark.createDataFrame([(1_076_972, "a b")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert catalog.QUERIES["y6_formats"](spark, str(tmp_path)).first()["bytes"] == "1024.0 MiB"


def test_opening_hours_of_thousands_of_texts_take_seconds(spark):
    import time

    hours = F.concat(F.lit("Mo-Fr 08:00-18:00,19:00-2"), F.col("id") % 4, F.lit(":00; Sa off; Su 10:00-12:00"))
    rows = spark.range(0, 4000, 1, 1).withColumn("hours", calendar.opening_hours(hours))
    began = time.time()
    assert rows.where(F.size("hours") == 7).count() == 4000
    assert time.time() - began < 30


def test_innermost_points_of_a_thousand_rings_take_a_second_or_two():
    import time

    import numpy as np

    from atlasframe.functions import shapes

    house = np.array([(-1, -1), (-1, 1), (1, 1), (1.5, 0), (1, -1)]) * 0.02
    rings = [house + (k % 40, k % 70) for k in range(1000)] + [np.array([(0.0, 0.0), (0.0, 4.0), (2.0, 4.0), (2.0, 0.0)])]
    began = time.time()
    found = shapes.innermost_points(rings, 1e-4)
    assert time.time() - began < 15
    assert np.allclose(found[:1000] - [(k % 40, k % 70) for k in range(1000)], found[0], atol=2e-4) and abs(found[-1][0] - 1) < 1e-3
