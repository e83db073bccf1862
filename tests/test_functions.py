"""Scalar functions against hand-computed values, Decimal, and properties."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from spokeline.functions import dims, geo, numfmt


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_haversine_and_bearing(spark):
    r = one(
        spark,
        geo.haversine(F.lit(45.5), F.lit(-122.6), F.lit(45.5), F.lit(-122.6)).alias("zero"),
        geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("degree"),
        geo.bearing(F.lit(45.0), F.lit(-122.0), F.lit(46.0), F.lit(-122.0)).alias("north"),
        geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0)).alias("west"),
    )
    assert r["zero"] == 0
    assert r["degree"] == pytest.approx(6_371_000 * math.pi / 180)
    assert r["north"] == pytest.approx(0)
    assert r["west"] == pytest.approx(-90)


def test_projection_clamps_and_takes_points(spark):
    lit = [F.lit(x) for x in (45.0, -122.0, 45.0, -121.9, 45.0, -121.8)]
    p = one(spark, geo.project(*lit).alias("p"))["p"]
    assert (p["t"], p["lat"], p["lng"]) == (0.0, 45.0, -121.9)
    same = [F.lit(x) for x in (45.0, -122.0, 45.1, -122.0, 45.1, -122.0)]
    assert one(spark, geo.project(*same).alias("p"))["p"]["t"] == 0.0


def test_point_to_line_of_none_and_one(spark):
    empty = F.array().cast("array<struct<lat:double,lng:double>>")
    single = F.array(F.struct(F.lit(45.0).alias("lat"), F.lit(-122.0).alias("lng")))
    r = one(spark, geo.point_to_line(F.lit(45.0), F.lit(-122.0), empty).alias("none"), geo.point_to_line(F.lit(45.0), F.lit(-122.0), single).alias("one"), geo.polyline_length(empty).alias("length"))
    assert r["none"] == math.inf and r["one"] == 0 and r["length"] == 0


def test_crossing_is_proper(spark):
    def cross(*x):
        v = [F.lit(float(a)) for a in x]
        return one(spark, geo.segments_cross((v[0], v[1]), (v[2], v[3]), (v[4], v[5]), (v[6], v[7])).alias("c"))["c"]

    assert cross(0, 0, 1, 1, 0, 1, 1, 0)
    assert not cross(0, 0, 1, 1, 1, 1, 2, 0)  # touches at an end
    assert not cross(0, 0, 2, 2, 1, 1, 3, 3)  # overlaps


def test_to_fixed_is_exact(spark):
    values = [45.43015, -122.66695, 45.5, 9.99995, 100.00005, -45.00004, 12.34565] + [45.43 + i * 1e-5 for i in range(500)]
    got = [r["s"] for r in spark.createDataFrame([(v,) for v in values], "x double").select(numfmt.to_fixed(F.col("x"), 4).alias("s")).collect()]
    assert got == [str(Decimal(v).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for v in values]


def test_rounding_and_quantising_ties_go_up(spark):
    r = one(spark, numfmt.round_half_up(F.lit(-2.5)).alias("a"), numfmt.round_half_up(F.lit(2.5)).alias("b"), geo.quantise(F.lit(-122.666665)).alias("q"))
    assert (r["a"], r["b"]) == (-2, 3)
    assert r["q"] == pytest.approx(math.floor(-122.666665 * 1e5 + 0.5) / 1e5)


@pytest.mark.parametrize(("text", "want"), [("0", 7.0), (None, 7.0), ("12abc", 12.0), ("x", 7.0), (" -3.5e1z", -35.0), ("", 7.0)])
def test_number_or(spark, text, want):
    assert one(spark, numfmt.number_or(F.lit(text).cast("string"), F.lit(7.0)).alias("n"))["n"] == want


def test_texts(spark):
    r = one(
        spark, numfmt.distance_text(F.lit(159.4)).alias("a"), numfmt.distance_text(F.lit(1609.34)).alias("b"), numfmt.nav_distance_text(F.lit(10.0)).alias("c"), numfmt.nav_distance_text(F.lit(100.0)).alias("d"),
        numfmt.duration_text(F.lit(59.0)).alias("e"), numfmt.duration_text(F.lit(3660.0)).alias("f"), numfmt.voice_distance_text(F.lit(29.0)).alias("g"), numfmt.voice_distance_text(F.lit(500.0)).alias("h"),
    )
    assert tuple(r) == ("159 m", "1.0 mi", "Now", "330 ft", "<1 min", "1h 1m", "a few yards", "3 tenths of a mile")


def test_dimensions(spark):
    r = one(
        spark, dims.edge_cost(F.lit(10.0), F.lit("MUP_P")).alias("path"), dims.edge_cost(F.lit(10.0), F.lit("_GAP")).alias("gap"), dims.edge_cost(F.lit(10.0), F.lit("")).alias("other"),
        dims.routing_tier(F.lit("_PREF")).alias("none"), dims.overlay_tier(F.lit(None).cast("string")).alias("caution"), dims.severity_rank(F.lit("unknown")).alias("secondary"),
    )
    assert tuple(r) == (1.5, 80.0, 30.0, None, "caution", 1)
