import pytest
from pyspark.sql import functions as F

from loomline.functions import json as JS
from loomline.functions import text as T


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col.alias("y")).first()[0]


@pytest.mark.parametrize(
    ("column", "value", "expected"),
    [
        (lambda: T.squash("x"), "  Red Ring ", "redring"),
        (lambda: T.alnum_key("x"), " Ab-ç_9! ", "abç9"),
        (lambda: T.az_key("x"), "A1-b", "ab"),
        (lambda: T.upper_camel("x"), "red RING's 2nd", "RedRingS2nd"),
        (lambda: T.upper_camel("x", keep_case=True), "red RING", "RedRING"),
        (lambda: T.prettify("x"), "red_ring-two", "Red Ring Two"),
        (lambda: T.prettify("x"), "redRing", "RedRing"),
        (lambda: T.without_prefix("x", "phantom:"), "phantom:a", "a"),
        (lambda: T.first_int("x"), "Lv. 17/20", 17),
        (lambda: T.first_int("x"), "none", None),
        (lambda: T.comma_int("x"), "1,234 pcs", 1234),
        (lambda: T.digits_or_zero("x"), "a1b2", 12),
        (lambda: T.digits_or_zero("x"), "", 0),
        (lambda: T.capped_level("x"), "+31", 25),
        (lambda: T.captured_name("x"), "Equipped By  Ann", "Ann"),
        (lambda: T.captured_name("x"), "nobody", None),
        (lambda: T.asset_path("x", "/UI/", ".png"), "/Game/UI/a/b.uasset", "a/b.png"),
        (lambda: T.list_index("x", ["20", "40", "50"]), "40", 1),
        (lambda: T.list_index("x", ["20", "40", "50"]), "41", 0),
        (lambda: T.safe_relative_path("x"), "a/../b.png", False),
        (lambda: T.safe_relative_path("x"), "a/b.png", True),
        (lambda: T.safe_relative_path("x"), None, False),
        (lambda: T.export_int("x", 0), "-3", 0),
        (lambda: T.viewer_int("x"), "-3", -3),
        (lambda: T.viewer_int("x"), "true", 1),
        (lambda: T.viewer_int("x"), "1.5", None),
        (lambda: T.loose_number("x"), "about -3.5%", -3.5),
        (lambda: T.loose_number("x"), "true", None),
        (lambda: JS.path_get(F.col("x"), "a[1].b"), '{"a":[0,{"b":"z"}]}', "z"),
        (lambda: JS.path_get(F.col("x"), "c"), '{"a":1}', None),
        (lambda: JS.section(F.col("x"), "s"), '{"s":{"a":1}}', '{"a":1}'),
        (lambda: JS.section(F.col("x"), "s"), '{"a":1}', '{"a":1}'),
    ],
)
def test_text(spark, column, value, expected):
    assert one(spark, column(), value) == expected


def test_stat_value(spark):
    rows = spark.createDataFrame([("22.0%",), ("150",), ("%66",), ("NaN",), (None,)], "x string").select(T.stat_value("x").alias("s")).collect()
    assert [(r.s.num, r.s.is_pct) for r in rows] == [(22.0, True), (150.0, False), (None, False), (None, False), (None, False)]


def test_int_pair_and_label(spark):
    r = spark.createDataFrame([("12 / 90",), ("x",)], "x string").select(T.int_pair("x").alias("p"), T.label_parts(F.lit("Main: crit rate 6%")).alias("l")).collect()
    assert tuple(r[0].p) == (12, 90) and r[1].p is None
    assert tuple(r[0].l) == ("crit rate", "6%")


def test_path_over_list(spark):
    r = spark.createDataFrame([('{"a":[{"k":1},{"j":2},{"k":3}]}',)], "x string").select(JS.path_map(F.col("x"), "a", "k").alias("y")).first()
    assert r.y == ["1", None, "3"]
    assert JS.path_parts("a.b[2].c") == ["a", "b", 2, "c"]
