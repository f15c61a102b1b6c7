import math

import pytest
from pyspark.sql import functions as F

from tessarea.functions import (
    GDA94_AUSTRALIA_LAMBERT,
    censored,
    code_number,
    code_text,
    first_present,
    is_missing,
    is_present,
    log_positive,
    normal_upper_tail,
    ratio,
    round_half_even,
    zero_replaced,
)

NAN = float("nan")


def one(spark, column, schema="x double", row=(None,)):
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()[0]


@pytest.mark.parametrize("value, missing", [(None, True), (NAN, True), (0.0, False), (1.5, False)])
def test_missing_means_null_or_nan(spark, value, missing):
    assert one(spark, is_missing(F.col("x")), row=(value,)) is missing
    assert one(spark, is_present(F.col("x")), row=(value,)) is not missing


@pytest.mark.parametrize("value, want", [(0.5, 0.0), (1.5, 2.0), (2.5, 2.0), (-0.5, 0.0), (2.51, 3.0)])
def test_rounding_is_half_to_even(spark, value, want):
    assert one(spark, round_half_even(F.col("x")), row=(value,)) == want


def test_ratio_of_zero_is_null(spark):
    assert one(spark, ratio(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, ratio(F.lit(3), F.lit(2))) == 1.5


def test_codes(spark):
    assert one(spark, code_number(F.lit(" 30002180000 "))) == 30002180000
    assert one(spark, code_number(F.lit("abc"))) is None
    assert one(spark, code_text(F.lit(30002180000.0))) == "30002180000"


def test_zero_log_and_scale(spark):
    assert one(spark, zero_replaced(F.lit(0.0), 0.001)) == 0.001
    assert one(spark, zero_replaced(F.lit(2.0), 0.001)) == 2.0
    assert one(spark, log_positive(F.lit(0.0))) is None
    assert one(spark, censored(F.lit(1.7), 0.0, 1.6)) is None
    assert one(spark, censored(F.lit(1.6), 0.0, 1.6)) == 1.6
    assert one(spark, first_present(F.lit(NAN), F.lit(2.0))) == 2.0


@pytest.mark.parametrize("z", [-3.0, -1.0, 0.0, 0.5, 1.96, 4.0])
def test_normal_tail(spark, z):
    want = 0.5 * math.erfc(z / math.sqrt(2))
    assert abs(one(spark, normal_upper_tail(F.lit(z))) - want) < 1e-7


def test_lambert_origin_and_symmetry(spark):
    p = GDA94_AUSTRALIA_LAMBERT
    east, north = p.project(F.lit(134.0), F.lit(0.0))
    assert abs(one(spark, east)) < 1e-6
    assert abs(one(spark, north)) < 1e-6
    west, _ = p.project(F.lit(130.0), F.lit(-25.0))
    east, _ = p.project(F.lit(138.0), F.lit(-25.0))
    assert one(spark, west) == pytest.approx(-one(spark, east))


def test_lambert_keeps_scale_on_standard_parallels(spark):
    """A short step along a standard parallel has its true length on the ellipsoid."""
    p = GDA94_AUSTRALIA_LAMBERT
    for lat in (p.parallel_1, p.parallel_2):
        step = 0.001
        e1, n1 = (one(spark, c) for c in p.project(F.lit(140.0), F.lit(lat)))
        e2, n2 = (one(spark, c) for c in p.project(F.lit(140.0 + step), F.lit(lat)))
        phi = math.radians(lat)
        radius = p.semi_major * math.cos(phi) / math.sqrt(1 - (p.eccentricity * math.sin(phi)) ** 2)
        assert math.hypot(e2 - e1, n2 - n1) == pytest.approx(radius * math.radians(step), rel=1e-6)
