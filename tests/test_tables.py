"""Frames, hierarchies, concordance, deprivation scores and artefacts."""

import math

import pytest
from pyspark.sql import functions as F

from tessarea.operators import concordance as cc
from tessarea.operators import deprivation as dep
from tessarea.operators import frame as fr
from tessarea.operators import hierarchy as hi
from tessarea.operators import maplayer as ml
from tessarea.session import scratch_path
from tessarea.sources import (
    attributes,
    literal_table,
    read_fit,
    read_layer,
    read_table,
    write_fit,
    write_layer,
    write_text_table,
)

NAN = float("nan")
SQUARE = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]


def test_codes_and_filters(spark, rows):
    df = spark.createDataFrame([("1", "3"), ("x", "3"), ("2", "1")], "code string, ste string")
    assert rows(fr.normalise_codes(df, ["code"]), "code") == [(1,), (2,), (None,)]
    assert rows(fr.keep_equal(df, "ste", "3"), "code") == [("1",), ("x",)]
    back = fr.codes_as_text(fr.normalise_codes(df, ["code"]), ["code"])
    assert rows(back, "code") == [("1",), ("2",), (None,)]


def test_drop_missing_and_replace_zero(spark, rows):
    df = spark.createDataFrame([(1, 0.0), (2, None), (3, NAN), (4, 2.0)], "k int, x double")
    assert rows(fr.replace_zero(fr.drop_missing(df, ["x"]), "x")) == [(1, 0.001), (4, 2.0)]


def test_model_frame_rounding(spark, rows):
    df = spark.createDataFrame([(1, 2.5, 2.5), (2, 3.5, 0.4), (3, 0.2, 0.0)], "k int, c double, e double")
    assert rows(fr.model_frame(df, "k", "c", "e")) == [(1, 2.0, 2.5), (2, 4.0, 0.4), (3, 0.0, 0.001)]
    rounded = fr.model_frame(df, "k", "c", "e", round_expected=True)
    assert rows(rounded) == [(1, 2.0, 2.0), (2, 4.0, 0.001), (3, 0.0, 0.001)]
    some = fr.model_frame(df, "k", "c", "e", round_expected=F.col("k") == 1)
    assert rows(some) == [(1, 2.0, 2.0), (2, 4.0, 0.4), (3, 0.0, 0.001)]


def test_append_rows_fills(spark, rows):
    df = spark.createDataFrame([(1, 2.0)], "k int, x double")
    more = spark.createDataFrame([(2,)], "k int")
    assert rows(fr.append_rows(df, more, fill={"x": 0.0})) == [(1, 2.0), (2, 0.0)]


@pytest.fixture
def mesh(spark):
    data = [(1, 10, 100, 5), (2, 10, 100, 15), (3, 11, 100, 20), (4, 20, 200, 0), (5, 20, 200, 0)]
    return spark.createDataFrame(data, "mb long, sa1 long, sa2 long, pop long")


def test_shares_sum_to_one_or_are_missing(mesh, rows):
    shares = hi.population_share(mesh, "sa2", "pop", "total", "share")
    assert rows(shares, "mb", "share") == [(1, 0.125), (2, 0.375), (3, 0.5), (4, None), (5, None)]
    assert rows(hi.share_check(shares, "sa2", "share")) == [(100, 1.0, True), (200, None, False)]


def test_apportion_and_roll_up_return_the_original(spark, mesh, rows):
    cases = spark.createDataFrame([(100, 8.0), (200, 4.0), (300, 9.0)], "sa2 long, c double")
    shares = hi.population_share(mesh, "sa2", "pop", "total", "share")
    split = hi.apportion_down(shares, cases, ["sa2"], "share", {"c": "mc"})
    assert rows(split, "mb", "mc") == [(1, 1.0), (2, 3.0), (3, 4.0), (4, None), (5, None)]
    back = split.groupBy("sa2").agg(F.sum("mc")).where("sa2 = 100")
    assert rows(back) == [(100, 8.0)]


def test_roll_up_joins_each_area_once(spark, mesh, rows):
    """Five mesh rows of two areas must not multiply their cases."""
    cases = spark.createDataFrame([(100, 8.0), (200, 4.0)], "area long, c double")
    up = hi.roll_up(mesh.withColumn("sa3", F.lit(1)), cases, "sa2", "sa3", ["c"], cases_key="area")
    assert rows(up) == [(1, 12.0)]


def test_population_join_and_keys(spark, mesh, rows):
    pop = spark.createDataFrame([(1, 7), (9, 1), (None, 3)], "code long, persons long")
    assert rows(hi.attach_population(mesh.select("mb"), pop, "mb", "code")) == [(1, 7)]
    assert rows(hi.duplicate_keys(mesh, ["sa1"])) == [(10, 2), (20, 2)]
    odd = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "x string")
    assert rows(hi.distinct_count(odd, "x")) == [(2, 1)]


def test_concordance_keeps_totals(spark, rows):
    cases = spark.createDataFrame(
        [("A", "m", 4.0), ("A", "f", 4.0), ("B", "m", 2.0), (None, "m", 5.0)], "name string, sex string, c double"
    )
    conc = spark.createDataFrame(
        [("A", 1, "A", 0.75), ("A", 2, "B2", 0.25), ("B", 2, "B2", 1.0)],
        "old string, code long, new string, ratio double",
    )
    collapsed = cc.collapse_strata(cases, ["name"], {"c": "c"})
    moved = cc.apply_concordance(collapsed, conc, "name", "old", ["code", "new"], "ratio", ["c"])
    assert rows(moved) == [(1, "A", 6.0), (2, "B2", 4.0)]


def test_weighted_score_fan_out(spark, rows):
    """With per-mesh-row weights a unit counts once per mesh row."""
    scores = spark.createDataFrame([(10, 100.0, 10), (11, 200.0, 30)], "sa1 long, score double, pop long")
    mesh = spark.createDataFrame([(10, 1), (10, 1), (10, 1), (11, 1)], "sa1 long, sa3 long")
    args = (scores, mesh, "sa1", "sa3", "score", "pop", "out")
    joined = (100 * 10 * 3 + 200 * 30) / (10 * 3 + 30)
    assert rows(dep.weighted_score(*args)) == [(1, joined)]
    assert rows(dep.weighted_score(*args, weights="per_sa1")) == [(1, 175.0)]
    unit = dep.weighted_score(scores, mesh, "sa1", "sa1", "score", "pop", "out")
    assert rows(unit) == [(10, 100.0), (11, 200.0)]


def test_weighted_score_without_people_is_missing(spark, rows):
    scores = spark.createDataFrame([(10, 100.0, 0)], "sa1 long, score double, pop long")
    mesh = spark.createDataFrame([(10, 1)], "sa1 long, sa3 long")
    assert rows(dep.weighted_score(scores, mesh, "sa1", "sa3", "score", "pop", "out")) == [(1, None)]


def test_mesh_score_is_a_share(spark, rows):
    scores = spark.createDataFrame([(10, 100.0, 20)], "sa1 long, score double, pop long")
    mesh = spark.createDataFrame([(1, 10, 5), (2, 10, 15)], "mb long, sa1 long, persons long")
    out = dep.mesh_score(scores, mesh, "sa1", "score", "pop", "persons", "s")
    assert rows(out, "mb", "s") == [(1, 25.0), (2, 75.0)]


def test_factor_levels(spark, rows):
    df = spark.createDataFrame([(3,), (1,), (3,), (None,)], "q int")
    assert rows(dep.factor_levels(df, "q")) == [(1, True), (3, False)]


def test_text_table_roundtrip(spark, rows):
    df = spark.createDataFrame([(1, "a b", 0.1), (2, None, None)], "k long, name string, x double")
    path = scratch_path(spark, "test")
    write_text_table(df, path)
    assert rows(read_table(spark, path, "k long, name string, x double", sep=" ")) == rows(df)
    with pytest.raises(ValueError):
        read_table(spark, path)


def test_layer_roundtrip(spark, rows):
    layer = spark.createDataFrame([(1, SQUARE), (2, SQUARE * 2)], "k long, rings array<array<struct<x:double,y:double>>>")
    for suffix in ("", ".parquet"):
        path = scratch_path(spark, "test") + suffix
        write_layer(layer, path)
        back = read_layer(spark, path, None if suffix else "k long")
        assert rows(back) == rows(layer)
        assert attributes(back).columns == ["k"]


def test_plain_polygon_features(spark):
    path = scratch_path(spark, "test")
    feature = (
        '{"type":"Feature","properties":{"k":5},"geometry":{"type":"Polygon",'
        '"coordinates":[[[0.0,0.0],[2.5,0.0],[2.5,1.0],[0.0,0.0]]]}}'
    )
    spark.createDataFrame([(feature,)], "value string").write.text(path)
    row = read_layer(spark, path, "k long").first()
    assert row.k == 5
    assert [(p.x, p.y) for p in row.rings[0]] == [(0.0, 0.0), (2.5, 0.0), (2.5, 1.0), (0.0, 0.0)]


def test_fit_roundtrip_prunes(spark, rows):
    fit = spark.createDataFrame(
        [("SA2", "nc", 1, 2.0), ("SA2", "wc", 1, 3.0), ("SA3", "nc", 1, 4.0)],
        "level string, variant string, area long, fitted double",
    )
    path = scratch_path(spark, "test")
    write_fit(fit, path)
    one = read_fit(spark, path, "SA2", "wc")
    assert rows(one, "area", "fitted") == [(1, 3.0)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan


def test_literal_table(spark, rows):
    assert rows(literal_table(spark, [("Mesh", -0.45)], "level string, m double")) == [("Mesh", -0.45)]


def test_align_audit_and_suffixes(spark, rows):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 2.0)], "k long, x double")
    b = spark.createDataFrame([(2, 9.0), (3, 8.0)], "k long, x double")
    assert rows(ml.align_by_key(a.select("k"), b, "k", "x")) == [(1, 0.0), (2, 9.0), (2, 9.0)]
    assert rows(ml.key_audit(a, b, "k")) == [(1, 1, 1)]
    merged = ml.left_merge(a, b, "k")
    assert merged.columns == ["k", "x.x", "x.y"]
    assert rows(merged) == [(1, 1.0, None), (2, 2.0, 9.0), (2, 2.0, 9.0)]
    assert rows(ml.join_suffixed(a, b, ["k"], ("_a", "_b"))) == [(2, 2.0, 9.0), (2, 2.0, 9.0)]


def test_map_layer_censors_and_cuts(spark, rows):
    far = [[(x + 10, y) for x, y in SQUARE[0]]]
    layer = spark.createDataFrame(
        [(1, SQUARE), (2, SQUARE), (3, far)], "k long, rings array<array<struct<x:double,y:double>>>"
    )
    stats = spark.createDataFrame([(1, 0.5), (2, 1.7), (3, 0.5)], "k long, sir double")
    table = ml.map_layer(stats, layer, "k", "sir", (0.0, 1.6), (1.0, 0.0, 5.0, 5.0))
    assert rows(table, "k", "sir") == [(1, 0.5), (2, None)]
    assert table.columns == ["k", "sir", "rings"]


def test_nan_measure_is_censored_to_missing(spark):
    df = spark.createDataFrame([(NAN,)], "x double")
    value = ml.censor(df, "x", 0.0, 2.0).first().x
    assert value is None or math.isnan(value)


def test_codes_of_any_kind(spark, rows):
    from tessarea.operators.frame import drop_missing, normalise_codes

    df = spark.createDataFrame(
        [(30002180000.0, " 305011105.0"), (1.5, "3e4"), (None, "QLD"), (float("nan"), None)], "a double, b string"
    )
    got = normalise_codes(df, ["a", "b"])
    assert [tuple(r) for r in got.collect()] == [(30002180000, 305011105), (None, 30000), (None, None), (None, None)]
    big = spark.createDataFrame([(2**60 + 1,)], "a long")
    assert normalise_codes(big, ["a"]).first().a == 2**60 + 1
    assert rows(drop_missing(df, ["b", "a"])) == [(1.5, "3e4"), (30002180000.0, " 305011105.0")]


def test_feature_collections(spark, tmp_path):
    import json

    from tessarea.sources import read_layer

    feature = lambda k: {
        "type": "Feature", "properties": {"k": k},
        "geometry": {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]]},
    }
    whole = {"type": "FeatureCollection", "features": [feature(1), feature(2)]}
    for name, text, wide in (
        ("lines", "\n".join(json.dumps(feature(k)) for k in (1, 2)), False),
        ("one", json.dumps(whole), False),
        ("many", json.dumps(whole, indent=1), True),
    ):
        (tmp_path / f"{name}.geojson").write_text(text)
        got = read_layer(spark, str(tmp_path / f"{name}.geojson"), "k int", multi_line=wide)
        assert sorted((r.k, len(r.rings[0])) for r in got.collect()) == [(1, 4), (2, 4)]
    with pytest.raises(Exception):
        read_layer(spark, str(tmp_path / "many.geojson"), "k int").collect()
