import json
from pathlib import Path

import pytest

from terrasieve.operators import schema_drift
from terrasieve.operators.schema_drift import TYPES, changes, name_similarity, profile, select_matches, targets_of, unify, with_canonical_names

SMALL = "/root/testdata/sf0.001"
CATALOG = [("ImageId", "ImageId", "string"), ("image_id", "ImageId", "string"), ("BuildingId", "BuildingId", "integer"), ("BldgId", "BuildingId", "integer"), ("Confidence", "Confidence", "double"), ("conf", "Confidence", "double"), ("note", "note", "string")]


def frames(spark, rows):
    df = spark.createDataFrame([(i, f, d, b if b is None or isinstance(b, str) else json.dumps(b), 1) for i, (f, d, b) in enumerate(rows)], "row_id long, feed string, delivery_no int, body string, change int")
    catalog = spark.createDataFrame(CATALOG, "field_name string, canonical_name string, canonical_type string")
    return df, catalog, with_canonical_names(profile(df, "feed", "delivery_no", "body"), catalog)


def found(spark, rows):
    return sorted((r.feed, r.delivery_no, r.field_name, r.change) for r in changes(frames(spark, rows)[2]).collect())


def test_changes(spark):
    rows = [
        ("a", 1, {"ImageId": "x", "BuildingId": 1}), ("a", 1, {"ImageId": "y"}), ("a", 3, {"image_id": "x", "BuildingId": None}), ("a", 4, {"image_id": "x", "BuildingId": 1.5, "conf": 1}),
        ("a", 5, {"image_id": "x", "BldgId": "s"}), ("a", 6, {"image_id": "x", "conf": None}), ("a", 7, {"image_id": "x", "conf": 0.5}), ("b", 9, {"note": None}), ("b", 10, {"note": True}), ("b", 11, {"note": 3}), ("b", 12, {"note": None}), ("b", 13, {"note": 3.0}),
    ]
    assert found(spark, rows) == sorted([
        ("a", 3, "image_id", "renamed"), ("a", 4, "BuildingId", "retyped"), ("a", 4, "conf", "added"), ("a", 5, "BldgId", "renamed"), ("a", 5, "BldgId", "retyped"), ("a", 5, "conf", "removed"),
        ("a", 6, "conf", "added"), ("a", 6, "BldgId", "removed"), ("b", 11, "note", "retyped"), ("b", 13, "note", "retyped"),
    ])


def test_odd_bodies(spark):
    rows = [("a", 1, {"note": "x"}), ("a", 2, None), ("a", 3, "{broken"), ("a", 4, "[1]"), ("a", 5, {"note": "x"}), (None, 1, {"note": 1}), (None, 2, {}), ("a", None, {"note": 1})]
    df, catalog, seen = frames(spark, rows)
    got = {(r.feed, r.delivery_no, r.change) for r in changes(seen).collect()}
    assert got == {("a", 2, "removed"), ("a", 5, "added"), (None, 2, "removed")}
    assert unify(df, ["row_id"], "body", seen, catalog).count() == len(rows)
    assert found(spark, []) == []


def test_flooding_alone_matches_names_it_has_not_seen(spark):
    targets = targets_of(spark.createDataFrame(CATALOG, "field_name string, canonical_name string, canonical_type string"))
    fields = [("ImageID", "string"), ("building_id", "integer"), ("confidence", "double"), ("Note", "string"), ("storeys", "integer")]
    assert select_matches(fields, targets) == {"ImageID": "ImageId", "building_id": "BuildingId", "confidence": "Confidence", "Note": "note", "storeys": "storeys"}
    assert select_matches([(n, t) for n, _, t in CATALOG if n != "image_id"], targets)["BldgId"] == "BuildingId"
    assert name_similarity("a", "a") == 1 and TYPES[0] == "null"


def test_unify_casts_and_keeps_misfits(spark):
    df, catalog, seen = frames(spark, [("a", 1, {"BldgId": "12", "conf": "high", "extra": {"k": 1}, "big": "z" * 50_000})])
    r = unify(df, ["row_id"], "body", seen, catalog).first()
    assert (r.BuildingId, r.Confidence, r.unfit, r.note, len(r.big)) == (12, None, {"Confidence": "high"}, None, 50_000)


def test_unify_takes_nested_fields_by_their_path_and_refuses_too_many(spark):
    df, catalog, seen = frames(spark, [("a", 1, {"BldgId": 3, "ids": {f"k{i}": i for i in range(30)}}), ("a", 2, {"x.y": 7})])
    got = unify(df, ["row_id"], "body", seen, catalog, 4)
    assert set(got.columns) == {"row_id", "BuildingId", "Confidence", "ImageId", "note", "ids", "x.y", "unfit"}
    assert {r["x.y"] for r in got.collect()} == {None, "7"}
    with pytest.raises(ValueError, match="more than 2 spellings"):
        unify(df, ["row_id"], "body", seen, catalog, 2)


def test_unify_resolves_listed_paths_level_by_level(spark):
    rows = [("a", 1, {"a": {"b": 5, "c.d": {"e": "x"}}}), ("a", 2, {"a.b": 6}), ("a", 3, {"a": {"b": "wide"}}), ("a", 4, {"a": [1]}), ("a", 5, {"a": None}), ("a", 6, {"a": {"b": 7.0}, "width": 8})]
    df, _, _ = frames(spark, rows)
    catalog = spark.createDataFrame([("a.b", "width", "integer"), ("a.c.d.e", "mark", "string")], "field_name string, canonical_name string, canonical_type string")
    seen = with_canonical_names(profile(df, "feed", "delivery_no", "body"), catalog)
    got = {r.row_id: (r.width, r.mark, r.unfit) for r in unify(df, ["row_id"], "body", seen, catalog).collect()}
    assert got == {0: (5, "x", {}), 1: (6, None, {}), 2: (None, None, {"width": "wide"}), 3: (None, None, {}), 4: (None, None, {}), 5: (7, None, {})}


def test_profile_of_numbers_nests_and_repeats(spark):
    rows = [("a", 1, '{"n": ' + "9" * 6000 + ', "x": 1, "x": 2.5}'), ("a", 1, '{"x": 3, "o": {"p": [1], "q": {"r": true}}}'), ("a", 1, "[" * 100_000), ("a", 1, None), ("a", 1, {"x": 3})]
    df, _, _ = frames(spark, rows)
    got = {r.field_name: (TYPES[r.type_rank], r.n_rows) for r in profile(df, "feed", "delivery_no", "body").collect()}
    assert got == {None: ("null", 5), "n": ("integer", 1), "x": ("double", 3), "o": ("object", 1), "o.p": ("array", 1), "o.q": ("object", 1), "o.q.r": ("boolean", 1)}


def test_schemas_are_matched_in_more_than_one_task(spark):
    rows = [(f"f{d}", d, {"BldgId": 1, f"note{d}": "x"}) for d in range(40)]
    df, catalog, _ = frames(spark, rows)
    plan = with_canonical_names(profile(df, "feed", "delivery_no", "body"), catalog)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_the_catalog_reports_matches_it_contradicts(monkeypatch):
    targets, listed = [("A", "string", ("A", "a1")), ("B", "string", ("B", "b1"))], {"A": "A", "a1": "A", "B": "B", "b1": "B"}
    assert schema_drift.checked_matches([("a1", "string"), ("B", "string"), ("other", "string")], targets, listed) == [("a1", "A", None), ("B", "B", None), ("other", "other", None)]
    monkeypatch.setattr(schema_drift, "select_matches", lambda fields, targets: {"a1": "B", "other": "A"})
    assert schema_drift.checked_matches([("a1", "string"), ("other", "string")], targets, listed) == [("a1", "A", "B"), ("other", "A", None)]


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_flooding_alone_finds_the_names_of_the_catalog(spark):
    df, catalog = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("feed_rows", "field_catalog"))
    targets = targets_of(catalog)
    listed = {s: t[0] for t in targets for s in t[2]}
    assert len(listed) == 21
    for name, canonical, kind in catalog.select("field_name", "canonical_name", "canonical_type").collect():
        assert select_matches([(name, kind)], targets) == {name: canonical}
    seen = with_canonical_names(profile(df, "feed", "delivery_no", "body"), catalog)
    assert seen.where("rejected is not null").count() == 0 and seen.where("canonical_name is not null").count() > 0
