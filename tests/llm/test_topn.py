import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from terrasieve.llm import topn
from terrasieve.llm.topn import top_n


def brute(rows, n):
    out = []
    for g in {r[0] for r in rows}:
        good = [r for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]]
        good.sort(key=lambda r: (-r[1], r[2] is None, r[2] if r[2] is not None else 0, r[3]))
        out += [(g, k, r[3]) for k, r in enumerate(good[:n], 1)]
    return sorted(out, key=repr)


def ours(spark, rows, n, **kw):
    df = spark.createDataFrame(rows, "g string, s double, b int, id long")
    return sorted(((r.g, r.rank_no, r.id) for r in top_n(df, "g", "s", ["b", "id"], n, **kw).collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = [None, float("nan"), float("inf"), -float("inf"), 0.0, -3.5, 1.0, 1.0, 0.999999, 1e300, 5e-324]
    rows = [(rng.choice(["a", "hot", "hot", "hot", None, "b", "c"]), rng.choice([*pool, rng.random()]), rng.choice([None, 1, 2]), i) for i in range(600)]
    for n in (1, 3, 50):
        assert ours(spark, rows, n) == brute(rows, n)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.floats(width=32)), st.integers(0, 2)), min_size=1, max_size=40))
def test_property(spark, items):
    rows = [(g, s, b, i) for i, (g, s, b) in enumerate(items)]
    assert ours(spark, rows, 2) == brute(rows, 2)


def test_ties_empty_filter_and_clashes(spark):
    tied = [("hot", 0.5, 7, i) for i in range(5000)]
    assert ours(spark, tied, 3) == [("hot", 1, 0), ("hot", 2, 1), ("hot", 3, 2)]
    assert ours(spark, [], 3) == []
    assert ours(spark, [("a", 1.0, -1, 0), ("a", 0.5, 2, 1)], 3, competes=F.col("b") != -1) == [("a", 1, 1)]
    df = spark.createDataFrame([("a", 1.0, 1, 1, 9)], "g string, s double, b int, id long, rank_no int")
    assert [tuple(r) for r in top_n(df, "g", "s", ["b", "id"], 3).select("g", "rank_no").collect()] == [("a", 1)]


def test_groups_beyond_the_least_size_are_cut(spark, monkeypatch):
    """Small groups beside large ones with ties, infinities and one value, at a least size of a few rows."""
    monkeypatch.setattr(topn, "LEAST_FACTOR", 2)
    rng = random.Random(5)
    rows = [(g, s, rng.choice([None, 1, 2]), i) for i, (g, s) in enumerate([*(("hot", round(rng.random(), 2)) for _ in range(900)), *(("flat", 1.0) for _ in range(300)), *(("inf", rng.choice([float("inf"), -float("inf"), 5.0])) for _ in range(90)), *((f"g{k}", rng.random()) for k in range(40)), *((None, rng.random()) for _ in range(200))])]
    for n in (1, 3, 20):
        assert ours(spark, rows, n) == brute(rows, n)


def test_groups_of_one_hash_share_the_lowest_threshold(spark, monkeypatch):
    monkeypatch.setattr(topn, "LEAST_FACTOR", 2)
    monkeypatch.setattr(topn.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [*(("hot", i / 500, 1, i) for i in range(500)), *(("low", -float(i), 1, 1000 + i) for i in range(300)), ("one", -1e9, 1, 5000)]
    assert ours(spark, rows, 3) == brute(rows, 3)


def test_only_survivors_are_shuffled_also_with_very_many_groups(spark):
    """Two million groups of a row beside a hot one of a million: thresholds are one row, survivors hardly more than the small groups."""
    df = spark.range(3_000_000).selectExpr("if(id < 2000000, id, -1) as g", "pmod(xxhash64(id), 1000003) / 1000003.0d as s", "id")
    cuts = topn.thresholds(df, "g", "s", 3).collect()
    assert len(cuts) == 1
    assert df.where((F.col("g") == -1) & (topn.score_bucket(F.col("s")) >= cuts[0]._topn_cut)).count() < 2000
    plan = top_n(df, "g", "s", ["id"], 3)
    assert plan.count() == 2_000_003
    text = plan._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in text and "BroadcastHashJoin" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
