import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from terrasieve.llm import packing as P


@given(st.lists(st.integers(0, 40), max_size=80))
def test_sum_of_squares(sizes):
    """Every step of the packer reaches the least sum of squared counts that any placement gives."""
    bins = P.pack_sizes(np.array(sizes, dtype=np.int64), 40)
    free: dict[int, int] = {}
    for size, b in zip(sizes, bins.tolist()):
        if not size:
            continue

        def score(f):
            gaps = [g for g in f.values() if 0 < g]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        options = [score({**free, k: g - size}) for k, g in free.items() if g >= size] + [score({**free, len(free): 40 - size})]
        free[b] = free.get(b, 40) - size
        assert free[b] >= 0 and score(free) == min(options)


def test_pack_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "TEXTS_PER_PACKING", 60)
    rows = [(i, "word " * (1 + i * 7 % 90)) for i in range(200)] + [(900, None), (901, ""), (902, "long text " * 1200), (903, "word")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'c' as container")
    got = P.pack_texts(df, "doc_id", "text", 256).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    size = {}
    for r in got:
        size[r.container] = size.get(r.container, 0) + r.n_tokens
    assert max(size.values()) <= 256
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert all(total[i] == P.count_tokens(t) for i, t in rows)
    parts = sorted((r.part_no, r.token_start, r.n_tokens) for r in got if r.doc_id == 902)
    assert len(parts) > 1 and all(n == 256 for _, _, n in parts[:-1]) and [s for _, s, _ in parts] == [256 * k for k in range(len(parts))]
    assert all(r.part_no == 0 for r in got if r.doc_id != 902) and len({r.container for r in got if r.doc_id == 902}) == len(parts)
    exact = spark.createDataFrame([(1, " ".join(["word"] * 512)), (1, " ".join(["word"] * 512)), (2, "word")], "doc_id long, text string")
    assert sorted((r.doc_id, r.part_no, r.n_tokens) for r in P.pack_texts(exact, "doc_id", "text", 256).collect()) == [(1, 0, 256), (1, 0, 256), (1, 1, 256), (1, 1, 256), (2, 0, 1)]
    assert len({r.container for r in P.pack_texts(exact, "doc_id", "text", 256).collect()}) == 5
    assert P.pack_texts(df.limit(0), "doc_id", "text").count() == 0


def test_waste_is_small():
    rng = np.random.default_rng(0)
    sizes = np.minimum(2048, rng.lognormal(6.3, 0.8, 20_000).astype(int) + 1)
    bins = P.pack_sizes(sizes, 2048)
    assert np.bincount(bins, sizes).max() <= 2048
    assert sizes.sum() / ((bins.max() + 1) * 2048) > 0.98


def test_long_texts_count_exactly(monkeypatch):
    text = "Le témoin a vu 17 maisons; \n\n  n'est-ce pas ? " * 400
    whole = P.count_tokens(text)
    monkeypatch.setattr(P, "RUN_CHARS", 100)
    assert P.count_tokens(text) == whole
