import random

import numpy as np
import pytest

from terrasieve.functions.wkt import parse_batch, rings_of

TEXTS = [
    "POLYGON ((0 0, 1 0, 1 1, 0 0))", "polygon((0 0,1 0,1 1,0 0))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.1 5.1, 5.2 5.1, 5.2 5.2, 5.1 5.1)))", "POLYGON ((0 0 , 1e-3 0,\n1 1 , 0 0))", "SRID=4326;POLYGON ((0 0, 1 0, 1 1, 0 0))",
    "POLYGON Z ((0 0 1, 1 0 1, 1 1 1, 0 0 1))", "POLYGON EMPTY", "", None, "POINT (1 2)", "x" * 100_000, "POLYGON ((" + ", ".join(f"{i} {i * i}" for i in range(20_000)) + "))",
]
BROKEN = [
    "POLYGON ((0 0, 1 0, 1, 1 1, 0 0))", "POLYGON ((0 0, 1 0 1, 1, 0 0 ))", "POLYGON ((0 0, 1 0, 1 1, 0 0)", "POLYGON ((0 0, 1e999 0, 1 1, 0 0))", "POLYGON ((0 0, nan 0, 1 1, 0 0))", "POLYGON ((0 0, 1 0, 1 1, 0 0)))", "POLYGON ((0 0, 1.2.3 0, 1 1, 0 0))", "POLYGON (0 0, 1 0, 1 1, 0 0)",
    "MULTIPOLYGON ((0 0, 1 0, 1 1, 0 0))", "POLYGON ((0 0, 1 0, 1 1, 0 0)), ((2 2, 3 2, 3 3, 2 2))", "POLYGON (((0 0, 1 0, 1 1, 0 0)))", "POLYGON ((é 0, 1 0, 1 1, 0 0))", "))((", "POLYGON ((0 0, 1 0, 1 1, 0 0),)", "POLYGON ((0 0, 1 0, 1 1, 0 0) 5)", "POLYGON (( ))", "POLYGON ((- 0, 1 0, 1 1, 0 0))", "POLYGON ((0 0, 1 0))",
]


def plain(texts):
    return [(n, k, r.tolist()) for n, t in enumerate(texts) for k, part in enumerate(rings_of(t or "")) for r in part]


def batch(texts):
    b = parse_batch(texts)
    assert b.texts == len(texts) and len(b.xy) == b.size.sum()
    rings = np.split(b.xy, np.cumsum(b.size)[:-1]) if len(b.size) else []
    assert b.hole.tolist() == [bool(i) and (b.owner[i], b.part[i]) == (b.owner[i - 1], b.part[i - 1]) for i in range(len(b.size))]
    return [(int(o), int(p), r.tolist()) for o, p, r in zip(b.owner, b.part, rings)]


@pytest.mark.parametrize("text", [*TEXTS, *BROKEN])
def test_one(text):
    assert batch([text]) == plain([text])


def test_batches():
    rng = random.Random(3)
    assert batch([]) == []
    for _ in range(20):
        texts = rng.choices([*TEXTS, *BROKEN] if rng.random() < 0.5 else TEXTS, k=rng.randint(1, 60))
        assert batch(texts) == plain(texts)
