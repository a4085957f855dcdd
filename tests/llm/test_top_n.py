import random

import pytest

from auditloom.llm import top_n as module
from auditloom.llm.top_n import top_n
from auditloom.operators import hot

SCHEMA = "g string, score double, impact double, rule string, id bigint, __g string, lo int"
ORDER = [("score", True), ("impact", True), ("rule", False), ("id", False)]


def _run(spark, rows, n):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return sorted(((r.g, r.id) for r in top_n(df.select("g", "score", "impact", "rule", "id", "lo"), ["g"], ORDER, n).collect()), key=str)


def _key(r):
    bad = lambda x: x is None or x != x
    num = lambda x: (bad(x), 0 if bad(x) else -x)
    return num(r[1]), num(r[2]), (r[3] is None, (r[3] or "").encode()), (r[4] is None, r[4] or 0)


def _brute(rows, n):
    groups = {}
    for r in sorted(set(rows), key=_key):
        groups.setdefault(r[0], []).append(r)
    return sorted(((g, r[4]) for g, rs in groups.items() for r in rs[:n]), key=str)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    scores = [0.0, 1.5, 1.5000000000000002, -3.0, 1e300, -1e300, float("inf"), float("-inf"), 5e-324, None]
    rules = ["a", "b", "ab", "abcdefg", "abcdefgh", "abcdefghi", "", "zé", "z€" * 20, None]
    rows = [("big" if rng.random() < 0.6 else f"g{rng.randrange(6)}", rng.choice(scores), rng.choice([1.0, 2.0, None]), rng.choice(rules), rng.randrange(-50, 50)) for _ in range(700)]
    rows += rows[:60] + [(None, 1.0, 1.0, "x", k) for k in range(9)]
    for n in (1, 5):
        assert _run(spark, rows, n) == _brute(rows, n)
    # groups too many for a broadcast: rows of the largest are split
    monkeypatch.setattr(module, "MOST_BROADCAST_GROUPS", 0)
    monkeypatch.setattr(hot, "LEAST_HOT", 200)
    assert _run(spark, rows, 5) == _brute(rows, 5)


@pytest.mark.parametrize("parts", [2, 512])
def test_ties_are_cut_by_the_identifier(spark, monkeypatch, parts):
    monkeypatch.setattr(module, "PARTS", parts)
    rows = [("g", 1.0, 1.0, "r", k) for k in (2**40, 3, -7, 2**62, 5, 4)]
    assert _run(spark, rows, 3) == [("g", -7), ("g", 3), ("g", 4)]


def test_edges(spark):
    assert _run(spark, [], 5) == []
    assert _run(spark, [("g", float("nan"), None, None, 1), ("g", -0.0, 1.0, "b", 2), ("g", 0.0, 1.0, "a", 3)], 2) == [("g", 2), ("g", 3)]


def test_nan_and_null_are_apart(spark):
    nan = float("nan")
    rows = [("g", nan, 1.0, "a", 1), ("g", None, 1.0, "a", 1), ("g", nan, 1.0, "a", 1), ("g", None, None, None, None)]
    assert _run(spark, rows, 1) == [("g", 1)] and len(_run(spark, rows, 2)) == 2 and len(_run(spark, rows, 3)) == 3
