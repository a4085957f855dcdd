"""References without a parent, and messages delivered more than once: edge cases against brute force."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditloom.operators import deliveries, hot, orphans
from auditloom.operators.deliveries import deletion_vectors, dropped_rows, read_kept
from auditloom.operators.orphans import Source, orphan_counts, orphan_parts, orphan_records, parent_state

T0 = dt.datetime(2025, 3, 1)
PARENTS = "audit_id string, updated_at timestamp, deleted_at timestamp, loaded_at timestamp, record_id string"
REFS = "id bigint, audit_id string, at timestamp, key string, n int"


def _uuid(k):
    return f"00000000-0000-0000-0000-{k:012x}"


def _orphans(spark, parents, refs):
    state = parent_state(spark.createDataFrame(parents, PARENTS), "audit_id", "updated_at", "deleted_at", "loaded_at")
    return orphan_records([Source("refs", spark.createDataFrame(refs, REFS), "id", "audit_id", "at")], state)


def test_reasons(spark):
    h = dt.timedelta(hours=1)
    parents = [
        (_uuid(1), T0, None, T0, "x"), (_uuid(1).upper(), T0 + h, None, T0 + 5 * h, "x"),
        (_uuid(2), T0, None, T0, "x"), (_uuid(2), T0 + h, T0 + h, T0, "x"),
        (_uuid(3), T0, T0, T0, "x"), (_uuid(3), T0 + h, None, T0 + 2 * h, "x"), (_uuid(4), None, None, None, "x"), ("junk", T0, None, T0, "x"),
    ]
    refs = [
        (1, _uuid(1), T0 + h, "k", 1), (2, "{" + _uuid(1) + "}", T0 - h, "k", 1), (3, _uuid(2), T0 + h, "k", 1), (4, _uuid(9), None, "k", 1), (5, "junk", T0, "k", 1),
        (6, "  ", T0, "k", 1), (7, None, T0, "k", 1), (8, _uuid(3), None, "k", 1), (9, _uuid(4), T0, "k", 1), (4, _uuid(9), None, "k", 1),
    ]
    got = sorted(tuple(r)[1:] for r in _orphans(spark, parents, refs).collect())
    assert got == [(2, "2025-02", "late"), (3, "2025-03", "deleted"), (4, "unknown", "missing"), (5, "2025-03", "missing")]
    assert {(r.period_month, r.orphans) for r in orphan_counts(_orphans(spark, parents, refs)).where("reason = 'missing'").collect()} == {("unknown", 1), ("2025-03", 1)}


def test_empty_tables(spark):
    assert _orphans(spark, [], []).count() == 0
    assert [r.reason for r in _orphans(spark, [], [(1, _uuid(1), T0, "k", 1)]).collect()] == ["missing"]


def test_hot_keys_take_the_broadcast_path(spark, monkeypatch):
    monkeypatch.setattr(hot, "LEAST_HOT", 10)
    refs = [(k, _uuid(9), T0, "k", 1) for k in range(50)] + [(100 + k, _uuid(k), T0, "k", 1) for k in range(8)]
    refs += [(200 + k, _uuid(1), T0 + dt.timedelta(days=k - 40), "k", 1) for k in range(60)]  # heavy, late in part
    got = _orphans(spark, [(_uuid(k), T0, None, T0, "x") for k in range(4)], refs).collect()
    assert sorted(r.record_id for r in got) == [*range(50), 104, 105, 106, 107, *range(200, 240)]


def test_counts_of_both_parts_and_the_shuffle_path_agree_with_the_records(spark, monkeypatch):
    monkeypatch.setattr(hot, "LEAST_HOT", 20)
    rng = random.Random(5)
    refs = [(k, _uuid(9 if rng.random() < 0.4 else rng.randrange(30)), T0 + dt.timedelta(days=rng.randrange(-60, 60)), "k", 1) for k in range(300)]
    refs += refs[:40] + [(900, "junk", T0, "k", 1)]
    parents = [(_uuid(k), T0, T0 if k % 5 == 0 else None, T0, "x") for k in range(0, 30, 2)]
    state = parent_state(spark.createDataFrame(parents, PARENTS), "audit_id", "updated_at", "deleted_at", "loaded_at")
    sources = [Source("refs", spark.createDataFrame(refs, REFS), "id", "audit_id", "at")]
    wanted = {tuple(r) for r in orphan_records(sources, state).collect()}
    assert len(wanted) > 200
    counted = {tuple(r) for r in orphan_counts(*orphan_parts(sources, state)).collect()}
    assert counted == {(*k, n) for k, n in Counter((t, p, r) for t, _, p, r in wanted).items()}
    monkeypatch.setattr(orphans, "MOST_BROADCAST_GROUPS", 0)
    assert {tuple(r) for r in orphan_records(sources, state).collect()} == wanted


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join(spark, monkeypatch, how):
    monkeypatch.setattr(hot, "LEAST_HOT", 10)
    rows = spark.createDataFrame([(k, "hot" if k % 2 else f"k{k % 7}") for k in range(60)] + [(99, None)], "id int, k string")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    side = sizes.where("k != 'k1'").withColumn("v", F.lit(1))
    assert [r.k for r in hot.hot_keys(sizes, "k").collect()] == ["hot"]
    got = hot.split_join(rows, side, "k", hot.hot_keys(sizes, "k"), F.col("id"), how)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(side, "k", how).select(got.columns).collect()))


MESSAGES = "delivery_no bigint, subject string, msg_id string, audit_id string, payload string, received_at timestamp, file string, row bigint"
S = list(deliveries.SUBJECTS)


def _write(spark, path, rows):
    df = spark.createDataFrame(rows, MESSAGES).repartition(3, "delivery_no")
    df.write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def test_identities(spark, tmp_path):
    h = dt.timedelta(hours=1)
    rows = [
        (1, S[0], "audit:A:crawl_completed", "A", "{}", T0, "f", 0), (2, S[0], " AUDIT:a:crawl_completed ", "A", "{}", T0 - h, "f", 0), (3, S[0], None, "a", "{}", T0, "f", 0),
        (4, S[2], "", "A", '{"version": 2}', T0, "f", 0), (5, S[2], "audit:a:report_generated:v2", "A", "{", T0, "f", 0), (6, S[2], None, "A", '{"version":3}', None, "f", 0),
        (7, S[2], None, "A", "broken", T0, "f", 0), (8, S[2], None, "A", None, T0, "f", 0), (9, "other", None, "A", "{}", T0, "f", 0), (10, "other", None, "A", "{}", T0, "f", 0),
        (11, S[1], None, None, "{}", T0, "f", 0), (12, S[1], "m", None, "{}", None, "f", 0), (13, S[1], "M", None, "{}", T0, "f", 0),
    ]
    got = sorted(r.delivery_no for r in dropped_rows(_write(spark, tmp_path / "m", rows)).collect())
    assert got == [1, 3, 5, 12]


def test_kept_rows_keep_all_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(deliveries, "VECTOR_PARTS", 2)
    rng = random.Random(3)
    rows = [(k, S[0], f"m{min(rng.randrange(12), 4)}", "A", "x" * rng.randrange(50), T0 + dt.timedelta(seconds=rng.randrange(5)), "f", k) for k in range(60)]
    path = tmp_path / "m"
    df = _write(spark, path, rows)
    best = {}
    for r in rows:
        best[r[2]] = min(best.get(r[2], r), r, key=lambda x: (x[5], x[0]))
    kept = read_kept(spark, str(path), deletion_vectors(dropped_rows(df)))
    assert kept.columns == df.columns and sorted(r.delivery_no for r in kept.collect()) == sorted(r[0] for r in best.values())


def test_whole_rows_repeated_keep_one(spark, tmp_path):
    df = _write(spark, tmp_path / "m", [(1, S[0], "m", "A", "{}", T0, "f", 0)] * 4)
    assert dropped_rows(df).count() == 3
    assert read_kept(spark, str(tmp_path / "m"), deletion_vectors(dropped_rows(df))).count() == 1


def test_no_messages(spark, tmp_path):
    df = _write(spark, tmp_path / "m", [])
    assert dropped_rows(df).count() == 0 and read_kept(spark, str(tmp_path / "m"), deletion_vectors(dropped_rows(df))).count() == 0


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_same_result_for_any_number_of_partitions(spark, tmp_path, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = _write(spark, tmp_path / "m", [(k, S[0], f"m{k % 3}", "A", "{}", T0, "f", 0) for k in range(30)])
        assert sorted(r.delivery_no for r in dropped_rows(df).collect()) == list(range(3, 30))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
