import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.functions import text as tx

TEXTS = ["", None, "   ", "One. Two! Three?", "The rope made a fine tree. Maple Ridge Works sells ropes", "naïve café à la Crème", "a-b c3po don't stop", "x " * 3000]


def _values(spark, column):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    return [r[0] for r in rows.orderBy("k").select(column(F.col("t")).alias("v")).collect()]


def syllables(text):
    total = 0
    for part in (text or "").lower().split():
        groups = len(re.findall("[aeiouy]+", re.sub(r"[^\w]|[\d_]", "", part)))
        total += max(1, groups - (part.endswith("e") and groups > 1))
    return total


def test_counts(spark):
    assert _values(spark, tx.word_count) == [len(re.findall(r"[^\W_]+", t or "")) for t in TEXTS]
    assert _values(spark, tx.byte_count) == [len((t or "").encode()) for t in TEXTS]
    assert _values(spark, tx.sentence_count) == [max(1, len(re.findall("[.!?]", t or ""))) for t in TEXTS]
    assert _values(spark, tx.syllable_count) == [syllables(t) for t in TEXTS]


def test_fingerprint(spark):
    def expected(t):
        parts = (t or "").lower().split()
        return hashlib.md5(" ".join(parts[:: max(1, len(parts) // 30)]).encode()).hexdigest()

    assert _values(spark, tx.sampled_fingerprint) == [expected(t) for t in TEXTS]


def test_terms(spark):
    assert _values(spark, tx.keyword_tokens)[4] == ["rope", "made", "fine", "tree", "maple", "ridge", "works", "sells", "ropes"]
    row = spark.createDataFrame([(["ab", "abc", "abc", "d"],), ([],), (["one"],)], "t array<string>").select(tx.ngrams(F.col("t"))).collect()
    assert row[0][0] == ["abc", "abc", "ab abc", "abc d", "ab abc abc", "abc abc d"]
    assert row[1][0] == [] and row[2][0] == ["one"]


def test_entities(spark):
    assert _values(spark, tx.named_entities)[4] == ["Maple Ridge Works"]


def test_reading_ease_is_clamped(spark):
    rows = spark.createDataFrame([("Go on.", 2), ("", 0), ("internationalization " * 50, 50)], "t string, n int")
    assert [r[0] for r in rows.select(tx.reading_ease(F.col("t"), F.col("n"))).collect()] == [100.0, 100.0, 0.0]


def test_shortened(spark):
    rows = spark.createDataFrame([("x" * 50,), ("x" * 42,)], "t string").select(tx.shortened(F.col("t"), 42)).collect()
    assert rows[0][0] == "x" * 39 + "..." and rows[1][0] == "x" * 42


@given(st.lists(st.text(alphabet="aeiouyst e.'3", max_size=25), min_size=1, max_size=20))
@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
def test_syllables_against_a_plain_model(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    assert [r[0] for r in rows.select(tx.syllable_count(F.col("t"))).collect()] == [syllables(t) for t in texts]
