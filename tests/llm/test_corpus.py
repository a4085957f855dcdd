import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import mixing
from auditloom.llm.bpe import Encoder, Vocabulary, encode_texts, merge_pieces
from auditloom.llm.mixing import BLOCK_TOKENS, group_draws, mix, permuted, quotas, shard_draws
from auditloom.llm.prose import english_prose
from auditloom.llm.queries import TOKENIZERS
from auditloom.llm.reading_level import LevelModel, fit, reading_levels
from auditloom.session import written

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"
needs_tokenizer = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


@needs_tokenizer
def test_ids_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    rng = random.Random(4)
    letters = list("ab '’s\n\t r.e v1l9 é!日d😀 ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", " ", "  ", "a  ", "it's we'll I'M they're'll", "''s", " 's", "<|endoftext|> x", "a" * 5000, "ab" * 3000, "x " * 5000, "\r\n\r\n x", "1234567890" * 50]
    ids, sizes = Encoder(Vocabulary(PATH)).encode(texts)
    ends = np.r_[0, np.cumsum(sizes)]
    for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == ids[ends[k] : ends[k + 1]].tolist(), texts[k]


@needs_tokenizer
def test_pieces_with_one_hash_are_told_apart_by_their_text():
    encoder = Encoder(Vocabulary(PATH))
    texts = ["one", " two", " three", "one", "four"]
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - np.array([len(t) for t in texts])
    for words in (texts, texts[::-1]):  # the second time some are known
        whole = "".join(words)
        ends = np.cumsum([len(t) for t in words])
        starts = ends - np.array([len(t) for t in words])
        others = np.array([hash(t) & 0xFFFF for t in words], np.uint64)
        places = encoder._places_of(whole, np.full(len(words), 7, np.uint64), others, starts, ends)
        alone = [Encoder(Vocabulary(PATH)).encode([t])[0].tolist() for t in words]
        assert [encoder._pool[a : a + n].tolist() for a, n in places] == alone


@needs_tokenizer
def test_pieces_are_merged_leftmost_first():
    v = Vocabulary(PATH)
    assert merge_pieces([], v) == [] and merge_pieces([b"", b"a"], v) == [[], [v.byte_ids[97]]]


@needs_tokenizer
def test_forms(spark):
    df = spark.createDataFrame([(1, "one two", "s"), (2, "", "s"), (3, None, None)], "doc_id bigint, text string, source string")
    assert [r.ids for r in encode_texts(df, ["doc_id"], "text", PATH).orderBy("doc_id").collect()] == [[505, 734], [], []]
    packed = encode_texts(df, ["doc_id", "source"], "text", PATH, "packed").orderBy("doc_id").collect()
    assert [np.frombuffer(r["ids"], "<u2").tolist() for r in packed] == [[505, 734], [], []] and [r.tokens for r in packed] == [2, 0, 0]
    assert [r.tokens for r in encode_texts(df, ["doc_id"], "text", PATH, "count").orderBy("doc_id").collect()] == [2, 0, 0]
    assert encode_texts(df.limit(0), ["doc_id"], "text", PATH).count() == 0


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        for key in (0, 5, -9):
            got = permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got.tolist()) == list(range(n))


def test_quotas():
    made = {q.source: q.drawn for q in quotas([("a", 0.5, 1, 100), ("b", 0.3, 2, 10), ("c", 0.2, 1, 0), ("d", 0.0, 5, 9)], 120)}
    assert made == {"a": 100, "b": 20, "c": 0, "d": 0}
    assert {q.source: q.drawn for q in quotas([("a", 0.6, 3, 100), ("b", 0.4, 3, 100)], 50)} == {"a": 30, "b": 20}
    assert sum(q.drawn for q in quotas([(s, 1 / 3, 1, 40) for s in "abc"], 100)) == 100
    assert quotas([]) == [] and group_draws([]) == []


@pytest.mark.parametrize("group_shards", [2, 4096])
def test_draws_meet_the_quotas(monkeypatch, group_shards):
    monkeypatch.setattr(mixing, "GROUP_SHARDS", group_shards)
    plan = quotas([("a", 0.7, 1, 900), ("b", 0.3, 2, 250), ("c", 0.0, 1, 9)])
    drawn, sizes = Counter(), Counter()
    for group, first, owed in group_draws(plan):
        for shard, source, at, n in shard_draws(group, first, owed, mixing.SHARD_BLOCKS, group_shards):
            assert at == drawn[source]
            drawn[source] += n
            sizes[shard] += n
    assert {plan[k].source: n for k, n in drawn.items()} == {q.source: q.drawn for q in plan if q.drawn}
    shards = -(-sum(sizes.values()) // mixing.SHARD_BLOCKS)
    assert sorted(sizes) == [*range(shards)] and {sizes[k] for k in range(shards - 1)} <= {mixing.SHARD_BLOCKS}


def test_mix_holds_every_token_at_its_share(spark):
    rng = random.Random(8)
    rows, streams = [], {}
    for k in range(300):
        source = rng.choice(["a", "a", "a", "b", "b", "c", None, "x"])
        n = rng.choice([0, 1, 5, 700, 3000])
        rows.append((source, n, bytearray(np.array([k] * n, "<u2").tobytes())))
    encoded = written(spark.createDataFrame(rows, "source string, tokens bigint, ids binary").repartition(4), "t")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, 1), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    made, report = mix(encoded, targets)
    blocks = made.collect()
    held = Counter()
    for s, n, _ in rows:
        held[s] += n
    by = {r.source: r for r in report.collect()}
    assert {s: by[s].tokens_held for s in "abc"} == {s: held[s] for s in "abc"} and by["none"].tokens_drawn == 0
    drawn = Counter()
    for b in blocks:
        drawn[b.source] += len(b.tokens)
        streams.setdefault((b.source, b.block_no), b.tokens)
        assert len(b.tokens) == BLOCK_TOKENS or b.block_no == (held[b.source] - 1) // BLOCK_TOKENS
    assert {s: by[s].tokens_drawn for s in "abc"} == {s: drawn[s] for s in "abc"}
    assert all(by[s].most_repeats <= {"a": 1, "b": 2, "c": 1}[s] for s in "abc")
    assert abs(sum(r.actual_share for r in by.values()) - 1) < 1e-9
    assert len({(b.source, b.block_no, b.repeat_no) for b in blocks}) == len(blocks) == len({(b.shard, b.slot) for b in blocks})
    assert [r for r in mix(encoded, targets)[0].orderBy("shard", "slot").collect()] == sorted(blocks, key=lambda b: (b.shard, b.slot))


def test_mix_of_nothing(spark):
    encoded = written(spark.createDataFrame([], "source string, tokens bigint, ids binary"), "t")
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    made, report = mix(encoded, targets)
    assert made.count() == 0 and report.first().actual_share == 0.0


LANG = "Vereinheitlichungsbestrebungen berücksichtigen Wettbewerbsverzerrungen, Rechtsunsicherheiten, Verwaltungsvereinfachungen und Übergangsbestimmungen. "
EASY, HARD = "The cat sat on the mat and it was happy. ", "Notwithstanding considerable heterogeneity, the methodological reconstruction substantiates interpretative uncertainty. "


def test_prose():
    text = EASY + '\n\nLinks:\nhttps://a.example/x?y=1\n{"ts": 1, "level": "warn"}\n\tat page.clean(/srv/x.go:7)\nKeywords: interoperability, canonicalization, discoverability, accountability\n- ' + EASY + "Der Hund ist nicht mit dem Mann auf der Bank.\nLe chat est dans la maison avec nous."
    assert english_prose(text) == english_prose(EASY) * 2
    assert english_prose(None) == english_prose("") == english_prose("  \n ") == []
    assert english_prose("Discoverability presupposes editorial standardization. " + HARD)[:2] == ["discoverability", "presupposes"]
    assert english_prose("x" * 200_000) == []


def test_levels(spark):
    docs = [(k, (EASY if k % 2 else HARD) * 12) for k in range(20)] + [(50, None), (51, ""), (52, EASY), (53, HARD * 12), (54, "Der Hund ist da. Er ist froh. " * 9), (55, LANG * 9)]
    documents = spark.createDataFrame([(*d, "extra") for d in docs], "doc_id bigint, text string, reading_level string")
    labels = spark.createDataFrame([(k, "r", 1 if k % 2 else 5) for k in range(16)] + [(3, "q", None), (99, "q", 3), (None, "q", 2), (4, "q", 9)], "doc_id bigint, rater string, reading_level int")
    got = {r.doc_id: r for r in reading_levels(documents, fit(documents, labels)).collect()}
    assert [got[k].reading_level for k in (17, 18, 53)] == [1, 5, 5]
    assert [(got[k].prose_words, got[k].reading_level, got[k].basis) for k in (50, 51)] == [(0, 1, "none")] * 2
    assert (got[52].reading_level, got[52].basis, got[17].basis) == (1, "shape", "prose")
    assert [(got[k].reading_level, got[k].basis) for k in (54, 55)] == [(1, "shape"), (5, "shape")] and len(got) == len(docs)
    nothing = fit(documents, labels.limit(0))
    assert isinstance(nothing.english, LevelModel) and nothing.english.level(["cat"]) in range(1, 6) and nothing.shape.level(["#3"]) in range(1, 6)
    assert reading_levels(documents.limit(0), nothing).count() == 0
