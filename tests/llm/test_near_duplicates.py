import random

import numpy as np
import pytest

from auditloom.llm import near_duplicates as nd
from auditloom.operators import hot
from auditloom.session import written


def test_bit_sliced_distances():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 1000):
        a, b = rng.integers(0, 256, (2, n, 16), dtype=np.uint8)
        b[::3] = a[::3]
        if n:
            b[0] = ~a[0]
        for radius in (0, 1, 40, 63, 64, 128):
            expected = np.unpackbits(a ^ b, axis=1).sum(1) <= radius
            assert (nd.within_radius(a, b, radius) == expected).all(), (n, radius)


def jaccard(a, b, k):
    x, y = ({tuple(t[i : i + k]) for i in range(max(1, len(t) - k + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def _members(spark, texts, shingle=3):
    rows = [(k, *[v for v in (c or {}).values()]) for k, c in enumerate(nd.sketch_columns([nd.words_of(t) for t in texts], nd.Sketcher(shingle))) if c]
    ddl = "id bigint, class binary, sketch binary, buckets array<bigint>, body string"
    return written(spark.createDataFrame([(i, bytearray(c), bytearray(s), b, t) for i, c, s, b, t in rows], ddl), "t")


def _links(members):
    alike = nd.similarity(3)
    return nd.class_links(members, lambda a, b: alike(a, b) >= 0.7)


def _texts(n, seed=2):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 200))]
        out.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            edited = list(words)
            for _ in range(rng.randrange(4)):
                edited[rng.randrange(len(edited))] = "edit"
            out.append(" ".join(edited))
    return out


@pytest.mark.parametrize("tile", [2, 256])
def test_pairs_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(nd, "TILE", tile)
    monkeypatch.setattr(hot, "LEAST_HOT", 3 if tile == 2 else 20_000)  # hot buckets and classes are split
    texts = _texts(40) + ["", "...", "one", "one", "one two"]
    members = _members(spark, texts)
    got = {tuple(r) for r in nd.all_pairs(members, _links(members)).collect()}
    words = [nd.words_of(t) for t in texts]
    brute = {(i, j) for j in range(len(texts)) for i in range(j) if words[i] and words[j] and jaccard(words[i], words[j], 3) >= 0.7}
    assert got == brute
    classes = {r.id: (r.class_id, r.links) for r in nd.linked_classes(members, _links(members)).collect()}
    same = lambda i, j: jaccard(words[i], words[j], 3) == 1
    assert set(classes) == {k for k, w in enumerate(words) if w}
    for k, (head, links) in classes.items():
        assert head == min(j for j in classes if same(j, k))
        assert links == len({classes[j][0] for i, j in brute | {(b, a) for a, b in brute} if i == k} - {head})


def test_copies_cost_one_class(spark):
    members = _members(spark, ["the same text of five words"] * 30 + ["another one that is different"])
    assert members.select("class").distinct().count() == 2
    assert nd.all_pairs(members, _links(members)).count() == 30 * 29 // 2


def test_nothing_and_very_long_texts(spark):
    members = _members(spark, [])
    assert nd.all_pairs(members, _links(members)).count() == 0
    long = " ".join(f"w{k}" for k in range(60_000))
    members = _members(spark, [long, long + " tail"])
    assert _links(members).count() == 1
    with pytest.raises(ValueError):
        nd.Sketcher(9)


def test_addresses_of_one_page(spark, tmp_path):
    from auditloom.llm import queries

    rows = [
        (1, "a", "https://x.org/p/?b=2&a=1"), (2, "a", "HTTPS://X.org:443//p?a=1&b=2&utm_source=z#top"), (3, "a", "https://x.org/p?a=1&b=2"), (3, "a", "https://x.org/p?a=1&b=2"),
        (4, "a", "https://x.org/p?a=1&b=2"), (5, "b", "https://x.org/p?a=1&b=2"), (6, "a", "http://x.org/p?a=1&b=2"), (7, "a", "https://x.org/p?a=1&b=3"), (8, None, "https://x.org/p"),
        (9, "a", None), (10, "a", ""), (11, "a", " "), (None, "a", "https://x.org/p"),
    ]
    spark.createDataFrame(rows, "keyword_id bigint, audit_id string, page_url string").write.parquet(f"{tmp_path}/page_keywords.parquet")
    members, links = queries._linked(queries._address_members(spark, str(tmp_path)), False)
    same = [1, 2, 3, 4]
    wanted = {(a, b) for a in same for b in same if a < b} | {(10, 11)}
    assert {tuple(r) for r in nd.all_pairs(members, links).distinct().collect()} == wanted
    classes = {r.id: (r.class_id, r.links) for r in nd.linked_classes(members, links).collect()}
    assert classes[1] == (1, 2) and classes[2] == (2, 2) and classes[3] == classes[4] == (3, 2) and classes[7] == (7, 0) and set(classes) == {*range(1, 8), 10, 11}


def test_sketches_of_many_texts_at_once():
    rng = random.Random(3)
    texts = [[f"w{rng.randrange(40)}" for _ in range(n)] for n in (0, 1, 2, 3, 60, 0, 5000)]
    one = [nd.Sketcher(3)(t) for t in texts]
    many = nd.Sketcher(3).many(texts)
    assert [m is None for m in many] == [not t for t in texts] and nd.Sketcher(3).many([]) == []
    assert all(a[:2] == b[:2] and a[2].tolist() == b[2].tolist() for a, b in zip(many, one) if a)
    # by the definition: the least of all products for each of the multipliers
    least = (nd.Sketcher(3).sequences(texts[4])[:, None] * nd._MULTIPLY).min(0)
    bits = (((least ^ (least >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(63)).astype(np.uint8)
    assert np.packbits(bits).tobytes() == many[4][1]
