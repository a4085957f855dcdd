import hashlib
import re
from random import Random

import numpy as np

from auditloom.llm.blocks import leaf_blocks
from auditloom.llm.crf import Chain, fit
from auditloom.llm.main_body import BodyFinder, label_page, page_features, train
from auditloom.llm.pages import KEYS, fit_model, main_body_keys, page_bodies
from auditloom.llm import residue
from auditloom.llm.residue import residue_pages, spread_labels
from auditloom.llm.residue_text import FILLER, NOTICE, ORDINARY, PLACEHOLDER, block_kind, has_placeholder, masked_words, trusted_texts
from auditloom.llm.simhash import SimHasher
from auditloom.session import written


def page(k, body=None, layout=0):
    prose = body or f"<h1>Story {k} of the mill</h1><p>Every mill in town {k} keeps a ledger of grain that its millers weigh.</p><ul><li>The {k} bags stand beside the door, ready and dry.</li></ul><p>Nobody moved them before noon.</p>"
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "Shop", "News", "Help"))
    side = f'<div class="teaser"><h4><a href="/t">Another tale {k}</a></h4><p>A short teaser text that leads to some other page.</p></div>'
    foot = "<p>© 2024 Mill. All rights reserved.</p>"
    if layout == 0:
        return f'<html><body><nav><ul>{nav}</ul></nav><article>{prose}</article><aside>{side}</aside><footer>{foot}</footer></body></html>'
    return f'<body><div class="navbar"><ul>{nav}</ul></div><div class="row"><div class="content">{prose}</div><div class="side">{side}</div></div><div class="footer">{foot}</div><noscript><p>Turn on scripts.</p></noscript></body>'


PAGES = [page(k, layout=k % 2) for k in range(40)]


def test_blocks():
    blocks = leaf_blocks("<div>loose<p>One <b>two</b>&amp;three<p>next<ul><li>x<li>y</ul></div><pre><code>{{ a }}</code></pre>tail")
    assert [(b.text, b.tag, b.leaf, b.code) for b in blocks] == [
        ("loose", "div", False, False), ("One two&three", "p", True, False), ("next", "p", True, False), ("x", "li", True, False), ("y", "li", True, False),
        ("{{ a }}", "pre", True, True), ("tail", "body", False, False),
    ]
    for html in (None, "", "   ", "<", "<p", "</p></div>", "<!-- never closed", "<script>x", "<p a='>x", "x" * 100_000, "<div>" * 3000):
        leaf_blocks(html)


def test_crf_learns_a_chain():
    rows = [[["a"], ["b"], ["b"], ["c"]], [["c"], ["a"], ["b"]], [["b"], ["b"]]] * 5
    labels = [[0, 1, 1, 0], [0, 0, 1], [1, 1]] * 5
    model = fit(rows, labels)
    assert [model.decode([model.score(f) for f in r]) for r in rows[:3]] == labels[:3]
    assert fit([], []).decode([]) == [] and Chain().decode([0.0, 0.0]) == [0, 0]


def test_gradient_matches_brute_force_likelihood():
    # the decoded path of a fitted model is the best of all paths
    import itertools

    model = fit([[["x"], ["y"], ["x", "y"]]] * 4, [[0, 1, 1]] * 4, steps=30)
    scores = [0.3, -0.2, 0.1]

    def value(path):
        t = model.transition
        return sum(s for s, y in zip(scores, path) if y) + (model.start if path[0] else 0) + (model.end if path[-1] else 0) + sum(t[a][b] for a, b in zip(path, path[1:]))

    assert model.decode(scores) == list(max(itertools.product((0, 1), repeat=3), key=value))


def test_held_out_accuracy():
    model = train(PAGES[:20])
    finder = BodyFinder(model)
    wrong = total = 0
    for html in PAGES[20:]:
        blocks = leaf_blocks(html)
        gold = label_page(blocks)
        made = finder.labels(blocks)
        assert made == model.decode([model.score(f) for f in page_features(blocks)])
        wrong += sum(a != b for a, b in zip(gold, made))
        total += len(gold)
    assert wrong / total < 0.02


def test_kinds_of_blocks():
    def kind(html):
        return block_kind(leaf_blocks(html)[0])

    for slot in ("{{ name }}", "{{{city}}}", "${price}", "#{phone}", "{title}", "{0}", "%BRAND%", "%%PHONE%%", "$CITY$", "@@X_Y@@", "__PAGE_TITLE__", "*|COMPANY|*", "&lt;%= x %&gt;", "{% block a %}", "[[price]]", "[INSERT CITY]", "[TBD: price]", "[Your Company]", "«brand»"):
        assert kind(f"<p>Welcome to {slot} today.</p>") == PLACEHOLDER, slot
    for text in ("The price is $40 for the set {red, blue}.", "[sic] and [translated]", "Costs 5% or 10% [1]", "a_b__c", "today every price shows $ and % side by side", "«rue»"):
        assert not has_placeholder(text), text
    assert kind("<pre><code>{{ name }}</code></pre>") == ORDINARY and kind("<p><code>{{ name }}</code></p>") == ORDINARY
    assert kind("<p>Lorem ipsum dolor sit amet, quis enim ad minim.</p>") == FILLER
    for text in ("Sed pulvis amet non ventus calor orbis.", "Lorem ipsum terra orbis mira ludum.", "qwer blah foo asdf test", "xxx xxx xxx tbd"):
        assert kind(f"<p>{text}</p>") == FILLER, text
    assert kind("<p>Une dolor de la main, non, et ad hoc.</p>") == ORDINARY
    assert kind("<p>Designers once filled brochures with lorem ipsum, and many of our leaflets show it.</p>") == ORDINARY
    assert masked_words("GET /a/b.html (HTTP 404): it's 12:30, id x9-f!") == ["get", "0", "http", "404", "it's", "0", "id", "0"]
    assert masked_words(" — ... ") == []


def test_simhash():
    hasher = SimHasher()
    a, b, c, none = hasher([list("abcdefgh"), list("hgfedcba"), list("zyxwvuts"), []]).tolist()
    assert a == b != c and none == [0] * 4
    assert hasher([["x"]]).tolist() == SimHasher()([["x"]]).tolist()
    many = [[f"w{k}x{j}" for j in range(900)] for k in range(40)]  # several flushes
    assert hasher(many).tolist() == [SimHasher()([w]).tolist()[0] for w in many]


TEXTS = "text string, n int, m0 bigint, m1 bigint, m2 bigint, m3 bigint"


def _units(spark, texts, kind=None):
    words = [t.split() for t in texts]
    rows = [(t, len(set(w)), *m) for t, w, m in zip(texts, words, SimHasher()([sorted(set(w)) for w in words]).tolist())]
    return spark.createDataFrame(rows, TEXTS) if kind is None else spark.createDataFrame([(kind, *r) for r in rows], "kind int, " + TEXTS)


def _cosine(a, b):
    return len(a & b) / (len(a) * len(b)) ** 0.5


def test_labels_reach_what_brute_force_links(spark, monkeypatch):
    # blocks of 5 to 20 words, half of them made from trusted ones by replacing, dropping or adding up to three words
    random = Random(6)
    common = [f"a{k}" for k in range(12)]

    def block(n):
        return [random.choice(common) if random.random() < 0.3 else f"word{random.randrange(400)}" for _ in range(n)]

    def changed(words):
        words = list(words)
        for k in range(random.randrange(1, 4)):
            at = random.randrange(len(words))
            words[at : at + random.randrange(2)] = [f"new{k}x{random.randrange(50)}"] * random.randrange(2)
        return words

    seeds = [block(n) for n in range(5, 21) for _ in range(6)]
    plain = [block(5 + k % 16) for k in range(200)] + [changed(random.choice(seeds)) for _ in range(400)]
    plain += [changed(w) for w in plain[200:]]
    known = {" ".join(w) for w in seeds}
    texts = {" ".join(w) for w in plain if w} - known
    sets = {t: set(t.split()) for t in texts | known}
    wanted, frontier = set(), known
    while frontier:
        frontier = {t for t in texts - wanted if any(_cosine(sets[t], sets[f]) >= 0.8 - 1e-9 for f in frontier)}
        wanted |= frontier
    units, labels = written(_units(spark, sorted(texts) * 2), "t"), _units(spark, sorted(known), NOTICE)
    got = {r.text for r in spread_labels(units, labels).collect()} - known
    # nothing false comes out, and the tables (probabilistic) miss hardly anything that brute force links
    assert len(wanted) > 500 and got <= wanted and len(got) >= 0.98 * len(wanted)
    monkeypatch.setattr(residue, "MOST_BROADCAST_TEXTS", 0)
    assert {r.text for r in spread_labels(units, labels).collect()} - known == got
    assert spread_labels(units.limit(0), labels.limit(0)).count() == 0


def test_held_out_notices_are_reached(spark):
    # variants of trusted texts; none is among them
    held_out = [
        "please enable javascript to view this shop page", "you really need to enable scripts to view this page", "this application requires a browser with scripting",
        "sorry page not found", "type your own paragraph here replace it before launch", "sample paragraph 0 this is dummy copy to be replaced",
    ]
    seeds = {" ".join(masked_words(t)) for _, t in trusted_texts()}
    assert not seeds & set(held_out)
    other = ["the mill in town keeps a ledger of grain", "this site sells javascript books"]
    got = {r.text: r.kind for r in spread_labels(_units(spark, held_out + other), residue.trusted(spark)).collect() if r.text not in seeds}
    assert got == {t: FILLER if "paragraph" in t else NOTICE for t in held_out}


def _bodies(spark, pages):
    rows = []
    for page_id, status, texts in pages:
        words = [masked_words(t) for t in texts]
        marks = SimHasher()([sorted(set(w)) for w in words]).tolist()
        rows.append((page_id, status, [(0, len(w), len(set(w)), *m, " ".join(w)) for w, m in zip(words, marks)]))
    return spark.createDataFrame(rows, "page_id bigint, status_code int, blocks array<struct<kind:tinyint,words:int,n:int,m0:bigint,m1:bigint,m2:bigint,m3:bigint,text:string>>")


def test_notices_that_servers_send_are_trusted(spark, monkeypatch):
    tale = "Every mill in town keeps a ledger of grain that its millers weigh {} before the {} bell rings in the tower and nobody minds the dust that settles on the sacks while the wheel turns on through the long {} night of winter and the frost"
    notice, near = "The kettle is off for service today", "The kettle is off for our service today"
    pages = [(k, 503, [notice, f"Ask clerk {'abcdefgh'[k]} instead"]) for k in range(4)]
    pages += [(10, 200, [notice]), (11, 200, [near]), (12, 200, ["The kettle sings"]), (13, 404, ["The kettle sings twice"]), (14, None, ["Another tale"])]
    pages += [(20 + k, 500, [tale.format(k, "x" * k, "y" * k), "Read on"]) for k in range(5)] + [(30 + k, 500, [f"Short {'abcdefgh'[k]}", "Read on"]) for k in range(4)]
    pages += [(40, 200, [notice, tale.format("a", "b", "c")]), (10, 200, [notice]), *((50 + k, 200, [notice]) for k in range(6))]
    got = [r.page_id for r in residue_pages(written(_bodies(spark, pages), "t")).collect()]
    assert sorted(got) == [0, 1, 2, 3, 10, 11, *range(50, 56)]
    monkeypatch.setattr(residue, "MOST_BROADCAST_TEXTS", 0)
    assert sorted(r.page_id for r in residue_pages(written(_bodies(spark, pages), "t")).collect()) == sorted(got)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 200, "x", 1) for r in rows], "page_id bigint, html string, status_code int, blocks string, text int")


def test_page_queries(spark):
    notice = "<h1>Access denied</h1><p>Go back to the homepage.</p>"
    slot = "<h1>Story of the mill</h1><p>Every mill {{city}} keeps a ledger of grain that its millers weigh.</p>"
    rows = [(k, h) for k, h in enumerate(PAGES)] + [(100, notice), (101, page(1, slot)), (102, None), (103, ""), (104, "<script>x</script>"), (0, PAGES[0]), (None, PAGES[1])]
    pages = _frame(spark, rows)
    bodies = written(page_bodies(pages, fit_model(pages), KEYS), "t")
    residue = residue_pages(bodies)
    assert sorted(r.page_id for r in residue.collect()) == [100, 101]
    keys = main_body_keys(bodies, residue)
    got = {r.block_key for r in keys.where("page_id = 3").collect()}
    texts = ["Story 3 of the mill", "Every mill in town 3 keeps a ledger of grain that its millers weigh.", "The 3 bags stand beside the door, ready and dry.", "Nobody moved them before noon."]
    assert got == {hashlib.md5(re.sub("[^a-z0-9]", "", t.lower()).encode()).hexdigest() for t in texts}
    assert keys.count() == keys.distinct().count() and keys.where("page_id in (100, 101, 102, 103, 104)").count() == 0
    empty = written(page_bodies(pages.limit(0), fit_model(pages.limit(0)), KEYS), "t")
    assert residue_pages(empty).count() == 0 and main_body_keys(empty, residue_pages(empty)).count() == 0


def test_signs_are_counted_in_bytes():
    hasher = SimHasher()
    sets = [[f"w{i}" for i in range(n)] for n in (1, 2, 254, 255, 256, 510, 511, 900)]
    got = hasher(sets)
    assert hasher._signs.itemsize == 1
    for words, mark in zip(sets, got):
        signs = 2 * hasher._signs[[hasher._index[w] for w in words]].astype(int) - 1
        assert np.packbits(signs.sum(0) > 0).view(np.int64).tolist() == mark.tolist()


def test_white_space_before_a_block_counts_for_its_share_of_code():
    shown = lambda html: [(b.text, b.code) for b in leaf_blocks(html)]
    assert shown("<p>      <code>abcd</code></p><p>ab<code>abcd</code></p>") == [("abcd", False), ("ababcd", True)]
    assert shown("<p>a<script>1 < 2 <p>no</script> b</p><textarea><p>no") == [("a b", False)]
