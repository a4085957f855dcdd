"""Template residue and error-page text.

1. Trusted labels.  A block with an unfilled placeholder or random filler says so itself.  A block is a trusted notice if
   servers say so: it recurs in several different short bodies that were sent with an error status, and hardly ever in a
   long body.  A few texts (`residue_text`) are trusted from the start, for notices that servers send with status 200.
2. Links.  Blocks meet in partitioned SimHash tables; pairs within the Hamming radius are verified by the cosine of their
   words.  Numbers, addresses and ids are masked before.
3. Labels spread from the trusted texts along the links, round by round, until their connected components hold no unlabelled
   text any more.  Labels of placeholders do not spread: the filled copy of a slot is content.
4. A page is residue if any of its blocks is a placeholder or filler, or if beside its notices it has hardly any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.residue_text import FILLER, NOTICE, ORDINARY, masked_words, trusted_texts
from auditloom.llm.simhash import SimHasher, hamming, near_keys, table_keys
from auditloom.session import written

#: Least cosine of the words of two linked blocks.
LEAST_SIMILARITY = 0.8
#: Most differing bits of 256; at the least cosine 52 are expected (standard deviation 6.5).
RADIUS = 72
#: Words beside its notices up to which a page that shows a notice is that notice and nothing else.
NOTICE_PROSE_WORDS = 40
#: Different short bodies with an error status in which a trusted notice occurs, and its most share of long bodies.
LEAST_BODIES, MOST_LONG = 3, 0.1
#: Texts up to which a side is broadcast (their table keys take some 100 kB each); above, both sides are shuffled.
MOST_BROADCAST_TEXTS = 300
_SALTS = 16

_MARK = ["m0", "m1", "m2", "m3"]
_TEXT = ["text", "n", *_MARK]


def block_units(bodies: DataFrame) -> DataFrame:
    """One row for each block: page_id, row (of `bodies`), status_code, prose (ordinary words of the page), body (its
    identity), and the block's kind, words, n (distinct words), fingerprint and text. m0 is null for code and texts without
    words."""
    prose = F.aggregate(F.filter("blocks", lambda b: b["kind"] == ORDINARY), F.lit(0), lambda n, b: n + b["words"])
    rows = bodies.select(
        "page_id", F.monotonically_increasing_id().alias("row"), "status_code", prose.alias("prose"), F.xxhash64("blocks.text").alias("body"), "blocks"
    )
    return rows.select("page_id", "row", "status_code", "prose", "body", F.inline("blocks"))


def trusted(spark: SparkSession) -> DataFrame:
    """kind and the text columns of the texts that are trusted from the start."""
    words = [(kind, masked_words(text)) for kind, text in trusted_texts()]
    marks = SimHasher()([sorted(set(w)) for _, w in words])
    rows = [(kind, " ".join(w), len(set(w)), *mark) for (kind, w), mark in zip(words, marks.tolist())]
    return spark.createDataFrame(rows, "kind int, text string, n int, m0 bigint, m1 bigint, m2 bigint, m3 bigint")


def status_notices(units: DataFrame) -> DataFrame:
    """kind and the text columns of the blocks that servers send as notices."""
    plain = units.where((F.col("kind") == ORDINARY) & F.col("m0").isNotNull())
    short = plain.where((F.col("status_code") >= 400) & (F.col("prose") <= NOTICE_PROSE_WORDS))
    seen = short.groupBy("text").agg(F.count_distinct("body").alias("bodies")).where(F.col("bodies") >= LEAST_BODIES)
    seen = written(seen.select("text"), "residue-recurring")
    counts = [F.count("*").alias("all"), F.count_if(F.col("prose") > NOTICE_PROSE_WORDS).alias("long")]
    counts += [F.first(c).alias(c) for c in _TEXT[1:]]
    # where there are many such texts, pages are counted before they meet, so a hot text is one row for each task
    rows = plain.join(F.broadcast(seen), "text", "left_semi") if seen.count() <= MOST_BROADCAST_TEXTS else plain
    whole = rows.groupBy("text").agg(*counts).join(seen, "text", "left_semi")
    return whole.where(F.col("long") <= MOST_LONG * F.col("all")).select(F.lit(NOTICE).alias("kind"), *_TEXT)


def _linked(units: DataFrame, frontier: DataFrame) -> DataFrame:
    """kind and text columns of the units' texts that are linked to a text of the (written) frontier."""
    least, most, texts = frontier.agg(F.min("n"), F.max("n"), F.count("*")).first()
    # a cosine of s needs sizes whose ratio is s * s at least
    square = LEAST_SIMILARITY**2
    rows = units.where(F.col("n").between(square * least - 1e-9, most / square + 1e-9)).select(*_TEXT)
    side = frontier.select(F.col("kind"), *[F.col(c).alias(f"f_{c}") for c in _TEXT], F.xxhash64("text").alias("f"))
    tables = side.select("f", F.explode(near_keys([F.col(f"f_{m}") for m in _MARK])).alias("key"))
    few = texts <= MOST_BROADCAST_TEXTS
    if not few:
        rows = rows.groupBy("text").agg(*[F.first(c).alias(c) for c in _TEXT[1:]])
    entered = rows.withColumn("key", F.explode(F.array(*table_keys([F.col(m) for m in _MARK]))))
    met = entered.join(F.broadcast(tables) if few else tables, "key").join(F.broadcast(side) if few else side, "f")
    near = met.where(hamming([F.col(m) for m in _MARK], [F.col(f"f_{m}") for m in _MARK]) <= RADIUS)
    common = F.size(F.array_intersect(F.split("text", " "), F.split("f_text", " ")))
    alike = near.where(common >= LEAST_SIMILARITY * F.sqrt(F.col("n") * F.col("f_n")) - 1e-9)
    return alike.groupBy("text").agg(F.max("kind").alias("kind"), *[F.first(c).alias(c) for c in _TEXT[1:]]).select("kind", *_TEXT)


def spread_labels(units: DataFrame, labels: DataFrame) -> DataFrame:
    """kind and text of `labels` and of all texts of `units` in their connected components, each text once.

    `units` has the text columns and should be a written table; of several kinds the greater counts.
    """
    known = labels.groupBy("text").agg(F.max("kind").alias("kind"), *[F.first(c).alias(c) for c in _TEXT[1:]])
    known = frontier = written(known.select("kind", *_TEXT), "residue-labels")
    while not frontier.isEmpty():
        new = _linked(units, frontier).join(known.select("text"), "text", "left_anti")
        frontier = written(new, "residue-spread")
        known = known.unionByName(frontier)
    return known.select("kind", "text")


def residue_pages(bodies: DataFrame) -> DataFrame:
    """page_id of the pages whose main body is residue, each once.

    Pages without main body are none. `bodies` holds page_id, status_code and blocks and is read several times, so it should
    be a written table.
    """
    units = block_units(bodies)
    plain = units.where((F.col("kind") == ORDINARY) & F.col("m0").isNotNull())
    labels = written(spread_labels(plain, trusted(bodies.sparkSession).unionByName(status_notices(units))), "residue-known")
    if labels.count() <= MOST_BROADCAST_TEXTS:
        said = plain.join(F.broadcast(labels.withColumnRenamed("kind", "label")), "text")
    else:  # a text may be on a third of all pages
        salted = labels.select("text", F.col("kind").alias("label"), F.explode(F.lit(list(range(_SALTS)))).alias("salt"))
        said = plain.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int")).join(salted, ["text", "salt"])
    beside = F.col("prose") - F.sum("words")
    judged = said.groupBy("page_id", "row", "prose").agg(beside.alias("beside"), F.max("label").alias("label"))
    linked = judged.where((F.col("label") == FILLER) | (F.col("beside") <= NOTICE_PROSE_WORDS)).select("page_id")
    itself = bodies.where(F.exists("blocks", lambda b: b["kind"] >= FILLER)).select("page_id")
    return linked.unionByName(itself).distinct()
