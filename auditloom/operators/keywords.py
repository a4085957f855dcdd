"""Keywords of pages: TF-IDF over n-grams with boosts by place, profiles, and pages that compete for one phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import text as tx
from auditloom.operators.rules import FINDING, finding, listed, quoted
from auditloom.session import written

# --- fixed values: boosts by place and by length of the phrase ---
TITLE_BOOST, H1_BOOST, SUBHEADING_BOOST, SLUG_BOOST = 3.0, 2.5, 1.5, 2.0
PAIR_FACTOR, TRIPLE_FACTOR = 2.2, 2.8
TOP_TERMS, SECONDARIES, LEAST_WORDS = 10, 5, 5
NO_KEYWORD = "general"
CONFLICT = "keywords.cannibalization"
SAME_KEYWORD = "Keyword cannibalization detected: %d pages are competing for the exact same primary keyword (%s)"
PART_OF_KEYWORD = "Keyword cannibalization overlap: Page targeting %s competes directly with %s targeting %s"
# -----------------------------------------------------------------
#: pages of an audit that one task takes, at most, and audits that may have more (what is broadcast about them is bounded by it)
LOCAL_PAGES, MOST_LARGE = 10_000, 1000
#: pages of a task when whole audits are counted in tasks
TASK_PAGES = 1000


def term_counts(texts: DataFrame) -> DataFrame:
    """audit_id, page_id, term, n and total (all terms of the page) from audit_id, page_id and body_text.

    Terms are counted inside each page's row before anything is shuffled, so the shuffle carries distinct terms only.
    """
    terms = tx.ngrams(tx.keyword_tokens(F.col("body_text")))
    counted = texts.select("audit_id", "page_id", terms.alias("terms")).select(
        "audit_id", "page_id", F.size("terms").alias("total"), F.explode("terms").alias("term")
    )
    return counted.groupBy("audit_id", "page_id", "term", "total").agg(F.count("*").alias("n"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("audit_id", "term").agg(F.count("*").alias("pages"))


def _inverse_frequency() -> Column:
    return F.ln((F.lit(1.0) + F.col("docs")) / (F.lit(1.0) + F.col("pages"))) + F.lit(1.0)


def tf_idf(counts: DataFrame, pages: DataFrame) -> DataFrame:
    """counts with `base`: n / (total + 1) * (ln((1 + pages of the audit) / (1 + pages with the term)) + 1)."""
    sizes = pages.groupBy("audit_id").agg(F.count("*").alias("docs"))
    joined = counts.join(document_frequency(counts), ["audit_id", "term"]).join(sizes, "audit_id")
    return joined.withColumn("base", F.col("n") / (F.col("total") + 1) * _inverse_frequency())


def _phrase_factor(term: Column) -> Column:
    words = F.size(F.split(term, " "))
    return F.when(words == 2, PAIR_FACTOR).when(words == 3, TRIPLE_FACTOR).otherwise(1.0)


def boosted(scored: DataFrame, boost: Column | None = None) -> DataFrame:
    """scored with `score`, rounded to ten digits so that equal terms tie on every engine.

    `boost` is that of the term's places in its page (`place_boost`). Without it only the length of the phrase counts.
    """
    score = F.round(F.col("base") * (F.lit(1.0) if boost is None else boost) * _phrase_factor(F.col("term")), 10)
    return scored.withColumn("score", score)


def place_boost(term: Column) -> Column:
    """1, raised for each of the lower-case texts title, h1, subheadings and slug of the page that contains the term."""
    boost: Column = F.lit(1.0)
    for name, value in (("title", TITLE_BOOST), ("h1", H1_BOOST), ("subheadings", SUBHEADING_BOOST), ("slug", SLUG_BOOST)):
        boost = boost + F.when(F.contains(F.col(name), term), value).otherwise(0.0)
    return boost


def page_terms(pages: DataFrame, *kept: str) -> DataFrame:
    """audit_id, page_id, the columns `kept`, total, term, n and boost: the terms of every page, counted inside its row."""

    def counted(terms: Column) -> Column:
        last = F.size(terms)
        starts = F.filter(F.sequence(F.lit(0), last - 1), lambda k: (k == 0) | (F.get(terms, k) != F.get(terms, k - 1)))
        runs = tx.let(starts, lambda at: F.transform(at, lambda k, i: F.struct(F.get(terms, k).alias("term"), (F.coalesce(F.get(at, i + 1), last) - k).alias("n"))))
        return F.when(last > 0, runs)

    keys = ["audit_id", "page_id", *kept]
    places = ["title", "h1", "subheadings", "slug"]
    terms = pages.select(*keys, *places, F.sort_array(tx.ngrams(tx.keyword_tokens(F.col("body_text")))).alias("terms"))
    runs = terms.select(*keys, *places, F.size("terms").alias("total"), tx.let(F.col("terms"), counted).alias("runs"))
    # inline would compute the runs once more, to filter by their number
    rows = runs.select(*keys, *places, "total", F.inline_outer("runs")).where("term is not null")
    return rows.select(*keys, "total", "term", "n", place_boost(F.col("term")).alias("boost"))


def ranked_terms(scored: DataFrame) -> DataFrame:
    """Terms of each page with their `place`, by score descending, then term ascending (bytes)."""
    order = Window.partitionBy("audit_id", "page_id").orderBy(F.desc("score"), F.asc("term"))
    return scored.withColumn("place", F.row_number().over(order))


def top_terms(ranked: DataFrame, n: int = TOP_TERMS) -> DataFrame:
    return ranked.where(F.col("place") <= n)


def primary_keywords(ranked: DataFrame, pages: DataFrame) -> DataFrame:
    """audit_id, page_id, primary_keyword of every page; `general` for a page without terms."""
    first = ranked.where("place = 1").select("audit_id", "page_id", F.col("term").alias("primary_keyword"))
    every = pages.select("audit_id", "page_id").join(first, ["audit_id", "page_id"], "left")
    return every.na.fill(NO_KEYWORD, ["primary_keyword"])


def secondary_keywords(ranked: DataFrame) -> DataFrame:
    """audit_id, page_id, term, place: the first five terms after the primary one that neither contain it nor lie in it."""
    first = ranked.where("place = 1").select("audit_id", "page_id", F.col("term").alias("primary"))
    apart = ~F.contains(F.col("primary"), F.col("term")) & ~F.contains(F.col("term"), F.col("primary"))
    rest = ranked.where("place > 1").join(first, ["audit_id", "page_id"]).where(apart)
    order = Window.partitionBy("audit_id", "page_id").orderBy("place")
    return rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SECONDARIES).select("audit_id", "page_id", "term", "rank")


def _chosen(scored: DataFrame) -> DataFrame:
    """audit_id, page_id, primary_keyword, secondary_keywords and top_terms of every page with terms, from its scored terms."""
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "term", "n")))
    found = scored.groupBy("page_id", "audit_id").agg(ranked.alias("r")).withColumn("primary_keyword", F.get("r", F.lit(0))["term"])
    first = F.col("primary_keyword")
    apart = F.filter("r", lambda x: ~F.contains(first, x["term"]) & ~F.contains(x["term"], first))
    seconds = tx.let(F.transform(F.slice(apart, 1, SECONDARIES), lambda x: x["term"]), lambda s: F.when(F.size(s) > 0, s))
    tops = F.transform(
        F.slice("r", 1, TOP_TERMS),
        lambda x, k: F.struct(
            (k + 1).alias("place"), x["term"].alias("term"), (-x["s"]).alias("score"), F.size(F.split(x["term"], " ")).alias("n_gram_type"),
            x["n"].cast("bigint").alias("occurrences"),
        ),
    )
    return found.select("audit_id", "page_id", "primary_keyword", seconds.alias("secondary_keywords"), tops.alias("top_terms"))


def page_profiles(parsed: DataFrame, local_pages: int = LOCAL_PAGES) -> DataFrame:
    """audit_id, tenant_id, page_id, page_url, primary_keyword, secondary_keywords, top_terms, named_entities of valid pages.

    A page's terms take several times the room of its text. So texts are shuffled by audit and all terms of an audit are counted
    in one task, which sorts them and may spill; only audits of more than `local_pages` pages have their terms shuffled.
    """
    valid = parsed.where("status_code = 200 and parse_status = 'success'").where(F.col("word_count") >= LEAST_WORDS).dropDuplicates(["page_id"])

    def level(k: int) -> Column:
        return F.array_join(F.transform(F.filter("headings", lambda h: h["level"] == k), lambda h: h["text"]), " ")

    slug = F.replace(F.regexp_replace(F.regexp_extract("url", r"([^/?#]*)/*(?:[?#].*)?$", 1), r"\.html$", ""), F.lit("-"), F.lit(" "))
    pages = written(
        valid.select(
            "audit_id", "tenant_id", "page_id", F.col("url").alias("page_url"), tx.named_entities(F.col("body_text")).alias("named_entities"), "body_text",
            F.lower("title").alias("title"), F.lower(level(1)).alias("h1"), F.lower(F.concat(level(2), F.lit(" "), level(3))).alias("subheadings"),
            F.lower(slug).alias("slug"),
        ),
        "profiled",
    )
    sizes = pages.groupBy("audit_id").agg(F.count("*").alias("docs"))
    number, most = sizes.agg(F.sum("docs"), F.max("docs")).first()
    bound = max(local_pages, -(-(number or 0) // MOST_LARGE))
    large = sizes.where(F.col("docs") > bound) if (most or 0) > bound else None
    small = pages if large is None else pages.join(F.broadcast(large.select("audit_id")), "audit_id", "left_anti")

    base = F.col("n") / (F.col("total") + 1) * _inverse_frequency()
    tasks = max(1, -(-(number or 0) // TASK_PAGES))
    whole = small.repartition(tasks, "audit_id").withColumn("docs", F.count("*").over(Window.partitionBy("audit_id")))
    # the hash comes first so that the sort compares numbers
    terms = page_terms(whole, "docs").withColumn("h", F.xxhash64("audit_id", "term"))
    known = terms.withColumn("pages", F.count("*").over(Window.partitionBy("h", "audit_id", "term")))
    chosen = _chosen(boosted(known.withColumn("base", base), F.col("boost")))
    if large is not None:
        shared = F.broadcast(large)
        counts = written(page_terms(pages.join(shared, "audit_id"), "docs"), "terms")
        joined = counts.hint("merge").join(document_frequency(counts), ["audit_id", "term"])
        chosen = chosen.unionByName(_chosen(boosted(joined.withColumn("base", base), F.col("boost"))))

    keys = ["audit_id", "page_id"]
    rows = pages.select("audit_id", "tenant_id", "page_id", "page_url", "named_entities").hint("merge").join(chosen, keys, "left")
    return rows.na.fill(NO_KEYWORD, ["primary_keyword"])


def keyword_map(profiles: DataFrame) -> DataFrame:
    """audit_id, keyword, urls (distinct, ascending), pages: which pages want a keyword."""
    return profiles.groupBy("audit_id", F.col("primary_keyword").alias("keyword")).agg(
        F.sort_array(F.collect_set("page_url")).alias("urls"), F.count_distinct("page_url").alias("pages")
    )


def exact_conflicts(profiles: DataFrame) -> DataFrame:
    """Keywords of several pages of an audit, `general` and empty ones apart."""
    return keyword_map(profiles).where((F.col("pages") > 1) & (F.col("keyword") != NO_KEYWORD) & (F.col("keyword") != ""))


def overlapping_keywords(profiles: DataFrame) -> DataFrame:
    """audit_id, inner_keyword, outer_keyword: different keywords of an audit of which one contains the other, each pair once.

    Every stretch of a keyword's text is looked up among the audit's keywords by an equality join, so the work grows with
    the keywords (and the square of their short length), not with the pairs of keywords.
    """
    keywords = profiles.where((F.col("primary_keyword") != NO_KEYWORD) & (F.length("primary_keyword") > 0))
    keywords = keywords.select("audit_id", F.col("primary_keyword").alias("outer_keyword")).distinct()
    n = F.length("outer_keyword")
    starts = F.sequence(F.lit(1), n)
    pieces = F.flatten(
        F.transform(starts, lambda a: F.transform(F.sequence(F.lit(1), n - a + 1), lambda k: F.substring("outer_keyword", a, k)))
    )
    inner = keywords.select("audit_id", "outer_keyword", F.explode(F.array_distinct(pieces)).alias("inner_keyword"))
    known = keywords.select("audit_id", F.col("outer_keyword").alias("inner_keyword"))
    return inner.where("inner_keyword != outer_keyword").join(known.hint("merge"), ["audit_id", "inner_keyword"], "left_semi").select("audit_id", "inner_keyword", "outer_keyword")


def conflict_findings(profiles: DataFrame) -> DataFrame:
    """Findings on pages of an audit that compete for a keyword: one for each keyword of several pages, on its first page, and
    one for each ordered pair of different keywords of which one contains the other, on the first page that wants the first
    of them and has a page that wants the second behind it. Pages are in order of page_id. No side is bounded, so none is
    broadcast."""
    rows = profiles.where((F.col("primary_keyword") != NO_KEYWORD) & (F.col("primary_keyword") != ""))
    rows = rows.select("audit_id", "tenant_id", "page_id", "page_url", F.col("primary_keyword").alias("keyword"))
    keys = ["audit_id", "keyword"]
    firsts = rows.groupBy(*keys).agg(F.min(F.struct("page_id", "page_url", "tenant_id")).alias("first"))
    several = listed(rows, keys, "page_url", ["page_id", "page_url"], "competing_urls").where("pages > 1").join(firsts.hint("merge"), keys)
    same = finding(
        CONFLICT,
        {"target_keyword": F.col("keyword"), "competing_urls": F.col("competing_urls")},
        F.format_string(SAME_KEYWORD, F.col("pages"), quoted(F.col("keyword"))),
    )
    exact = several.select("audit_id", F.col("first.tenant_id").alias("tenant_id"), F.col("first.page_url").alias("page_url"), F.inline(F.array(same)))
    inner, outer = F.col("inner_keyword"), F.col("outer_keyword")
    both = F.array(F.struct(inner.alias("k1"), outer.alias("k2")), F.struct(outer.alias("k1"), inner.alias("k2")))
    pairs = overlapping_keywords(profiles).select("audit_id", F.inline(both))
    led = pairs.hint("merge").join(firsts.select("audit_id", F.col("keyword").alias("k1"), "first"), ["audit_id", "k1"])
    behind = led.hint("merge").join(rows.select("audit_id", F.col("keyword").alias("k2"), "page_id", F.col("page_url").alias("other")), ["audit_id", "k2"])
    met = behind.where(F.col("page_id") > F.col("first.page_id")).groupBy("audit_id", "k1", "k2").agg(
        F.min("first").alias("first"), F.min_by("other", F.struct("page_id", "other")).alias("other")
    )
    part = finding(
        CONFLICT,
        {"keyword_1": F.col("k1"), "keyword_2": F.col("k2"), "competing_urls": F.array("first.page_url", "other")},
        F.format_string(PART_OF_KEYWORD, quoted(F.col("k1")), F.col("other"), quoted(F.col("k2"))),
    )
    overlap = met.select("audit_id", F.col("first.tenant_id").alias("tenant_id"), F.col("first.page_url").alias("page_url"), F.inline(F.array(part)))
    return exact.select(*FINDING).unionByName(overlap.select(*FINDING))
