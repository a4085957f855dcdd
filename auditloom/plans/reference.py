"""Queries of the audit operators over the whole tables, and their SQL.

`documents` stand for parsed pages with `site` as the audit, `page_keywords`, `audit_findings`, `crawl_pages` and the rest for
themselves. Copies of a row count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import text as tx
from auditloom.functions import urls as ux
from auditloom.operators import audit, graph, keywords, report, rules, scoring
from auditloom.operators.html_facts import parsed_pages
from auditloom.sources.crawl import crawl_summary
from auditloom.session import table, written
from auditloom.streaming.events import admitted, completed, undelivered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def _findings(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "audit_findings").dropDuplicates(["finding_id"])


def _pages(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "crawl_pages").dropDuplicates(["page_id"])


def _page_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Scores of all pages: those crawled, clean ones too, and those that only findings name."""
    crawled = table(spark, directory, "crawl_pages").select("audit_id", F.col("url").alias("page_url"))
    return scoring.page_scores(_findings(spark, directory), crawled.where("audit_id is not null and page_url is not null"))


def _parsed(spark: SparkSession, directory: str) -> DataFrame:
    return written(parsed_pages(_pages(spark, directory)), "parsed")


def _texts(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "documents").where("text is not null")
    return rows.select(F.col("site").alias("audit_id"), F.col("doc_id").alias("page_id"), F.col("text").alias("body_text"))


# --- URLs ---------------------------------------------------------------------------------------------------------------------
_URL = r"'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?'"


def _sql_parts(column: str) -> str:
    return f"""lower(regexp_extract({column}, {_URL}, 1)) AS s, regexp_extract({column}, {_URL}, 2) AS a,
      regexp_extract({column}, {_URL}, 3) AS p, regexp_extract({column}, {_URL}, 4) AS q"""


_URLS = f"WITH u AS (SELECT DISTINCT keyword_id, page_url, {_sql_parts('page_url')} FROM page_keywords)"
_BARE = "regexp_replace(lower(regexp_replace(a, '^.*@', '')), CASE s WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '')"
_MARK = "CASE WHEN q <> '' THEN '?' || q ELSE '' END"


def _addresses(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "page_keywords").select("keyword_id", "page_url").distinct()


@query(f"{_URLS} SELECT keyword_id, s || '://' || {_BARE} || regexp_replace(p, '/$', '') || {_MARK} AS address FROM u")
def url_crawl_address(spark: SparkSession, directory: str) -> DataFrame:
    return _addresses(spark, directory).select("keyword_id", ux.crawl_address(F.col("page_url")).alias("address"))


@query(f"""WITH r AS (SELECT DISTINCT audit_id, updated_at, trim(raw_url) AS url FROM audits),
    u AS (SELECT audit_id, updated_at, url, {_sql_parts('url')} FROM r),
    e AS (SELECT *, CASE WHEN url = '' THEN 'URL must not be empty' WHEN s = '' OR a = '' THEN 'URL must be absolute'
      WHEN s NOT IN ('http', 'https') THEN 'unsupported scheme' END AS error FROM u)
    SELECT audit_id, updated_at, error,
      CASE WHEN error IS NULL THEN s || '://' || {_BARE} || regexp_replace(p, '/+$', '') || {_MARK} END AS address FROM e""")
def url_submitted_address(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "audits").select("audit_id", "updated_at", "raw_url").distinct()
    return rows.select("audit_id", "updated_at", ux.submitted_error(F.col("raw_url")).alias("error"), ux.submitted_address(F.col("raw_url")).alias("address"))


@query(f"""{_URLS} SELECT keyword_id, CASE WHEN s <> '' THEN s || ':' ELSE '' END || CASE WHEN a <> '' THEN '//' || lower(a) ELSE '' END
      || regexp_replace(p, '/+$', '') || {_MARK} AS address FROM u""")
def url_matching_address(spark: SparkSession, directory: str) -> DataFrame:
    return _addresses(spark, directory).select("keyword_id", ux.matching_address(F.col("page_url")).alias("address"))


@query(f"""{_URLS} SELECT keyword_id, regexp_extract(lower(regexp_replace(a, '^.*@', '')), '^([^:]*)', 1) AS host,
      CASE WHEN trim(p, '/') = '' THEN 0 ELSE len(string_split(trim(p, '/'), '/')) END AS depth,
      len(list_distinct(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1)))) AS parameters,
      regexp_replace(list_filter(string_split(q, '&'), lambda x: split_part(x, '=', 1) = 'id' AND x <> '')[1], '^[^=]*=?', '') AS id FROM u""")
def url_parts(spark: SparkSession, directory: str) -> DataFrame:
    u = F.col("page_url")
    return _addresses(spark, directory).select(
        "keyword_id", ux.host(u).alias("host"), ux.path_depth(u).alias("depth"), ux.parameter_count(u).alias("parameters"),
        ux.first_parameter(u, "id").alias("id"),
    )


_SEGMENT = "regexp_replace(regexp_extract(regexp_replace(p, '/+$', ''), '([^/]*)$', 1), '\\.html$', '')"


@query(f"""{_URLS} SELECT keyword_id, replace({_SEGMENT}, '-', ' ') AS slug,
      CASE WHEN p IN ('', '/') THEN '' ELSE array_to_string(list_filter(regexp_split_to_array(lower({_SEGMENT}), '[-_]+'),
        lambda w: strlen(w) >= 3 AND w NOT IN ('the', 'a', 'an', 'and', 'of', 'in', 'to', 'for')), ' ') END AS words FROM u""")
def url_slugs(spark: SparkSession, directory: str) -> DataFrame:
    u = F.col("page_url")
    return _addresses(spark, directory).select("keyword_id", ux.slug_text(u).alias("slug"), F.array_join(ux.slug_keywords(u), " ").alias("words"))


# --- texts --------------------------------------------------------------------------------------------------------------------
_WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FIELDS = f"list_filter(regexp_split_to_array(%s, '{_WS}+'), lambda x: x <> '')"
_SYLLABLES = r"len(regexp_extract_all(regexp_replace(w, '[^\p{L}]', '', 'g'), '[aeiouy]+'))"
_COUNTED = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    c AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\p{{L}}\p{{Nd}}]+')) AS words, strlen(text) AS bytes,
      greatest(1, len(regexp_extract_all(text, '[.!?]'))) AS sentences,
      coalesce(list_sum(list_transform({_FIELDS % 'lower(text)'}, lambda w: greatest(1, {_SYLLABLES}
        - CASE WHEN w[-1] = 'e' AND {_SYLLABLES} > 1 THEN 1 ELSE 0 END))), 0) AS syllables FROM t)"""
_EASE = "CASE WHEN words = 0 THEN 100.0 ELSE greatest(0.0, least(100.0, 206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words))) END"


@query(f"{_COUNTED} SELECT doc_id, words, bytes, sentences, syllables, round({_EASE}, 6) AS ease FROM c")
def text_measures(spark: SparkSession, directory: str) -> DataFrame:
    t = F.col("text")
    rows = table(spark, directory, "documents").select("doc_id", "text", tx.word_count(t).alias("words"))
    return rows.select(
        "doc_id", "words", tx.byte_count(t).alias("bytes"), tx.sentence_count(t).alias("sentences"), tx.syllable_count(t).alias("syllables"),
        F.round(tx.reading_ease(t, F.col("words")), 6).alias("ease"),
    )


@query(f"""{_COUNTED} SELECT doc_id, rule_id FROM (
      SELECT doc_id, 'onpage.thin_content' AS rule_id FROM c WHERE words < 250
      UNION ALL SELECT doc_id, 'onpage.readability_difficult' FROM c WHERE words >= 100 AND {_EASE} < 30)""")
def text_rules(spark: SparkSession, directory: str) -> DataFrame:
    """The two rules on length and readability over the documents."""
    rows = table(spark, directory, "documents").select(
        F.col("doc_id").cast("string").alias("url"), F.lit("").alias("audit_id"), F.lit("").alias("tenant_id"),
        F.coalesce("text", F.lit("")).alias("body_text"), tx.word_count(F.col("text")).alias("word_count"),
    )
    ease = tx.reading_ease(F.col("body_text"), F.col("word_count"))
    wanted = [
        rules.Rule("onpage.thin_content", F.col("word_count") < rules.THIN_WORDS, {"word_count": F.col("word_count")}),
        rules.Rule("onpage.readability_difficult", (F.col("word_count") >= rules.READABLE_WORDS) & (ease < rules.DIFFICULT_EASE), {"flesch_score": ease}),
    ]
    return rules.evaluated(rows, wanted).select(F.col("page_url").cast("bigint").alias("doc_id"), "rule_id")


def _line_rules(column: str, rule: str, worst: str, least: int, most: int, said: tuple[str, ...]) -> str:
    """SQL of the rules on presence and length of a line, and on lines that several documents of a site share."""
    missing, empty, short, long, shared = said
    bare = f"regexp_replace({column}, '^{_WS}+|{_WS}+$', '', 'g')"
    n = f"length({bare})"
    shorts = "info" if rule == "meta_description" else "warning"
    return f"""SELECT doc_id, 'onpage.{rule}_missing' AS rule_id, '{worst}' AS severity, '{missing}' AS message FROM t WHERE {column} = ''
      UNION ALL SELECT doc_id, 'onpage.{rule}_empty', '{worst}', '{empty}' FROM t WHERE {column} <> '' AND {bare} = ''
      UNION ALL SELECT doc_id, 'onpage.{rule}_too_short', '{shorts}', format('{short}', {n}) FROM t WHERE {bare} <> '' AND {n} < {least}
      UNION ALL SELECT doc_id, 'onpage.{rule}_too_long', 'warning', format('{long}', {n}) FROM t WHERE {n} > {most}
      UNION ALL SELECT doc_id, 'onpage.{rule}_duplicate', 'warning', format('{shared}', others) FROM (
        SELECT doc_id, count(*) OVER (PARTITION BY site, {bare}) - 1 AS others FROM t WHERE {bare} <> '' AND site IS NOT NULL) WHERE others > 0"""


_LINES = "WITH t AS (SELECT doc_id, site, split_part(coalesce(text, ''), chr(10), 1) AS title, split_part(coalesce(text, ''), chr(10), 2) AS description FROM documents)"
_TITLE_TEXTS = (
    "Page is missing a <title> tag", "Page <title> tag is empty", "Title tag is too short ({} characters). Optimal length is 30–60 characters.",
    "Title tag is too long ({} characters) and may be truncated in search results.", "Title tag is identical to {} other page(s) on the site",
)
_DESCRIPTION_TEXTS = (
    "Page is missing a meta description tag", "Meta description tag is empty", "Meta description is very short ({} characters). Recommended is 70–160 characters.",
    "Meta description is too long ({} characters) and will likely be truncated.", "Meta description is identical to {} other page(s) on the site",
)


@query(f"""{_LINES} {_line_rules('title', 'title', 'critical', 30, 60, _TITLE_TEXTS)}
    UNION ALL {_line_rules('description', 'meta_description', 'warning', 70, 160, _DESCRIPTION_TEXTS)}""")
def line_findings(spark: SparkSession, directory: str) -> DataFrame:
    """Findings of the rules on titles and descriptions over the documents: their first line is the title, the second one the
    description, and the documents of a site are one audit."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, directory, "documents").select(
        F.col("site").alias("audit_id"), F.lit("").alias("tenant_id"), F.col("doc_id").alias("page_id"), F.col("doc_id").cast("string").alias("url"),
        F.lit("success").alias("parse_status"), F.lit(200).alias("status_code"), F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"),
        F.split_part(text, F.lit("\n"), F.lit(2)).alias("meta_description"),
    )
    single = [r for r in rules.onpage_rules() if r.rule_id.startswith(("onpage.title_", "onpage.meta_description_"))]
    found = rules.evaluated(rows, single).unionByName(graph.duplicate_titles(rows)).unionByName(graph.duplicate_descriptions(rows))
    return found.select(F.col("page_url").cast("bigint").alias("doc_id"), "rule_id", "severity", "message")


_SAMPLED = f"""WITH f AS (SELECT doc_id, site, text, {_FIELDS % "lower(coalesce(text, ''))"} AS w FROM documents),
    h AS (SELECT doc_id, site, text, md5(array_to_string(list_filter(w, lambda x, i: (i - 1) % greatest(1, len(w) // 30) = 0), ' ')) AS fingerprint FROM f)"""


@query(f"{_SAMPLED} SELECT doc_id, fingerprint FROM h")
def text_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").select("doc_id", tx.sampled_fingerprint(F.col("text")).alias("fingerprint"))


@query(rf"""{_SAMPLED}, k AS (SELECT * FROM h WHERE len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{Nd}}]+')) >= 50)
    SELECT doc_id, pages FROM k JOIN (SELECT site, fingerprint, count(*) AS pages FROM k GROUP BY ALL) USING (site, fingerprint) WHERE pages > 1""")
def duplicate_contents(spark: SparkSession, directory: str) -> DataFrame:
    """Documents of a site that share a sampled fingerprint."""
    rows = _texts(spark, directory).select(
        "audit_id", F.lit("").alias("tenant_id"), "page_id", F.col("page_id").cast("string").alias("url"), F.lit("success").alias("parse_status"),
        F.lit(200).alias("status_code"), "body_text", tx.word_count(F.col("body_text")).alias("word_count"),
    )
    found = graph.duplicate_contents(rows)
    return found.select(F.col("page_url").cast("bigint").alias("doc_id"), F.get_json_object("evidence", "$.pages").cast("bigint").alias("pages"))


@query(rf"""SELECT doc_id, array_to_string(list_filter(list_distinct_in_order, lambda e: strlen(e) > 4), '|') AS entities FROM (
      SELECT doc_id, list_transform(list_sort(list_distinct(list_transform(e, lambda x, i: struct_pack(at := list_position(e, x), x := x)))), lambda s: s.x)
        AS list_distinct_in_order
      FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\b[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+){{1,2}}\b') AS e FROM documents))""")
def text_entities(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").select("doc_id", F.array_join(tx.named_entities(F.col("text")), "|").alias("entities"))


# --- keywords -----------------------------------------------------------------------------------------------------------------
_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TERMS = rf"""WITH tok AS (SELECT doc_id, site, list_filter(list_transform({_FIELDS % 'text'}, lambda w: lower(regexp_replace(w, '[^\p{{L}}\p{{Nd}}]', '', 'g'))),
      lambda w: strlen(w) >= 2 AND w NOT IN ({_STOP})) AS t FROM documents WHERE text IS NOT NULL),
    grams AS (SELECT doc_id, site, list_concat(list_concat(list_filter(t, lambda w: strlen(w) >= 3),
      list_transform(list_filter(range(1, len(t)), lambda i: t[i] <> t[i + 1]), lambda i: t[i] || ' ' || t[i + 1])),
      list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g FROM tok),
    tc AS (SELECT doc_id, site, term, total, count(*) AS n FROM (SELECT doc_id, site, len(g) AS total, unnest(g) AS term FROM grams) GROUP BY ALL),
    df AS (SELECT site, term, count(*) AS pages FROM tc GROUP BY ALL)"""
_RANKED = f"""{_TERMS}, sized AS (SELECT site, count(*) AS docs FROM documents WHERE text IS NOT NULL GROUP BY site),
    scored AS (SELECT doc_id, site, term, n, round(n / (total + 1) * (ln((1.0 + docs) / (1.0 + pages)) + 1.0)
      * CASE len(string_split(term, ' ')) WHEN 2 THEN 2.2 WHEN 3 THEN 2.8 ELSE 1.0 END, 10) AS score
      FROM tc JOIN df USING (site, term) JOIN sized USING (site)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY site, doc_id ORDER BY score DESC, term) AS place FROM scored)"""


@query(f"""{_TERMS} SELECT site, count(*) AS terms, sum(pages) AS mentions, max(pages) AS most_pages FROM df GROUP BY site""")
def term_statistics(spark: SparkSession, directory: str) -> DataFrame:
    """Terms of each site and the pages that hold them."""
    frequency = keywords.document_frequency(keywords.term_counts(_texts(spark, directory)))
    return frequency.groupBy(F.col("audit_id").alias("site")).agg(
        F.count("*").alias("terms"), F.sum("pages").alias("mentions"), F.max("pages").alias("most_pages")
    )


def _ranked(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    texts = _texts(spark, directory)
    counts = written(keywords.term_counts(texts), "terms")
    return keywords.ranked_terms(keywords.boosted(keywords.tf_idf(counts, texts))), texts


@query(f"{_RANKED} SELECT doc_id, term, place FROM ranked WHERE place <= 10")
def top_terms(spark: SparkSession, directory: str) -> DataFrame:
    return keywords.top_terms(_ranked(spark, directory)[0]).select(F.col("page_id").alias("doc_id"), "term", "place")


@query(f"""{_RANKED} SELECT d.doc_id, coalesce(r.term, 'general') AS primary_keyword
    FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) d LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r USING (doc_id)""")
def primary_keywords(spark: SparkSession, directory: str) -> DataFrame:
    ranked, texts = _ranked(spark, directory)
    return keywords.primary_keywords(ranked, texts).select(F.col("page_id").alias("doc_id"), "primary_keyword")


@query(f"""{_RANKED} SELECT doc_id, term, rank FROM (SELECT r.doc_id, r.term, row_number() OVER (PARTITION BY r.doc_id ORDER BY r.place) AS rank
      FROM ranked r JOIN ranked f ON f.doc_id = r.doc_id AND f.place = 1 WHERE r.place > 1 AND NOT contains(f.term, r.term) AND NOT contains(r.term, f.term))
    WHERE rank <= 5""")
def secondary_keywords(spark: SparkSession, directory: str) -> DataFrame:
    return keywords.secondary_keywords(_ranked(spark, directory)[0]).select(F.col("page_id").alias("doc_id"), "term", "rank")


_MAP = """SELECT audit_id, primary_keyword AS keyword, array_to_string(list_sort(list(DISTINCT page_url)), ' ') AS urls, count(DISTINCT page_url) AS pages
    FROM page_keywords GROUP BY ALL"""


@query(_MAP)
def keyword_map(spark: SparkSession, directory: str) -> DataFrame:
    made = keywords.keyword_map(table(spark, directory, "page_keywords"))
    return made.withColumn("urls", F.array_join("urls", " "))


@query(f"SELECT audit_id, keyword, pages FROM ({_MAP}) WHERE pages > 1 AND keyword NOT IN ('general', '')")
def keyword_conflicts(spark: SparkSession, directory: str) -> DataFrame:
    return keywords.exact_conflicts(table(spark, directory, "page_keywords")).select("audit_id", "keyword", "pages")


@query("""WITH k AS (SELECT DISTINCT audit_id, primary_keyword AS w FROM page_keywords WHERE primary_keyword NOT IN ('general', ''))
    SELECT i.audit_id, i.w AS inner_keyword, o.w AS outer_keyword FROM k i JOIN k o ON i.audit_id = o.audit_id AND i.w <> o.w AND contains(o.w, i.w)""")
def keyword_overlaps(spark: SparkSession, directory: str) -> DataFrame:
    return keywords.overlapping_keywords(table(spark, directory, "page_keywords"))


@query(f"SELECT audit_id, keyword, pages, row_number() OVER (PARTITION BY audit_id ORDER BY pages DESC, keyword) AS place FROM ({_MAP})")
def report_keywords(spark: SparkSession, directory: str) -> DataFrame:
    return report.keyword_list(keywords.keyword_map(table(spark, directory, "page_keywords")))


@query()
def page_profiles(spark: SparkSession, directory: str) -> DataFrame:
    """Keyword profiles of the crawled pages, with all boosts."""
    return keywords.page_profiles(_parsed(spark, directory))


# --- findings and scores --------------------------------------------------------------------------------------------------------
_FINDINGS = "f AS (SELECT * FROM audit_findings QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY finding_id) = 1)"
_SCORES = f"""{_FINDINGS}, d AS (SELECT audit_id, page_url, severity,
      CASE severity WHEN 'critical' THEN 15 WHEN 'warning' THEN 5 ELSE 1 END AS d,
      CASE WHEN lower(coalesce(category, '')) = 'technical' THEN 't' WHEN lower(coalesce(category, '')) IN ('keywords', 'content') THEN 'c' ELSE 'o' END AS k FROM f),
    g0 AS (SELECT audit_id, page_url, greatest(0, 100 - coalesce(sum(d) FILTER (k = 't'), 0)) AS technical_score,
      greatest(0, 100 - coalesce(sum(d) FILTER (k = 'o'), 0)) AS onpage_score, greatest(0, 100 - coalesce(sum(d) FILTER (k = 'c'), 0)) AS content_score,
      count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'warning') AS warning_count,
      count(*) FILTER (severity = 'info') AS info_count FROM d GROUP BY ALL),
    u AS (SELECT DISTINCT audit_id, url AS page_url FROM crawl_pages WHERE audit_id IS NOT NULL AND url IS NOT NULL),
    s AS (SELECT audit_id, page_url, coalesce(technical_score, 100) AS technical_score, coalesce(onpage_score, 100) AS onpage_score,
      coalesce(content_score, 100) AS content_score, coalesce(critical_count, 0) AS critical_count, coalesce(warning_count, 0) AS warning_count,
      coalesce(info_count, 0) AS info_count FROM g0 FULL JOIN u USING (audit_id, page_url)),
    o AS (SELECT *, CAST(round(round(0.4 * technical_score + 0.35 * onpage_score + 0.25 * content_score, 10)) AS INT) AS overall_score FROM s)"""


@query(f"""WITH {_FINDINGS} SELECT audit_id, count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'warning') AS warning_count,
    count(*) FILTER (severity = 'info') AS info_count, count(*) AS total_findings FROM f GROUP BY audit_id""")
def severity_counts(spark: SparkSession, directory: str) -> DataFrame:
    return rules.severity_counts(_findings(spark, directory))


@query(f"WITH {_FINDINGS} SELECT finding_id, audit_id, rule_id, severity FROM f WHERE lower(category) = 'technical'")
def technical_scan(spark: SparkSession, directory: str) -> DataFrame:
    """Findings of one category."""
    return _findings(spark, directory).where("lower(category) = 'technical'").select("finding_id", "audit_id", "rule_id", "severity")


@query(f"WITH {_SCORES} SELECT * FROM o")
def page_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Scores of every page; pages without findings score 100."""
    return _page_scores(spark, directory)


@query(f"""WITH {_SCORES}, a AS (SELECT audit_id, CAST(round(avg(technical_score)) AS INT) AS technical_score, CAST(round(avg(onpage_score)) AS INT) AS onpage_score,
      CAST(round(avg(content_score)) AS INT) AS content_score, sum(critical_count) AS critical_count, sum(warning_count) AS warning_count,
      sum(info_count) AS info_count, count(*) AS total_pages FROM o GROUP BY audit_id)
    SELECT *, CAST(round(round(0.4 * technical_score + 0.35 * onpage_score + 0.25 * content_score, 10)) AS INT) AS overall_score FROM a""")
def audit_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Scores of every audit over all its pages."""
    return scoring.audit_scores(_page_scores(spark, directory))


_LINKS = """SELECT audit_id, href AS page_url, count(*) AS inbound FROM (SELECT DISTINCT audit_id, page_id, unnest(discovered_links) AS href FROM crawl_pages)
    WHERE href IS NOT NULL AND href <> '' GROUP BY ALL"""


def _degree(spark: SparkSession, directory: str) -> DataFrame:
    pages = table(spark, directory, "crawl_pages")
    return scoring.inbound_degree(pages.select("audit_id", "page_id", F.explode("discovered_links").alias("href")))


@query(_LINKS)
def inbound_degree(spark: SparkSession, directory: str) -> DataFrame:
    return _degree(spark, directory)


_FALLBACK = """array_to_string(list_transform(string_split(CASE WHEN contains(rule_id, '.') THEN split_part(rule_id, '.', 2) ELSE rule_id END, '_'),
      lambda w: upper(w[1]) || lower(w[2:])), ' ')"""
_TITLE = f"CASE rule_id {' '.join(f"WHEN '{rule}' THEN '{title}'" for rule, title in scoring.RULE_TITLES.items())} ELSE {_FALLBACK} END"
_DEPTH = f"trim(regexp_extract(page_url, {_URL}, 3), '/')"
_ISSUES = f"""WITH {_FINDINGS}, links AS ({_LINKS}),
    w AS (SELECT f.*, CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END AS worth,
      CASE severity WHEN 'critical' THEN 15 WHEN 'warning' THEN 5 ELSE 1 END * CASE WHEN coalesce(page_url, '') = '' THEN 1.0 ELSE least(3.0,
        CASE WHEN {_DEPTH} = '' THEN 2.0 WHEN len(string_split({_DEPTH}, '/')) = 1 THEN 1.5 WHEN len(string_split({_DEPTH}, '/')) = 2 THEN 1.2 ELSE 1.0 END
        * (1.0 + least(0.5, 0.05 * coalesce(inbound, 0)))) END AS impact
      FROM f LEFT JOIN links USING (audit_id, page_url)),
    p AS (SELECT *, row_number() OVER (PARTITION BY audit_id, rule_id ORDER BY created_at NULLS LAST, finding_id) AS first,
      row_number() OVER (PARTITION BY audit_id, rule_id ORDER BY worth DESC, created_at NULLS LAST, finding_id) AS worst FROM w),
    g AS (SELECT audit_id, rule_id, max(category) FILTER (first = 1) AS category, max(severity) FILTER (worst = 1) AS severity,
      max(tenant_id) FILTER (first = 1) AS tenant_id, max(message) FILTER (worst = 1) AS message, coalesce(array_to_string(list_sort(list(DISTINCT page_url) FILTER (page_url <> '')), ' '), '') AS affected_urls,
      count(DISTINCT page_url) FILTER (page_url <> '') AS affected_pages_count, sum(CAST(impact AS DECIMAL(18, 6))) AS total FROM p GROUP BY ALL),
    i AS (SELECT *, CASE WHEN rule_id IN ({", ".join(f"'{r}'" for r in scoring.RULE_EFFORTS["low"])}) THEN 'low'
      WHEN rule_id IN ({", ".join(f"'{r}'" for r in scoring.RULE_EFFORTS["high"])}) THEN 'high' ELSE 'medium' END AS effort_tier FROM g),
    r AS (SELECT * EXCLUDE (total), {_TITLE} AS title, round(total::DOUBLE, 2) AS impact_score,
      round(total::DOUBLE / CASE effort_tier WHEN 'low' THEN 1.0 WHEN 'high' THEN 3.0 ELSE 2.0 END, 2) AS priority_score FROM i)"""


@query(f"""{_ISSUES} SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY priority_score DESC, impact_score DESC, rule_id) AS place FROM r""")
def issue_rollup(spark: SparkSession, directory: str) -> DataFrame:
    """Issues of each audit with their places."""
    made = scoring.issue_places(scoring.issue_rollup(_findings(spark, directory), _degree(spark, directory)))
    return made.withColumn("affected_urls", F.array_join("affected_urls", " "))


@query(f"SELECT DISTINCT rule_id, {_TITLE} AS title FROM prioritized_issues")
def rule_titles(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "prioritized_issues").select("rule_id").distinct()
    return rows.select("rule_id", scoring.rule_title(F.col("rule_id")).alias("title"))


# --- crawled pages --------------------------------------------------------------------------------------------------------------
_CRAWL = f"WITH c AS (SELECT *, {_sql_parts('url')} FROM crawl_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY page_id) = 1)"
_NAMES = "list_distinct(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1)))"
_IDS = "regexp_replace(list_filter(string_split(q, '&'), lambda x: split_part(x, '=', 1) = 'id' AND x <> '')[1], '^[^=]*=?', '')"
_URL_RULES = [
    "technical.status_4xx", "technical.status_5xx", "technical.page_unreachable", "technical.http_unencrypted", "technical.url_too_long",
    "technical.url_excessive_parameters", "technical.url_non_descriptive_id",
]


@query(f"""{_CRAWL}, l AS (SELECT *, NOT (status_code >= 400 OR status_code = 0 OR coalesce(html, '') = '') AS alive FROM c),
    x AS (SELECT audit_id, url, 'technical.status_4xx' AS rule_id FROM l WHERE status_code BETWEEN 400 AND 499
      UNION ALL SELECT audit_id, url, 'technical.status_5xx' FROM l WHERE status_code >= 500
      UNION ALL SELECT audit_id, url, 'technical.page_unreachable' FROM l WHERE NOT alive AND status_code < 400
      UNION ALL SELECT audit_id, url, 'technical.http_unencrypted' FROM l WHERE alive AND s = 'http'
      UNION ALL SELECT audit_id, url, 'technical.url_too_long' FROM l WHERE alive AND strlen(url) > 100
      UNION ALL SELECT audit_id, url, 'technical.url_excessive_parameters' FROM l WHERE alive AND len({_NAMES}) > 3
      UNION ALL SELECT audit_id, url, 'technical.url_non_descriptive_id' FROM l WHERE alive AND {_IDS} <> '')
    SELECT audit_id, url AS page_url, rule_id, count(*) AS n FROM x GROUP BY ALL""")
def technical_url_findings(spark: SparkSession, directory: str) -> DataFrame:
    """Findings of the technical rules that look at status and address."""
    found = rules.technical_findings(_parsed(spark, directory)).where(F.col("rule_id").isin(_URL_RULES))
    return found.groupBy("audit_id", "page_url", "rule_id").agg(F.count("*").alias("n"))


@query(f"""{_CRAWL} SELECT audit_id, count(*) AS total_pages, count(*) FILTER (status_code = 200) AS total_fetched,
    count(*) FILTER (status_code IS DISTINCT FROM 200) AS total_errors, sum(byte_size) AS total_bytes, sum(fetch_duration_ms) AS fetch_ms,
    count(*) FILTER (status_code = 200) = 0 AS failed FROM c GROUP BY audit_id""")
def crawl_summaries(spark: SparkSession, directory: str) -> DataFrame:
    return crawl_summary(_pages(spark, directory))


@query()
def page_facts(spark: SparkSession, directory: str) -> DataFrame:
    """Facts of every crawled page."""
    return parsed_pages(_pages(spark, directory))


@query()
def onpage_findings(spark: SparkSession, directory: str) -> DataFrame:
    return rules.onpage_findings(_parsed(spark, directory))


@query()
def technical_findings(spark: SparkSession, directory: str) -> DataFrame:
    return rules.technical_findings(_parsed(spark, directory))


@query()
def cross_page_findings(spark: SparkSession, directory: str) -> DataFrame:
    return graph.cross_page_findings(_parsed(spark, directory))


def _matching(column: str) -> str:
    """SQL of the form in which links are compared."""
    s, a, p, q = (f"regexp_extract({column}, {_URL}, {k})" for k in (1, 2, 3, 4))
    return f"""(CASE WHEN {s} <> '' THEN lower({s}) || ':' ELSE '' END || CASE WHEN {a} <> '' THEN '//' || lower({a}) ELSE '' END
      || regexp_replace({p}, '/+$', '') || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"""


_GRAPH = f"""WITH c AS (SELECT page_id, audit_id, url, status_code, coalesce(discovered_links, []) AS links FROM crawl_pages
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY page_id) = 1),
    g AS (SELECT *, {_matching('url')} AS address, coalesce(links[-1], '') AS canonical FROM c),
    l AS (SELECT DISTINCT audit_id, {_matching('href')} AS address FROM (SELECT audit_id, unnest(links) AS href FROM g WHERE status_code = 200)),
    k AS (SELECT audit_id, address, arg_max({_matching('canonical')}, page_id) AS target FROM g WHERE canonical <> '' GROUP BY ALL),
    e AS (SELECT audit_id, url, status_code, address, {_matching('href')} AS target FROM (SELECT *, unnest(links[-3:-2]) AS href FROM g) WHERE href <> ''),
    v AS (SELECT audit_id, address AS target FROM g GROUP BY ALL HAVING arg_max(status_code, page_id) = 200),
    x AS (SELECT g.audit_id, g.url, 'onpage.orphan_page' AS rule_id FROM g ANTI JOIN l USING (audit_id, address)
        WHERE status_code = 200 AND regexp_extract(url, {_URL}, 3) NOT IN ('', '/')
      UNION ALL SELECT g.audit_id, g.url, 'technical.canonical_chain_conflict' FROM g JOIN k a ON a.audit_id = g.audit_id AND a.address = g.address
        JOIN k b ON b.audit_id = g.audit_id AND b.address = a.target WHERE g.status_code = 200 AND a.target <> g.address AND b.target <> a.target
      UNION ALL SELECT e.audit_id, e.url, 'technical.hreflang_missing_reciprocal' FROM e JOIN v ON v.audit_id = e.audit_id AND v.target = e.target
        WHERE e.status_code = 200 AND NOT EXISTS (SELECT 1 FROM e b WHERE b.audit_id = e.audit_id AND b.address = e.target AND b.target = e.address))"""


@query(f"{_GRAPH} SELECT audit_id, url AS page_url, rule_id, count(*) AS n FROM x GROUP BY ALL")
def link_findings(spark: SparkSession, directory: str) -> DataFrame:
    """Findings of the rules on graphs over the links of the crawled pages: the last link stands for the canonical address, the
    two before it for language alternates."""
    links = F.coalesce("discovered_links", F.array().cast("array<string>"))
    link = lambda u: F.struct(u.alias("href"), F.lit("").alias("text"), F.lit(True).alias("is_internal"))
    rows = _pages(spark, directory).select(
        "page_id", "audit_id", "tenant_id", "url", "status_code", F.lit("success").alias("parse_status"), F.transform(links, link).alias("links"),
        F.coalesce(F.try_element_at(links, F.lit(-1)), F.lit("")).alias("canonical_url"),
        F.transform(F.when(F.size(links) > 2, F.slice(links, -3, 2)).otherwise(F.slice(links, 1, F.greatest(F.size(links) - 1, F.lit(0)))), lambda u: F.struct(F.lit("en").alias("hreflang"), u.alias("href"))).alias("hreflangs"),
    )
    found = graph.orphan_pages(rows).unionByName(graph.canonical_chains(rows)).unionByName(graph.missing_reciprocals(rows))
    return found.groupBy("audit_id", "page_url", "rule_id").agg(F.count("*").alias("n"))


@query()
def keyword_findings(spark: SparkSession, directory: str) -> DataFrame:
    """Findings on pages that compete for a keyword."""
    return keywords.conflict_findings(table(spark, directory, "page_keywords").select(
        "audit_id", "tenant_id", F.col("keyword_id").alias("page_id"), "page_url", "primary_keyword").distinct())


@query()
def audited_findings(spark: SparkSession, directory: str) -> DataFrame:
    """Findings of all analyses of the crawled pages."""
    return audit.findings(_parsed(spark, directory), F.lit(None).cast("timestamp"))


@query()
def audited_issues(spark: SparkSession, directory: str) -> DataFrame:
    """Issues of the crawled pages, from their html to the ordered list."""
    return audit.run(_pages(spark, directory)).issues


@query()
def audited_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Scores of the audits of the crawled pages, from their html."""
    return audit.run(_pages(spark, directory)).totals


# --- audits, events, deliveries, reports ------------------------------------------------------------------------------------------
@query("""SELECT audit_id, status, updated_at FROM (SELECT DISTINCT audit_id, status, updated_at FROM audits)
    QUALIFY row_number() OVER (PARTITION BY audit_id ORDER BY updated_at DESC NULLS LAST, status DESC NULLS LAST) = 1""")
def current_audits(spark: SparkSession, directory: str) -> DataFrame:
    """Current row of every audit."""
    rows = table(spark, directory, "audits").select("audit_id", "status", "updated_at")
    return report.current_rows(rows, "audit_id", "updated_at")


_WANTED = ["audit.events.crawl_completed", "audit.events.score.computed", "audit.events.report.generated"]


@query("""SELECT audit_id, max(first) AS completed_at FROM (SELECT audit_id, subject, min(received_at) AS first FROM audit_messages GROUP BY ALL)
    WHERE subject IN ('audit.events.crawl_completed', 'audit.events.score.computed', 'audit.events.report.generated') GROUP BY audit_id HAVING count(*) = 3""")
def completion_barrier(spark: SparkSession, directory: str) -> DataFrame:
    """Audits for which all three completions have come."""
    return completed(table(spark, directory, "audit_messages"), "audit_id", "subject", _WANTED, "received_at")


@query("""SELECT DISTINCT audit_id, channel FROM notification_deliveries d
    WHERE NOT EXISTS (SELECT 1 FROM notification_deliveries x WHERE x.audit_id = d.audit_id AND x.channel = d.channel AND x.status = 'delivered')""")
def undelivered_notifications(spark: SparkSession, directory: str) -> DataFrame:
    log = table(spark, directory, "notification_deliveries")
    return undelivered(log, log).select("audit_id", "channel")


_VERSIONS = """SELECT audit_id, CAST(json_extract_string(payload, '$.version') AS INT) AS version FROM audit_messages
    WHERE subject = 'audit.events.report.generated'"""


def _reports(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "audit_messages").where("subject = 'audit.events.report.generated'")
    return rows.select("audit_id", F.get_json_object("payload", "$.version").cast("int").alias("version"), F.get_json_object("payload", "$.share_token").alias("share_token"))


@query(f"SELECT audit_id, coalesce(max(version), 0) + 1 AS next_version FROM ({_VERSIONS}) GROUP BY audit_id")
def next_report_versions(spark: SparkSession, directory: str) -> DataFrame:
    return report.next_version(_reports(spark, directory))


@query(f"SELECT audit_id, max(version) AS version FROM ({_VERSIONS}) GROUP BY audit_id")
def latest_reports(spark: SparkSession, directory: str) -> DataFrame:
    return report.latest_reports(_reports(spark, directory)).select("audit_id", "version")


@query(f"""{_ISSUES},
    n AS (SELECT audit_id, count(*) AS issues, max(priority_score) AS best FROM r GROUP BY audit_id),
    pages AS (SELECT audit_id, count(*) AS pages FROM (WITH {_SCORES} SELECT * FROM o) GROUP BY audit_id),
    k AS (SELECT audit_id, count(*) AS keywords FROM ({_MAP}) GROUP BY audit_id),
    a AS (SELECT audit_id, status FROM (SELECT DISTINCT audit_id, status, updated_at FROM audits)
      QUALIFY row_number() OVER (PARTITION BY audit_id ORDER BY updated_at DESC NULLS LAST, status DESC NULLS LAST) = 1)
    SELECT a.audit_id, coalesce(issues, 0) AS issues, best, pages, coalesce(keywords, 0) AS keywords,
      coalesce(status = 'completed_with_warnings', false) AS has_warnings
    FROM a JOIN pages USING (audit_id) LEFT JOIN n USING (audit_id) LEFT JOIN k USING (audit_id)""")
def report_contents(spark: SparkSession, directory: str) -> DataFrame:
    """What the report of each audit holds."""
    made = _assembled(spark, directory)
    return made.select(
        "audit_id", F.size("issues").alias("issues"), F.get("issues", F.lit(0))["priority_score"].alias("best"),
        F.size("page_breakdown").alias("pages"), F.size("keywords").alias("keywords"), "has_warnings",
    )


def _assembled(spark: SparkSession, directory: str) -> DataFrame:
    findings = _findings(spark, directory)
    scores = _page_scores(spark, directory)
    issues = scoring.issue_places(scoring.issue_rollup(findings, _degree(spark, directory)))
    words = report.keyword_list(keywords.keyword_map(table(spark, directory, "page_keywords")))
    audits = report.current_rows(table(spark, directory, "audits"), "audit_id", "updated_at")
    return report.assembled(audits, scoring.audit_scores(scores), scores, issues, words)


@query()
def report_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Reports as JSON and HTML."""
    made = written(_assembled(spark, directory), "reports")
    return report.as_json(made).join(report.as_html(made), "audit_id")


@query()
def admitted_requests(spark: SparkSession, directory: str) -> DataFrame:
    """Events that a token bucket for each user lets through."""
    rows = table(spark, directory, "events").select("event_id", "user_id", "ts")
    return admitted(rows, "user_id", "ts", rate=0.001, burst=3)
