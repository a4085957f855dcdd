import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("AUDITLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: queries of the core; those of subpackages are tested with them
CORE = {n: q for m in entry._MODULES for n, q in m.QUERIES.items() if m.__name__.startswith("auditloom.plans")}


#: columns of the queries without SQL, which other tests compare with fixtures and plain models
_FINDING = "audit_id tenant_id page_url category rule_id severity message evidence"
WITHOUT_SQL = {
    "page_profiles": "audit_id tenant_id page_id page_url primary_keyword secondary_keywords top_terms named_entities",
    "page_facts": "page_id audit_id tenant_id url status_code title meta_description meta_robots canonical_url viewport charset declared_lang hreflangs "
    "open_graph twitter_card headings links images structured_data body_text word_count char_count parse_status error_message",
    "onpage_findings": _FINDING,
    "technical_findings": _FINDING,
    "cross_page_findings": _FINDING,
    "keyword_findings": _FINDING,
    "audited_findings": f"finding_id created_at {_FINDING}",
    "audited_issues": "audit_id tenant_id rule_id category severity title message effort_tier impact_score priority_score affected_pages_count affected_urls place",
    "audited_scores": "audit_id total_pages overall_score technical_score onpage_score content_score critical_count warning_count info_count",
    "report_documents": "audit_id json html",
    "admitted_requests": "event_id user_id ts allowed",
}


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for name in os.listdir(DATA):
        made.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    return made


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, list | tuple):
        return str([plain(x) for x in value])
    return str(value)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    made = CORE[name](spark, DATA)
    rows = made.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert set(made.columns) == set(WITHOUT_SQL[name].split()) and (rows or name == "keyword_findings")
        return
    wanted = con.sql(sql)
    columns, values = wanted.columns, wanted.fetchall()
    order = sorted(columns)
    assert not rows or sorted(rows[0].asDict()) == order
    at = [columns.index(c) for c in order]
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == sorted(tuple(plain(v[i]) for i in at) for v in values)
