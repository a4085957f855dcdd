import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.functions import urls as ux
from auditloom.functions.addresses import page_address
from auditloom.functions.ids import canonical_uuid, is_blank


def _one(spark, column, value):
    return spark.createDataFrame([(value,)], "u string").select(column(F.col("u"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("https://Shop.Example/A", "https://shop.example/A"),
        ("https://a.example/", "https://a.example"),
        ("https://a.example/x/", "https://a.example/x"),
        ("https://a.example/x//", "https://a.example/x/"),
        ("https://a.example:443/x", "https://a.example/x"),
        ("http://a.example:80/x", "http://a.example/x"),
        ("http://a.example:8080/x", "http://a.example:8080/x"),
        ("https://a.example/x?b=1#top", "https://a.example/x?b=1"),
        ("https://me:pw@a.example/x", "https://a.example/x"),
    ],
)
def test_crawl_address(spark, raw, expected):
    assert _one(spark, ux.crawl_address, raw) == expected


@pytest.mark.parametrize(
    ("raw", "address", "error"),
    [
        (" https://A.example:443/x// ", "https://a.example/x", None),
        ("http://a.example#f", "http://a.example", None),
        ("", None, "must not be empty"),
        (None, None, "must not be empty"),
        ("/relative", None, "must be absolute"),
        ("a.example/x", None, "must be absolute"),
        ("ftp://a.example", None, "unsupported scheme"),
        ("javascript:alert(1)", None, "must be absolute"),
    ],
)
def test_submitted_address(spark, raw, address, error):
    assert _one(spark, ux.submitted_address, raw) == address
    said = _one(spark, ux.submitted_error, raw)
    assert said is None if error is None else error in said


def test_matching_keeps_ports_and_queries(spark):
    assert _one(spark, ux.matching_address, "HTTPS://A.example:443/x//?q=1#f") == "https://a.example:443/x?q=1"
    assert _one(spark, ux.matching_address, "/x/") == "/x"


def test_parts(spark):
    url = "https://a.example/en/the-blue-of-SHED_lamps.html?id=7&b=&id=8&c=1"
    assert _one(spark, ux.slug_keywords, url) == ["blue", "shed", "lamps"]
    assert _one(spark, ux.slug_text, url) == "the blue of SHED_lamps"
    assert _one(spark, ux.path_depth, url) == 2 and _one(spark, ux.path_depth, "https://a.example/") == 0
    assert _one(spark, ux.parameter_count, url) == 3
    assert _one(spark, lambda c: ux.first_parameter(c, "id"), url) == "7"
    assert _one(spark, lambda c: ux.first_parameter(c, "z"), url) is None
    assert _one(spark, ux.slug_keywords, "https://a.example/") == []
    assert _one(spark, ux.host, "https://A.example:81/x") == "a.example"


def test_reserved_addresses(spark):
    cases = {"127.0.0.1": True, "10.1.2.3": True, "172.32.0.1": False, "169.254.169.254": True, "8.8.8.8": False, "::1": True, "::ffff:10.0.0.1": True, "2606:4700::1111": False, "nonsense": True}
    rows = spark.createDataFrame(list(cases.items()), "ip string, expected boolean")
    assert rows.where(ux.is_reserved_ip("ip") != F.col("expected")).count() == 0


def test_page_address():
    same = [
        "https://A.example:443/x/%70age//?b=2&a=1&utm_source=m#top",
        "HTTPS://a.example/x/page/index.html?a=1&b=2&gclid=z",
        "https://a.example/x/page;jsessionid=AB12?a=1&b=2",
    ]
    assert {page_address(u) for u in same} == {"https://a.example/x/page?a=1&b=2"}
    other = ["http://a.example/x", "https://a.example/x", "https://a.example/x?a=1", "https://a.example/x?a=2", "https://a.example/X", "https://a.example/x/print"]
    assert len({page_address(u) for u in other}) == len(other)
    assert page_address(None) is None and page_address("  nothing ") == "nothing"


@given(st.text(alphabet=string.ascii_letters + "/%.?&=#:;0123456789", max_size=40))
@settings(max_examples=300, suppress_health_check=list(HealthCheck))
def test_page_address_is_idempotent(tail):
    once = page_address("https://h.example/" + tail)
    if "%25" not in once:
        assert page_address(once) == once


def test_uuids(spark):
    plain = "0123456789abcdef0123456789abcdef"
    dashed = "01234567-89AB-cdef-0123-456789abcdef"
    for text in (plain, dashed, f" {dashed} ", "{" + dashed + "}", f"urn:uuid:{dashed}"):
        assert _one(spark, canonical_uuid, text) == plain
    for text in (dashed + "0", dashed[:-1], "unknown", "", None):
        assert _one(spark, canonical_uuid, text) is None
    assert _one(spark, is_blank, "  \t") is True and _one(spark, is_blank, None) is True and _one(spark, is_blank, "x") is False
