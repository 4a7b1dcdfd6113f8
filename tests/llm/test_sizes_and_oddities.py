"""Every operator over odd rows, no rows and clashing names: it ends, and its rows are as stated."""

import pytest

from shutterlake.llm import decontaminate, license_scan, minhash_dedup, pii, quality_rules, sentencepiece_codec, suffix_dedup, token_output, url_filter, warc
from shutterlake.llm.queries import vocabulary

ITEMS = "item_id long, text string"


def items(spark):
    return spark.createDataFrame([(1, "nobody had come to the house for a long time"), (2, None), (3, ""), (None, "another item of some nine words that nobody has seen")], ITEMS)


OPERATORS = {
    "token_output": lambda s, d: token_output.token_table(d, vocabulary("byte_bpe_50k.json"), 2),
    "quality_rules": lambda s, d: quality_rules.judge_quality(d),
    "sentencepiece": lambda s, d: sentencepiece_codec.digests(d, vocabulary("piece_bpe_32k.model")),
    "minhash": lambda s, d: minhash_dedup.classes(d),
    "suffix_dedup": lambda s, d: suffix_dedup.remove_repeats(d),
    "pii": lambda s, d: pii.pii_digest(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, docs, odd_rows, name):
    out = OPERATORS[name](spark, docs(odd_rows)).collect()
    key = lambda i: (i is not None, i or 0)
    assert sorted((r["doc_id"] for r in out), key=key) == sorted((r[0] for r in odd_rows), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, docs, name):
    assert OPERATORS[name](spark, docs([])).collect() == []


def test_pair_operators_on_odd_rows(spark, docs, odd_rows):
    found = decontaminate.find_leaks(docs(odd_rows), items(spark)).where("leaked").collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in found) == [(0, 1), (5, 1), (5, 1), (6, 1)]
    assert decontaminate.find_leaks(docs([]), items(spark)).collect() == []
    assert decontaminate.find_leaks(docs(odd_rows), items(spark).limit(0)).collect() == []
    assert license_scan.scan_licenses(docs(odd_rows)).collect() == []
    assert license_scan.scan_licenses(docs([])).collect() == []


def test_pages_on_odd_rows(spark):
    big = "x" * 3_000_000
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://A.Example.NET/en/x?q#f", big), (3, "http://A.Example.NET/en/x?q#f", big), (4, "a://b\nc/%0A\r", big), (None, "x://net", big), (5, "http://example.com:80/de/", "short"), (6, "http://", "short")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    judged = {(r["page_id"], r["url"] if "url" in r else None): r for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark)).collect()}
    assert len(url_filter.judge_urls(pages, url_filter.rules_frame(spark)).collect()) == len(rows)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged.values()}
    assert by[1] == by[2] == ("", "", None, "allow")
    assert by[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by[4] == ("b\nc", "/%0A\r", None, "allow")
    assert by[5] == ("example.com:80", "/de/", None, "allow")
    archived = warc.archive_table(pages).collect()
    assert len(archived) == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in archived)
    assert kinds == [(0, "response", 0), (1, "response", 0), (2, "response", 0), (3, "response", 0), (3, "response", 0), (4, "revisit", 3), (5, "response", 0), (6, "response", 0)]
    assert {r["page_id"]: r["url"] for r in archived}[4] == "a://b\nc/%0A\r"
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_frame(spark)).collect() == []
    assert warc.archive_table(pages.limit(0)).collect() == []
