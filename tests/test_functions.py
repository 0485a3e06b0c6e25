"""Unit cases of functions, rules and operators."""

import pytest
from pyspark.sql import functions as F

from dossierlake.functions import contacts, scalars, text_rules
from dossierlake.operators import classify, custody, relations, timeline


#: Scan text, key, and the count and details that it must give (None: the rule does not hold).
CASES = [
    ("write to user.name@example.com now", "EmailAddresses", 1, '["user.name@example.com"]'),
    ("a@x.co a@x.co", "EmailAddresses", None, None),
    ("email1@example.com email1@example.com", "EmailAddresses", 1, '["email1@example.com"]'),
    ("user.name+tag@example.co.uk", "EmailAddresses", 1, '["user.name+tag@example.co.uk"]'),
    ("e1@a.com e2@b.com", "EmailAddresses", 2, '["e1@a.com","e2@b.com"]'),
    ("aaaa@bbbb.zz", "EmailAddresses", None, None),
    ("xBcDeF@aBcDe.com", "EmailAddresses", None, None),
    ("see http://example.com/a.", "URLs", 1, '["example.com"]'),
    ("http:/broken-url", "URLs", None, None),
    ("http://a.org/x https://b.org/y?q=1", "URLs", 2, '["a.org","b.org"]'),
    ("http://www.w3.org/1999", "URLs", None, None),
    ("1 0 obj endobj 2 0 obj endobj 3 0 obj", "UnbalancedObjects", 3, None),
    ("xref\n0 2\n0000000000 65535 f\n0000000010 00000 n\ntrailer xref\n0 2\n0000000000 65535 f\n0000000010 00000 n\ntrailer", "DuplicateObjectIDs", 2, None),
    ("%PDF-1.3 /ObjStm /Creator (x)", "VersionFeatureContradiction", 1, '["ObjStm"]'),
    ("startxref 1 startxref 2 /Prev 10", "IncrementalUpdates", 2, None),
    ("startxref 1 startxref 2 /Linearized 1", "LinearizedUpdated", 1, None),
    ("/Creator (a) /Creator (b) /Creator (a)", "MultipleCreators", 2, '["a","b"]'),
    ("/P -3904", "SecurityRestrictions", 4, '["print","modify","copy","annotate"]'),
    ("/OCGs [10 0 R 11 0 R]", "HasLayers", 2, None),
    ("/OC 1 0 R /OC 2 0 R", "HasLayers", 2, None),
    ("D:20300101 D:20200101", "FutureDatedTimestamps", 1, '["20300101"]'),
    ("/ID [<aa> <bb>]", "TrailerIDChange", 1, None),
    ("/CreationDate (D:20200101101010) <xmp:CreateDate>2021-01-01T10:10:10</xmp:CreateDate>", "CreateDateMismatch", 1, None),
    ("\x00" * 200, "StructuralScrubbing", 1, None),
    ("\\\\server\\share\\file", "UNCPaths", 1, '["\\\\\\\\server\\\\share\\\\file"]'),
]


@pytest.fixture(scope="module")
def findings(spark):
    rules = text_rules.text_rules(contacts.top_level_domains(spark), F.lit("2024-01-01").cast("timestamp"))
    texts = [(i, c[0]) for i, c in enumerate(CASES)] + [(-1, "Nothing to see here."), (-2, None), (-3, "")]
    rows = text_rules.indicators(spark.createDataFrame(texts, "path int, t string"), "path", "t", rules).collect()
    return {(r["path"], r["key"]): (r["count"], r["details"]) for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules(findings, i):
    _, key, count, details = CASES[i]
    got = findings.get((i, key), (None, None))
    assert got[0] == count
    if details is not None:
        assert got[1] == details


def test_quiet_text_has_no_findings(findings):
    assert not [k for k in findings if k[0] < 0]


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "clean"), [(None, ""), ("plain", "plain"), ("a\x01b", "ab"), ("a\tb\n", "a\tb\n"), ("﻿x", "x"), ("ï»¿x", "x"), ("þÿx", "x")])
def test_cells(spark, raw, clean):
    assert value(spark, scalars.clean_cell(F.lit(raw).cast("string"))) == clean


@pytest.mark.parametrize(("raw", "norm"), [("urn:uuid:<ab>", "AB"), ("xmp.did:9", "9"), ("", None), ("uuid:", None)])
def test_ids(spark, raw, norm):
    assert value(spark, scalars.normal_id(F.lit(raw))) == norm


@pytest.mark.parametrize(("seconds", "text"), [(0.0, ""), (90061.5, "(+1d 1h 1m 1.50s)"), (60.0, "(+1m)")])
def test_spans(spark, seconds, text):
    assert value(spark, scalars.span(F.lit(seconds))) == text


def test_cross_reference_mirrors(spark):
    ids = spark.createDataFrame([("a", "own", "1"), ("b", "ref", "1"), ("b", "own", "2"), ("a", "ref", "2"), ("a", "ref", "1"), (None, "own", None)], "path string, kind string, id string")
    rows = {(r["path"], r["related_path"], r["rel_type"]) for r in relations.cross_reference(ids).collect()}
    assert rows == {("a", "b", "derived_from"), ("b", "a", "derived_from")}


def test_custody_detects_any_change(spark):
    events = spark.createDataFrame([("l", i, f"line {i}") for i in range(6)], "log string, k int, line string")
    log = custody.chained(events, "log", ["k"], "line").cache()
    assert custody.verify(log).first()["first_bad_line"] is None
    for bad in (1, 4, 6):
        broken = log.withColumn("entry", F.when(F.col("line_no") == bad, "x").otherwise(F.col("entry")))
        assert custody.verify(broken).first()["first_bad_line"] == bad
    assert log.orderBy(F.desc("line_no")).first()["entry_hash"] == custody.chain(events, "log", ["k"], "line").first()["head"]


def test_flags(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    keys = spark.createDataFrame([("a", "StackedFilters"), ("b", "URLs")], "path string, key string")
    assert {r["path"]: r["flag"] for r in classify.flag(files, keys).collect()} == {"a": "YES", "b": "Possible", "c": "NO"}


def test_gaps(spark):
    rows = spark.sql("SELECT 'a' AS p, * FROM VALUES (1, TIMESTAMP'2020-01-01'), (2, TIMESTAMP'2019-01-01'), (3, TIMESTAMP'2023-01-01') AS t(k, ts)")
    assert {(r["place"], r["kind"]) for r in timeline.gaps(rows, "p", "k", "ts").collect()} == {(2, "reverse"), (3, "gap")}
