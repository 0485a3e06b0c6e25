"""Identifiers, dates and tools of files."""

from dossierlake.operators import metadata, relations

PACKET = '<xmpMM:DocumentID>xmp.did:AA</xmpMM:DocumentID><xmpMM:InstanceID>xmp.iid:BB</xmpMM:InstanceID><xmpMM:OriginalDocumentID>uuid:OO</xmpMM:OriginalDocumentID><xmpMM:DerivedFrom stRef:documentID="xmp.did:PP" stRef:instanceID="xmp.iid:BB"/> /ID [<0a><0b>]'


def test_document_ids_and_links(spark):
    files = spark.createDataFrame([("child", PACKET), ("parent", "<xmpMM:DocumentID>PP</xmpMM:DocumentID>"), ("none", None)], "path string, text string")
    ids = metadata.document_ids(files)
    assert {(r["kind"], r["id"]) for r in ids.where("path = 'child'").collect()} == {("own", "AA"), ("own", "BB"), ("own", "0A"), ("own", "0B"), ("ref", "OO"), ("ref", "PP")}
    assert {tuple(r) for r in relations.cross_reference(ids).collect()} == {("child", "parent", "derived_from"), ("parent", "child", "parent_of")}


def test_dates(spark):
    files = spark.createDataFrame([("a", "/CreationDate (D:20200102030405Z) /ModDate (D:20209902030405)"), ("b", None)], "path string, text string")
    assert [(r["key"], str(r["ts"])) for r in metadata.raw_dates(files).collect()] == [("CreationDate", "2020-01-02 03:04:05")]
    meta = "[PDF] Create Date : 2020:01:02 03:04:05+01:00\n[PDF] Modify Date : 2021:01:02 03:04:05\nnoise\n[PDF] Producer : \n[XMP-pdf] Producer : Tool 1\n[PDF] Bad : 2020:13:45 00:00:00"
    lines = metadata.lines(spark.createDataFrame([("a", meta)], "path string, meta string"))
    assert metadata.first_values(lines, ["Producer", "Creator Tool"]).first().asDict() == {"path": "a", "producer": "Tool 1", "creator_tool": None}
    dates = metadata.meta_dates(lines)
    shown = dates.selectExpr("tag", "is_aware", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS ts").collect()
    assert {tuple(r) for r in shown} == {("Create Date", True, "2020-01-02 02:04:05"), ("Modify Date", False, "2021-01-02 03:04:05")}
    assert metadata.date_range(dates).count() == 1


def test_timestamp_mismatch(spark):
    text = "/CreationDate (D:20200101101010) /ModDate (D:20200101100000) <xmp:CreateDate>2020-01-01T10:11:11</xmp:CreateDate> <xmp:ModifyDate>2020-01-01T10:00:59</xmp:ModifyDate>"
    rows = metadata.timestamp_mismatch(spark.createDataFrame([("a", text), ("b", None)], "path string, text string")).collect()
    assert {tuple(r) for r in rows} == {("a", "create", 61), ("a", "spoofed", 610)}
