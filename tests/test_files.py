"""JPEG tables, revisions, reports and the folder stream."""

from dossierlake.functions.jpeg import EDITED, ERRORS, WARNINGS, quantisation_tables
from dossierlake.operators import reports, revisions
from dossierlake.sources import files as sources
from dossierlake.streaming.watch import watch

HEAD = b"\xff\xd8\xff\xdb\x00\x43\x00"


def test_quantisation_tables(spark):
    cases = [
        (0, HEAD + bytes(range(1, 65)) + b"\xff\xd9"), (1, b"nothing"), (2, b"\xff\xd8 no table"), (3, b"\xff\xd8\xff\xdb\x00"), (4, b"\xff\xd8\xff\xdb\x00\x43"), (5, HEAD + bytes(60)),
        (6, HEAD + bytes([5]) * 64), (7, HEAD + bytes.fromhex("03020202020303020202030302030303") + bytes([10]) * 48), (8, None), (9, HEAD + bytes.fromhex("181818" + "20" * 13) + bytes(range(48))),
    ]
    got = {r["id"]: r for r in quantisation_tables(spark.createDataFrame(cases, "k int, image binary"), "k", "image").collect()}
    assert got[0]["error"] is None and got[0]["signature"] == "0102030405060708090a0b0c0d0e0f10" and (got[0]["table_id"], got[0]["precision"]) == (0, "8-bit")
    assert [got[i]["error"] for i in (1, 2, 3, 4, 5, 8)] == [*ERRORS, ERRORS[0]]
    assert got[6]["warnings"] == [WARNINGS["CRITICAL"]]
    assert got[7]["match"] == "Photoshop Quality 100 (Maximum)"
    assert EDITED in got[9]["warnings"]


def test_revisions(spark):
    body = b"x" * 600 + b"%%EOF" + b"y" * 300 + b"%%EOF" + b"z" * 200 + b"%%EOF\n"
    files = spark.createDataFrame([("a", body), ("b", b"%%EOF" + b"x" * 900), ("c", b"plain"), ("d", None)], "path string, content binary")
    offsets = revisions.revision_offsets(files)
    assert [tuple(r) for r in offsets.orderBy("rev_idx").collect()] == [("a", 1, 600), ("a", 2, 905)]
    assert all(body.startswith(bytes(r["content"])) and bytes(r["content"]).endswith(b"%%EOF") for r in revisions.revision_bytes(files, offsets).collect())


def test_text_changes(spark):
    pairs = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd"), (None, "n"), ("s", "s")], "old string, new string")
    got = [(([tuple(x) for x in r["additions"]]), [tuple(x) for x in r["deletions"]], len(r["unified"]) > 0) for r in revisions.text_changes(pairs, "old", "new").collect()]
    assert got == [([(2, "x"), (4, "d")], [(2, "b")], True), ([(1, "n")], [], True), ([], [], False)]


def test_reports(spark, tmp_path):
    report = spark.createDataFrame([("a<b", "YES", 'say "hi"'), (None, "NO", "x\ny")], "path string, flag string, note string")
    assert reports.html_rows(report).first()["html"] == '<tr class="high"><td>a&lt;b</td><td>YES</td><td>say &quot;hi&quot;</td></tr>'
    reports.write_csv(report, f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{tmp_path}/csv")
    assert {r["note"] for r in back.collect()} == {'say "hi"', "x\ny"}
    reports.write_json(report, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_files_and_stream(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "one.pdf").write_bytes(b"%PDF-1.4 /JavaScript")
    (folder / "two.PDF").write_bytes(b"x" * 2000)
    (folder / "other.txt").write_bytes(b"no")
    found = sources.pdf_files(spark, str(tmp_path / "in"))
    assert found.count() == 2
    assert [r["error_type"] for r in sources.too_large(found, 1000).collect()] == ["file_too_large"]
    assert sources.readable(found, 1000).count() == 1
    assert "/JavaScript" in sources.raw_windows(sources.readable(found, 1000)).first()["text"]
    for _ in range(2):  # the second run finds nothing new
        watch(spark, str(tmp_path / "in"), sources.inventory, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
