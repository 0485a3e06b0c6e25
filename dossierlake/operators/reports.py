"""Report sinks: CSV, JSON lines and HTML rows, written by Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.scalars import clean_cell


def escaped(value: Column) -> Column:
    """Text for HTML: marks escaped, the ampersand first, line breaks as <br>."""
    marks = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")]
    return reduce(lambda c, m: F.replace(c, F.lit(m[0]), F.lit(m[1])), marks, F.coalesce(value.cast("string"), F.lit("")))


def write_csv(report: DataFrame, path: str) -> None:
    """Cleaned cells, a header, quotes doubled."""
    report.select(*[clean_cell(F.col(c)).alias(c) for c in report.columns]).write.option("header", True).option("escape", '"').csv(path)


def write_json(report: DataFrame, path: str) -> None:
    report.write.option("ignoreNullFields", False).json(path)


def html_rows(report: DataFrame, flag_col: str = "flag") -> DataFrame:
    """html: a table row per report row, its class from the flag."""
    cells = F.concat(*[F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in report.columns])
    css = F.when(F.col(flag_col) == "YES", "high").when(F.col(flag_col) == "Possible", "some").otherwise("none")
    return report.select(F.concat(F.lit('<tr class="'), css, F.lit('">'), cells, F.lit("</tr>")).alias("html"))


# The columns of the report.
COLUMNS = ["ID", "Name", "Altered", "Revisions", "Path", "MD5", "File Created", "File Modified", "EXIF", "Indicators", "Note"]
BOM = b"\xef\xbb\xbf"


def _rows(report: DataFrame):
    """Rows of a report, part by part, so that the driver holds one part."""
    return report.toLocalIterator(prefetchPartitions=True)


def write_csv_file(report: DataFrame, path: str) -> None:
    """One file with a byte order mark, cleaned cells and a header, as table programs read it."""
    import csv
    import io

    with open(path, "wb") as f:
        f.write(BOM)
        text = io.TextIOWrapper(f, "utf-8", newline="")
        out = csv.writer(text)
        out.writerow(report.columns)
        for r in _rows(report.select(*[clean_cell(F.col(c)).alias(c) for c in report.columns])):
            out.writerow(list(r))
        text.flush()


def write_html_file(report: DataFrame, path: str, flag_col: str = "Altered", title: str = "Report") -> None:
    """One page with a table."""
    head = "".join(f"<th>{c}</th>" for c in report.columns)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>.high{{background:#fcc}}.some{{background:#ffc}}</style></head><body><table><tr>{head}</tr>\n')
        for r in _rows(html_rows(report, flag_col)):
            f.write(r["html"] + "\n")
        f.write("</table></body></html>\n")


def write_json_file(report: DataFrame, notes: DataFrame, path: str) -> None:
    """{scan_results: [..], file_annotations: {path: note}} as one file."""
    import json

    with open(path, "w", encoding="utf-8") as f:
        f.write('{"scan_results": [')
        for k, r in enumerate(_rows(report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")))):
            f.write((",\n" if k else "\n") + r["j"])
        f.write('\n], "file_annotations": ')
        json.dump({r["path"]: r["note"] for r in _rows(notes.select("path", "note"))}, f, ensure_ascii=False)
        f.write("}\n")


def write_xlsx(report: DataFrame, path: str, sheet: str = "Report") -> None:
    """A workbook of one sheet: a bold header that stays in sight, wrapped cells, columns as wide as their longest first line, 60 at most."""
    import html
    import zipfile

    from pyspark.sql import functions as F

    rows = report.select(*[clean_cell(F.col(c)).alias(c) for c in report.columns])
    wide = rows.agg(*[F.max(F.length(F.substring_index(F.col(c), "\n", 1))).alias(c) for c in rows.columns]).first()
    widths = [min(max(wide[c] or 0, len(c)) + 2, 60) for c in rows.columns]
    letter = lambda k: (chr(64 + k // 26) if k >= 26 else "") + chr(65 + k % 26)
    cell = lambda n, k, v, s: f'<c r="{letter(k)}{n}" s="{s}" t="inlineStr"><is><t xml:space="preserve">{html.escape(v, False)[:32_000]}</t></is></c>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{html.escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf><alignment wrapText="1" vertical="top"/></xf><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            put = lambda s: f.write(s.encode())
            put(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>')
            put("".join(f'<col min="{k + 1}" max="{k + 1}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths)) + "</cols><sheetData>")
            put('<row r="1">' + "".join(cell(1, k, c, 1) for k, c in enumerate(rows.columns)) + "</row>")
            for n, r in enumerate(_rows(rows), 2):
                put(f'<row r="{n}">' + "".join(cell(n, k, v, 0) for k, v in enumerate(r)) + "</row>")
            put("</sheetData></worksheet>")
