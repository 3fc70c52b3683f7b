"""Word files, the upload check, landing sources, the stream, the registry."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.operators import styles
from paperloom.plans import registry, upload
from paperloom.sources import docx, landing
from paperloom.sources.stage import stored
from paperloom.streaming import queue as stream_queue

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(text, style="Normal", extra="", rpr=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/>{extra}</w:pPr><w:r>{rpr and f"<w:rPr>{rpr}</w:rPr>"}<w:t>{text}</w:t></w:r></w:p>'


def table(rows, tblpr=""):
    cells = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    return f'<w:tbl><w:tblPr>{tblpr}</w:tblPr><w:tblGrid>{"<w:gridCol/>" * len(rows[0])}</w:tblGrid>{cells}</w:tbl>'


STYLES = f'''<w:styles {NS}><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>
<w:style w:type="paragraph" w:styleId="Base"><w:name w:val="Base"/><w:pPr><w:jc w:val="center"/><w:spacing w:before="0" w:after="60"/></w:pPr><w:rPr><w:b/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="T"><w:name w:val="JACoW_Paper Title"/><w:basedOn w:val="Base"/><w:rPr><w:sz w:val="28"/></w:rPr></w:style></w:styles>'''


def word(blocks, core=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {NS}><w:body>{"".join(blocks)}<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="2098" w:bottom="1077" w:left="1134" w:right="1134"/></w:sectPr></w:body></w:document>')
        z.writestr("word/styles.xml", STYLES)
        z.writestr("docProps/core.xml", f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/"><dc:creator>Me</dc:creator><dcterms:created>2024-01-02T03:04:05Z</dcterms:created>{core}</cp:coreProperties>')
    return out.getvalue()


PAPER = [
    p("A GREAT TITLE", "T"), p("A. Bee, C. Dee"), p("Abstract"), p("This paragraph cites Fig. 1 and Table 1 and also [1] at some length indeed."),
    p("Figure 1: A beam line."), p("Table 1: Beam Data"), table([["a", "b"], ["1", "2"]], '<w:tblW w:w="0" w:type="auto"/>'), p("REFERENCES"), '<w:p><w:r><w:t>[1]</w:t><w:tab/><w:t>A paper</w:t></w:r></w:p>',
]


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docx")
    (folder / "abc12.docx").write_bytes(word(PAPER))
    (folder / "tracked.docx").write_bytes(word([p("X"), "<w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p>", p("Abstract")]))
    (folder / "bare.docx").write_bytes(word([p("Nothing")]))
    (folder / "bad.docx").write_bytes(b"not a zip")
    (folder / "notes.txt").write_bytes(b"text")
    (folder / "other").mkdir()
    (folder / "other" / "abc12.docx").write_bytes(word([p("Other"), p("Abstract")]))
    return stored(docx.read_docx(spark, str(folder)).unionByName(docx.read_docx(spark, str(folder / "other"))), "parsed")


def test_parse(parsed):
    both = parsed.where("filename = 'abc12.docx'").collect()
    assert len({r.doc_id for r in both}) == 2  # files of one name in two folders
    row = max(both, key=lambda r: len(r.paragraphs))
    assert row.parse_error is None and row.paper_code == "ABC12" and row.author == "Me"
    assert row.paragraphs[0].text == "A GREAT TITLE" and row.paragraphs[-1].text == "[1]\tA paper" and len(row.paragraphs) == 12
    assert row.tables[0].n_rows == 2 and row.tables[0].has_text and row.tables[0].prev_para_no == 5 and row.tables[0].table_no == 1
    assert {r.filename for r in parsed.where("parse_error is not null").collect()} == {"bad.docx", "notes.txt"}
    shown = [r.in_table for r in styles.paragraph_inventory(docx.table(parsed, "paragraphs")).collect()]
    assert "Table 1:<br/>row 1, col 2" in shown and not any(x.startswith("Table 0") for x in shown)
    assert upload.metadata(parsed).where("filename = 'abc12.docx'").first().created == "02/01/2024 03:04"


def test_columns_of_merged_cells():
    def cell(text, props=""):
        return f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}</w:tc>"

    below, wide, inner = '<w:vMerge/>', '<w:gridSpan w:val="2"/>', table([["deep", "er"]])
    rows = [
        cell("a", wide) + cell("b", '<w:vMerge w:val="restart"/>'),
        cell("c") + f"<w:tc>{inner}{p('d')}</w:tc>" + cell("", below),
    ]
    grid = f'<w:tbl><w:tblPr/><w:tblGrid>{3 * "<w:gridCol/>"}</w:tblGrid>{"".join(f"<w:tr>{r}</w:tr>" for r in rows)}<w:tr><w:trPr><w:gridBefore w:val="1"/></w:trPr>{cell("e")}</w:tr></w:tbl>'
    found = docx.parse_docx(word([grid]))
    assert [(x["text"], x["row_no"], x["col_no"]) for x in found["paragraphs"]] == [("a", 1, 1), ("b", 1, 3), ("c", 2, 1), ("d", 2, 2), ("e", 3, 2)]
    assert [(x["n_rows"], x["n_cols"], x["has_text"]) for x in found["tables"]] == [(3, 3, True)]


def test_upload_check(parsed):
    whole = parsed.where("filename <> 'abc12.docx' or size(paragraphs) > 5 or paragraphs is null")
    checked = upload.upload_check(stored(whole, "whole"))
    assert "MapInArrow" not in checked._jdf.queryExecution().executedPlan().toString()  # nothing is parsed again
    rows = checked.join(whole.select("doc_id", "filename"), "doc_id").collect()
    found = {(r.section, r.check_name): r.verdict for r in rows if r.filename == "abc12.docx"}
    assert found["Title", "style_ok"] == "ok" and found["Title", "case_ok"] == "ok" and found["Title", "title_style_ok"] == "ok"
    assert found["Figures", "used_ok"] == "ok" and found["Figures", "caption_ok"] == "ok" and found["Tables", "order_ok"] == "ok" and found["Tables", "text_format_ok"] == "ok"
    assert found["References", "used_ok"] == "ok" and found["References", "text_ok"] == "ok" and found["Margins", "margins_ok"] == "ok" and found["Margins", "columns_ok"] == "ok"
    stopped = {r.filename: r.message for r in rows if r.section == "Document"}
    assert stopped["tracked.docx"] == "tracked changes are on" and stopped["bare.docx"] == "abstract header not found" and set(stopped) == {"tracked.docx", "bare.docx", "bad.docx", "notes.txt"}
    report = max(upload.report(parsed).where("filename = 'abc12.docx'").collect(), key=lambda r: len(r.report))
    told = json.loads(report.report)
    assert told["scores"]["total"][0] > 0 and told["sections"]["References"] in ("ok", "fail") and report.key.endswith(".json")
    assert any("alignment" in (f.get("details") or "") for f in told["summary"])


def run_of(text, rpr=""):
    return f'<w:r>{rpr and f"<w:rPr>{rpr}</w:rPr>"}<w:t>{text}</w:t></w:r>'


def test_fonts_capitals_and_caption_styles(spark, tmp_path):
    """Character styles come before a run's own font, URLs have no say in a reference's, capitals and footnote marks count as shown."""
    mono = '<w:style w:type="character" w:styleId="M"><w:name w:val="JACoW_Reference url_doi"/><w:rPr><w:rFonts w:ascii="Liberation Mono"/><w:sz w:val="16"/></w:rPr></w:style>'
    caps = '<w:style w:type="paragraph" w:styleId="C"><w:name w:val="Caps"/><w:rPr><w:caps/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="B"><w:name w:val="Of Caps"/><w:basedOn w:val="C"/></w:style>'
    figure = '<w:style w:type="paragraph" w:styleId="F"><w:name w:val="Figure Caption"/></w:style>'
    linked = f'<w:p>{run_of("[1]")}<w:r><w:tab/></w:r>{run_of("A paper ")}{run_of("doi:10.1/x", '<w:rStyle w:val="M"/><w:rFonts w:ascii="Times"/>')}</w:p>'
    blocks = [p("a small title", "B"), f'<w:p>{run_of("A. Bee")}{run_of("1", '<w:vertAlign w:val="superscript"/>')}</w:p>', p("Abstract"), p("Table 1: In A Figure Style", "F"), table([["a", "b"], ["1", "2"]]), p("REFERENCES"), linked]
    data = word(blocks).replace(b"x", b"x")
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            text = old.read(name).decode()
            new.writestr(name, text.replace("</w:styles>", mono + caps + figure + "</w:styles>"))
    (tmp_path / "x1.docx").write_bytes(out.getvalue())
    parsed = stored(docx.read_docx(spark, str(tmp_path)), "fonts")
    found = {(r.section, r.check_name): r.verdict for r in upload.upload_check(parsed).collect()}
    assert found["Title", "case_ok"] == "ok" and found["References", "text_ok"] == "ok" and found["Tables", "style_ok"] == "unknown"
    strict = {(r.section, r.check_name): r.verdict for r in upload.upload_check(parsed, strict=True).collect()}
    assert strict["References", "style_ok"] == "fail"
    catalogue = spark.createDataFrame([("X1", "A SMALL TITLE", ["A. Bee"])], "paper_id string, title string, authors array<string>")
    assert {(r.check_name, r.verdict) for r in upload.catalogue_check(parsed, catalogue).collect()} == {("title_ok", "ok"), ("author_ok", "ok"), ("authors_ok", "ok")}


def test_catalogue_check(spark, parsed):
    catalogue = spark.createDataFrame([("ABC12", "A great  title", ["C. Dee", "A. X. Bee"])], "paper_id string, title string, authors array<string>")
    parsed = stored(parsed.where("filename <> 'abc12.docx' or size(paragraphs) > 5"), "catalogued")
    found = [(r.check_name, r.verdict) for r in upload.catalogue_check(parsed, catalogue).orderBy("check_name", "item_no").collect()]
    assert found == [("author_ok", "ok"), ("author_ok", "unknown"), ("authors_ok", "ok"), ("title_ok", "ok")]
    report = json.loads(upload.report(parsed, catalogue).where("filename = 'abc12.docx'").first().report)
    assert report["sections"]["Catalogue"] == "ok" and report["scores"]["Catalogue"] == [3, 1, 0]


def test_landing(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"contribution": {"id": 5}, "revisions": [{"id": 1, "files": [{"filename": "a.tex", "file_type": 180}]}]}\nnot json\n')
    rows = landing.read_contributions(spark, str(tmp_path / "c.json")).collect()
    assert [r.contribution and r.contribution.id for r in rows] == [5, None] and rows[1]._corrupt_record == "not json"
    (tmp_path / "x.tex").write_text("\\a\nb")
    assert landing.read_tex(spark, str(tmp_path / "x.tex")).first() == ("x.tex", "\\a\nb")


def test_landed_lists_and_objects(spark, tmp_path):
    lists = spark.createDataFrame([(7, '[{"id": 3}, {"id": 4}]'), (8, "[]")], "event_id int, body string")
    assert [tuple(r) for r in landing.paper_list(lists).orderBy("contribution_id").collect()] == [(7, 3), (7, 4)]
    (tmp_path / "o.json").write_bytes(b"{}")
    row = landing.read_objects(spark, str(tmp_path)).first()
    assert row.length == 2 and bytes(row.content) == b"{}"


def test_one_notification_a_window(spark, tmp_path):
    from paperloom.operators.routing import validate

    (tmp_path / "in").mkdir()
    rows = [{"action": "create", "contrib_id": i, "editable_type": "paper", "event": "indico-75"} for i in (3, 3, 4)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    first = stream_queue.first_in_window(validate(stream_queue.notifications(spark, str(tmp_path / "in"))))
    q = first.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.contrib_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3, 4]


def test_notifications_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {"action": "create", "contrib_id": 3, "editable_type": "paper", "event": "indico-75"}
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(x) for x in (good, good | {"action": "delete"}, good | {"event": None})))
    q = stream_queue.start(stream_queue.notifications(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "queue"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert [(r.event_id, r.revision_id) for r in spark.read.parquet(str(tmp_path / "queue")).collect()] == [("75", -1)]


@pytest.mark.parametrize("name", ["queue_head", "bibitem_issues", "citation_order", "caption_format", "reference_list", "title_case"])
def test_registered_queries_have_rows(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1


def test_filters_reach_the_scan(spark):
    plan = registry.QUERIES["queue_head"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("contribution_id"), F.col("o_orderdate").alias("requested"))
    from paperloom.operators.queue import recently_queued

    assert "PushedFilters: [IsNotNull(o_custkey)" in recently_queued(orders, 5, "2024-01-01")._jdf.queryExecution().toString()
