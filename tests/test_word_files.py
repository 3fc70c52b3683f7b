"""The data source for Word files and its pull parser, figures far apart and missing authors."""

import io
import tracemalloc
import zipfile

import pytest
from test_documents import NS, PAPER, STYLES, p, table, word

from paperloom.operators import captions, scoring
from paperloom.plans import fixtures, upload
from paperloom.sources import docx, word as source
from paperloom.sources.stage import gathered, release, scratch, stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def papers(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    files = stored(fixtures.word_files(spark.sql(f"SELECT * FROM {fixtures.BLOCKS}", orders=orders)), "files")
    folder = scratch(spark, "papers")
    assert fixtures.write_files(files, folder) == files.count()
    return files, folder


def test_source_reads_what_bytes_hold(spark, papers):
    files, folder = papers
    columns = ["filename", "parse_error", "paper_code", *docx.COLUMNS]
    want = {r.filename: tuple(r) for r in docx.parsed_docs(files).select(columns).collect()}
    found = docx.read_docx(spark, folder, partition_bytes=1 << 20)
    got = {r.filename: tuple(r) for r in found.select(columns).collect()}
    assert got == want and found.select("doc_id").distinct().count() == len(want)
    assert found.rdd.getNumPartitions() >= 3
    # A filter takes nothing from other uses of the same load.
    assert found.where("filename = 'p1.docx'").count() == 1 and found.count() == len(want)
    assert {r.filename for r in docx.read_docx(spark, folder, pathGlobFilter="p1?.docx").collect()} == {f for f in want if len(f) == 8 and f.startswith("p1") and f.endswith(".docx")}


def test_only_columns_asked_for_are_built(spark, papers):
    slim = docx.read_docx(spark, papers[1], ("paragraphs",))
    assert slim.columns == ["doc_id", "filename", "parse_error", "paragraphs", "paper_code"]
    whole = docx.parse_docx(word(PAPER))
    assert docx.parse_docx(word(PAPER), ("tables",)) == {"tables": whole["tables"]}
    assert docx.parse_docx(word(PAPER), ("author", "paragraphs")) == {"author": "Me", "paragraphs": whole["paragraphs"]}


def test_source_edges(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert docx.read_docx(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "A.b.DOCX").write_bytes(word(PAPER))
    (tmp_path / "deep" / "none").write_bytes(b"")
    (tmp_path / "deep" / "er" / "c.docx").write_bytes(b"")
    here = {r.filename: (r.paper_code, bool(r.parse_error)) for r in docx.read_docx(spark, f"file://{tmp_path}/deep").collect()}
    assert here == {"A.b.DOCX": ("A.B", False), "none": ("NONE", True)}
    assert docx.read_docx(spark, str(tmp_path / "deep"), recursive="true").count() == 3
    assert docx.read_docx(spark, str(tmp_path / "deep" / "A.b.DOCX")).count() == 1


def test_files_are_dealt_by_size():
    parts = source.dealt([(f"f{i:03}", size) for i, size in enumerate([10] * 8 + [1 << 20] + [200_000] * 6)], 1 << 19)
    assert sorted(x for part in parts for x in part) == sorted((f"f{i:03}", size) for i, size in enumerate([10] * 8 + [1 << 20] + [200_000] * 6))
    assert [("f008", 1 << 20)] in parts and all(len(part) == 1 or sum(max(s, source.OPEN_COST) for _, s in part) <= 1 << 19 for part in parts)


def archive(document, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("word/document.xml", "w") as f:
            for piece in document:
                f.write(piece)
        for name, text in {"word/styles.xml": STYLES, **more}.items():
            z.writestr(name, text)
    return out.getvalue()


def test_bombs_become_error_rows(spark, tmp_path):
    head = f"<w:document {NS}><w:body>".encode()
    bomb = archive([head, *[b" " * (1 << 20)] * 300, b"</w:body></w:document>"])
    assert len(bomb) < 1 << 20
    entities = b'<!DOCTYPE x [<!ENTITY a "aaaaaaaaaa">]>' + head + b"</w:body></w:document>"
    files = {"bomb.docx": bomb, "types.docx": archive([entities]), "cut.docx": bomb[: len(bomb) // 2], "good.docx": word(PAPER)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.filename: r.parse_error for r in docx.read_docx(spark, str(tmp_path)).collect()}
    assert "inflates to more" in rows["bomb.docx"] and "document type" in rows["types.docx"] and rows["cut.docx"] and rows["good.docx"] is None
    tight = {r.filename: r.parse_error for r in docx.read_docx(spark, str(tmp_path), most_inflated=1000).collect()}
    assert "inflates to more" in tight["good.docx"]


def test_a_long_document_takes_little_memory():
    """200 MB of XML: what Word repeats at each run and what stands between, and a table of many rows."""
    noise = b'<w:bookmarkStart w:id="1" w:name="' + b"x" * 2000 + b'"/><w:proofErr w:type="spellStart"/>'
    block = b'<w:p w:rsidR="00A1"><w:r><w:t>text of a paragraph</w:t></w:r>' + noise + b"</w:p>"
    row = b"<w:tr><w:tc><w:p>" + noise + b"</w:p></w:tc></w:tr>"
    pieces = [f"<w:document {NS}><w:body>".encode(), *[block * 12] * 4300, b"<w:tbl><w:tblPr/><w:tblGrid><w:gridCol/></w:tblGrid>", *[row * 12] * 4300, b"</w:tbl><w:sectPr/></w:body></w:document>"]
    assert sum(map(len, pieces)) > 200_000_000
    data = archive(pieces)
    tracemalloc.start()
    found = docx.parse_docx(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found["paragraphs"]) == 103_200 and found["tables"][0]["n_rows"] == 51_600 and len(found["sections"]) == 1
    assert peak < 100_000_000


def test_blocks_keep_their_numbers():
    odd = [p("a"), "<w:sdt><w:p/></w:sdt>", table([["b", ""], ["", "c"]]), '<w:bookmarkEnd w:id="1"/>', p("d"), table([["e"]])]
    found = docx.parse_docx(word(odd))
    assert [(x["text"], x["block_no"], x["para_no"]) for x in found["paragraphs"]] == [("a", 0, 0), ("b", 2, 1), ("", 2, 2), ("", 2, 3), ("c", 2, 4), ("d", 4, 5), ("e", 5, 6)]
    assert [(t["table_no"], t["block_no"], t["n_rows"], t["prev_para_no"]) for t in found["tables"]] == [(1, 2, 2, 0), (2, 5, 1, 5)]


def test_figures_far_apart(spark):
    rows = [(1, 1, "Figure 2: A"), (1, 2, "See Fig. 4 there"), (1, 3, "Figure 3000000: B"), (1, 4, "Fig. 2147483647 C"), (2, 1, "Figure 0: none"), (3, 1, "Figure 99999999999999999999: too long"), (4, 1, "Fig. 1 x")]
    found = captions.correlate_figures(captions.figure_marks(spark.createDataFrame(rows, "doc_id int, seq bigint, text string")))
    one = [(r.id, r.numbers, r.found_ok, r.used_ok, r.caption_ok) for r in found.where("doc_id = 1").orderBy("id").collect()]
    assert one == [(1, 1, False, False, False), (2, 1, True, False, True), (3, 1, False, False, False), (4, 1, False, True, False), (5, 2999995, False, False, False), (3000000, 1, True, False, True), (3000001, 2144483646, False, False, False), (2147483647, 1, True, True, False)]
    assert {r.doc_id for r in found.collect()} == {1, 4}
    few = captions.each_number(found.where("id < 3000000"))
    assert few.where("doc_id = 1").count() == 2999999 and few.where("doc_id = 1").agg({"id": "sum"}).first()[0] == 2999999 * 3000000 // 2


def test_wrong_captions_have_a_style_and_missing_authors_a_finding(spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(word([p("A GREAT TITLE", "T"), p("Abstract"), p("Fig. 1 A beam"), p("Figure 90000000: far")]))
    parsed = stored(docx.read_docx(spark, str(tmp_path)), "x")
    findings = stored(upload.upload_check(parsed), "findings")
    found = {(r.section, r.item_no, r.check_name): (r.verdict, r.items, r.message) for r in findings.collect()}
    assert found["Figures", 1, "style_ok"][0] == "unknown" and found["Figures", 1, "caption_ok"][0] == "fail"
    assert found["Figures", 2, "found_ok"][:2] == ("fail", 89999998) and ("Figures", 3, "found_ok") not in found
    assert found["Authors", 0, "found_ok"] == ("fail", 1, "authors not found")
    scores = {r.section: r.negative for r in scoring.score(findings).collect()}
    assert scores["Figures"] == 4 * 89999998 + 2 and scores["Authors"] == 1
    assert {r.section: r.verdict for r in scoring.section_summary(parsed, findings).collect()}["Authors"] == "fail"


def test_scratch_is_released(spark, tmp_path):
    kept = stored(spark.range(3).selectExpr("id + 1 as id"), "kept")
    assert kept.count() == 3 and stored(kept, "again") is kept and release(spark) >= 1 and release(spark) == 0


def test_a_worker_holds_few_papers_at_a_time(spark):
    """A batch of Spark's is worked off in slices, files are deflated, and tasks grow in number with the shuffle's."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["doc_id"])
    cut = list(fixtures._few([batch]))
    assert max(x.num_rows for x in cut) <= fixtures.AT_ONCE and sum(x.num_rows for x in cut) == 1000
    lines = [("JACoW_Body Text Indent", "Study of the storage ring.", "", "body")] * 50
    data = fixtures.word_file(1, lines)
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        assert len(data) < sum(x.file_size for x in archive.infolist()) / 3
    blocks = spark.createDataFrame([(d, p, "Normal", "x", "", "body") for d in range(40) for p in range(3)], "doc_id long, pos long, style string, text string, rpr string, kind string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        made = fixtures.word_files(blocks)
        assert made.rdd.getNumPartitions() == 9 and made.count() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sections_are_written_by_jobs_of_their_own(spark):
    """What is gathered is a table: no plan holds more than one part, and rows that repeat stay."""
    parts = [spark.range(5).selectExpr("id", "'a' as section"), spark.range(3).selectExpr("id", "'b' as section"), spark.range(3).selectExpr("id", "'b' as section")]
    found = gathered(parts, "parts")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "Union" not in plan and "Range" not in plan and stored(found, "again") is found
    assert sorted(map(tuple, found.collect())) == sorted([(n, "a") for n in range(5)] + 2 * [(n, "b") for n in range(3)])


def _odd_files():
    made, body = [], '<w:p><w:pPr><w:pStyle w:val="A"/><w:jc w:val="both"/></w:pPr><w:r><w:t>a</w:t><w:tab/><w:br/></w:r><w:ins><w:r><w:t>n</w:t></w:r></w:ins></w:p><w:sdt><w:p/></w:sdt>'
    cells = '<w:tr><w:tc><w:p><w:r><w:rPr><w:b/><w:vertAlign w:val="superscript"/></w:rPr><w:t> x</w:t></w:r></w:p></w:tc></w:tr>'
    grid = '<w:tblPr><w:tblpPr w:tblpY="7"/></w:tblPr><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid>'
    bodies = [body, f"<w:tbl>{grid}{cells}{cells}</w:tbl>{body}", f"<w:tbl>{cells}{grid}{cells}</w:tbl><w:tbl>{grid}</w:tbl>", "<w:p/><w:sectPr><w:cols w:num='2'/></w:sectPr>", ""]
    for text in [f"<w:document {fixtures._NS}><w:body>{b}</w:body><w:body>{b}</w:body></w:document>" for b in bodies] + ["", "<w:document", f"<w:document {fixtures._NS}><w:body>{body}", '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>', "<?xml version='1.0' encoding='none'?><a/>"]:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr("word/document.xml", text)
            archive.writestr("word/styles.xml", fixtures._styles())
        made.append(out.getvalue())
    return made


def test_whole_trees_and_events_make_the_same(monkeypatch):
    def parsed():
        out = []
        for file in _odd_files():
            try:
                out.append(docx.parse_docx(file))
            except Exception as e:  # noqa: BLE001
                out.append(f"{type(e).__name__}: {e}")
        return out

    whole, used = parsed(), []
    monkeypatch.setattr(docx, "WHOLE_TREE", 0)
    monkeypatch.setattr(docx._Body, "document", lambda *a: used.append(a))
    assert parsed() == whole and not used and "document type" in whole[-2] and whole[1]["tables"][0]["n_cols"] == 2


def test_papers_of_one_template_have_their_styles_read_once(monkeypatch):
    """Its sheet took as long as a short paper's text, for every paper again."""
    read, plain = [], docx._tree
    monkeypatch.setattr(docx, "_sheets", {})
    monkeypatch.setattr(docx, "_tree", lambda data: read.append(data) or plain(data))
    rows = [docx.parse_docx(fixtures.word_file(d, [("Normal", "x", "", "body")])) for d in (5, 10, 15)]
    assert len(read) == 1 and len(rows[2]["styles"]) == 9 and rows[0]["styles"] == rows[2]["styles"]


def test_sections_don_t_look_for_reasons_again(spark):
    """Every section read all paragraphs of each document to tell whether it is checked."""
    from paperloom.plans import upload

    files = spark.createDataFrame([(d, f"p{d}.docx", fixtures.word_file(d, [("Normal", t, "", "body")])) for d, t in ((1, "x"), (2, "Abstract"), (29, "x"))], "doc_id bigint, filename string, content binary")
    held = upload.prepared(docx.parsed_docs(files))
    assert upload.prepared(held) is held
    assert dict(held.select("doc_id", upload.REASON).collect()) == {1: "abstract header not found", 2: None, 29: "BadZipFile: File is not a zip file"}
    plans = [s._jdf.queryExecution().optimizedPlan().toString() for s in upload._upload_sections(held, False, None)]
    assert not any("tracked changes are on" in p for p in plans)
