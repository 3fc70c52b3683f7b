"""Word documents as tables.

``read_docx`` reads files with the data source ``docx`` (``sources.word``) and ``parsed_docs`` parses
bytes that a table holds; each file is parsed once, and one that can't be becomes a row with
``parse_error``.  A document's XML of up to ``WHOLE_TREE`` bytes is built as a tree; a larger one is pulled as
events, and what is kept of it at a time is one paragraph or row of a table, beside the rows made so far.  What a file inflates to is bounded.  Paragraph text
is the concatenation of the paragraph's own runs (not those inside links); tabs and breaks become
characters.  Cells merged across columns or rows are read once, at the first place they cover;
columns count places of the table's grid.  A table within a cell isn't one of the document's tables.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree as ET
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.functions.text import extension_ok, paper_code

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CORE = {
    "author": "{http://purl.org/dc/elements/1.1/}creator",
    "language": "{http://purl.org/dc/elements/1.1/}language",
    "revision": "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}revision",
    "version": "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}version",
    "created": "{http://purl.org/dc/terms/}created",
    "modified": "{http://purl.org/dc/terms/}modified",
}
ALIGN = {"center": "CENTER", "both": "JUSTIFY", "left": "LEFT", "start": "LEFT", "right": "RIGHT", "end": "RIGHT", "distribute": "DISTRIBUTE"}
TWIP, HALF_POINT = 635, 6350

_FMT = "alignment:string,before_emu:bigint,after_emu:bigint,first_line_emu:bigint,hanging_emu:bigint,left_emu:bigint"
_FONT = "bold:boolean,italic:boolean,all_caps:boolean,size_emu:bigint,font_name:string"
SCHEMA = (
    "filename string, parse_error string, author string, revision string, version string, language string, created string, modified string, "
    f"styles array<struct<name:string,base_name:string,{_FMT},{_FONT}>>, "
    f"paragraphs array<struct<scope:string,block_no:int,para_no:bigint,table_no:int,row_no:int,col_no:int,text:string,style_name:string,{_FMT},has_insertion:boolean,has_deletion:boolean>>, "
    f"runs array<struct<para_no:bigint,run_no:int,text:string,style_name:string,superscript:boolean,{_FONT}>>, "
    "tables array<struct<table_no:int,block_no:int,n_rows:int,n_cols:int,has_text:boolean,anchored:boolean,tblpY:int,tblW_type:string,prev_para_no:bigint>>, "
    "sections array<struct<section_no:int,page_w:bigint,page_h:bigint,top:bigint,bottom:bigint,left:bigint,right:bigint,cols_num:int,cols_space_twips:int>>"
)
WHOLE_SCHEMA = f"doc_id string, {SCHEMA}, paper_code string"
#: The columns that come from within a file.
COLUMNS = ("author", "revision", "version", "language", "created", "modified", "styles", "paragraphs", "runs", "tables", "sections")
#: Bytes that a file's XML may inflate to; what a zip bomb holds beyond is never read.
MOST_INFLATED = 1 << 28
#: Bytes of a member up to which its tree is built whole, which is several times as fast as events.
WHOLE_TREE = 1 << 18
#: Style sheets that a process remembers, and bytes of one at most: papers of one template share theirs.
SHEETS, SHEET_BYTES = 32, 1 << 17


def _value(node, name: str, attr: str = "val"):
    child = node.find(W + name) if node is not None else None
    return None if child is None else child.get(W + attr)


def _number(text, unit: int = 1):
    try:
        return None if text is None else round(float(text) * unit)
    except ValueError:
        return None


_P, _R, _T, _PPR, _RPR, _STYLE, _ROW = (W + n for n in ("p", "r", "t", "pPr", "rPr", "pStyle", "tr"))
_TEXTS = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n", W + "noBreakHyphen": "-"}


def _toggle(node, name: str):
    child = node.find(W + name) if node is not None else None
    return None if child is None else child.get(W + "val", "true") not in ("0", "false", "off")


def _paragraph_format(props) -> dict:
    if props is None or (len(props) == 1 and props[0].tag == _STYLE):
        return _NO_FORMAT
    spacing = props.find(W + "spacing") if props is not None else None
    indent = props.find(W + "ind") if props is not None else None
    get = lambda node, *names: next((v for n in names if node is not None and (v := _number(node.get(W + n), TWIP)) is not None), None)
    return {
        "alignment": ALIGN.get(_value(props, "jc")), "before_emu": get(spacing, "before"), "after_emu": get(spacing, "after"),
        "first_line_emu": get(indent, "firstLine"), "hanging_emu": get(indent, "hanging"), "left_emu": get(indent, "left", "start"),
    }


_NO_FORMAT = dict.fromkeys(("alignment", "before_emu", "after_emu", "first_line_emu", "hanging_emu", "left_emu"))
_NO_FONT = dict.fromkeys(("bold", "italic", "all_caps", "size_emu", "font_name"))


def _font(props) -> dict:
    if props is None or not len(props):
        return _NO_FONT
    return {
        "bold": _toggle(props, "b"), "italic": _toggle(props, "i"), "all_caps": _toggle(props, "caps"),
        "size_emu": _number(_value(props, "sz"), HALF_POINT), "font_name": _value(props, "rFonts", "ascii"),
    }


def _run_text(run) -> str:
    return "".join([child.text or "" if child.tag == _T else _TEXTS.get(child.tag, "") for child in run])


class _Body:
    """Takes a document's blocks in order and collects rows; ``wanted`` names the columns to fill."""

    def __init__(self, names: dict[str, str], default: str | None, wanted: frozenset[str]):
        self.names, self.default = names, default
        self.with_runs, self.with_paragraphs = "runs" in wanted, "paragraphs" in wanted
        self.paragraphs, self.runs, self.tables, self.sections = [], [], [], []
        self.count, self.before, self.open = 0, None, None

    def document(self, root) -> None:
        """All blocks of a whole tree, as ``_Puller`` hands them over one by one."""
        block = 0
        for body in root.findall(W + "body"):
            for node in body:
                if node.tag == W + "tbl":
                    rows = node.findall(_ROW)
                    if rows:  # what stands after the first row isn't known where that is read
                        del node[list(node).index(rows[0]) :]
                    for row in rows:
                        self.row(node, row, block)
                self.block(node, block)
                block += 1

    def block(self, node, block: int) -> None:
        """A paragraph, the end of a table or the last section, all of its rows taken before."""
        if node.tag == W + "p":
            self.before = self.count
            self.paragraph(node, scope="body", block_no=block, table_no=None, row_no=None, col_no=None)
        elif node.tag == W + "tbl":
            self.row(node, None, block)
            self.open = None
        elif node.tag == W + "sectPr":
            self.section(node)

    def paragraph(self, p, **place) -> str:
        props, number, parts = p.find(_PPR), self.count, []
        self.count += 1
        for n, run in enumerate(p.findall(_R)):
            text = _run_text(run)
            parts.append(text)
            if self.with_runs:
                rpr = run.find(_RPR)
                style, raised = (None, False) if rpr is None else (_value(rpr, "rStyle"), _value(rpr, "vertAlign") == "superscript")
                self.runs.append({"para_no": number, "run_no": n, "text": text, "style_name": self.names.get(style), "superscript": raised, **_font(rpr)})
        text = "".join(parts)
        if self.with_paragraphs:
            style = self.names.get(_value(props, "pStyle"), self.default)
            self.paragraphs.append({"para_no": number, "text": text, "style_name": style, "has_insertion": p.find(W + "ins") is not None, "has_deletion": p.find(W + "del") is not None, **place, **_paragraph_format(props)})
        if props is not None and props.find(W + "sectPr") is not None:
            self.section(props.find(W + "sectPr"))
        return text

    def section(self, s) -> None:
        size, margin, cols = (s.find(W + n) for n in ("pgSz", "pgMar", "cols"))
        get = lambda node, n, unit=TWIP: None if node is None else _number(node.get(W + n), unit)
        self.sections.append({"section_no": len(self.sections), "page_w": get(size, "w"), "page_h": get(size, "h"), **{k: get(margin, k) for k in ("top", "bottom", "left", "right")}, "cols_num": get(cols, "num", 1), "cols_space_twips": get(cols, "space", 1)})

    def row(self, t, tr, block: int) -> None:
        """One row of the table ``t``, whose properties and grid stand before its rows; no row at its end."""
        if self.open is None:
            props = t.find(W + "tblPr")
            place = props.find(W + "tblpPr") if props is not None else None
            self.open = {"table_no": len(self.tables) + 1, "block_no": block, "n_rows": 0, "n_cols": len(t.findall(f"{W}tblGrid/{W}gridCol")), "prev_para_no": self.before, "has_text": False}
            self.open |= {"anchored": place is not None, "tblpY": None if place is None else _number(place.get(W + "tblpY")), "tblW_type": _value(props, "tblW", "type")}
            self.tables.append(self.open)
        if tr is None:
            return
        self.open["n_rows"] += 1
        column = _number(_value(tr.find(W + "trPr"), "gridBefore")) or 0
        for tc in tr.findall(W + "tc"):
            props = tc.find(W + "tcPr")
            c, column = column, column + max(1, _number(_value(props, "gridSpan")) or 1)
            merge = props.find(W + "vMerge") if props is not None else None
            if merge is not None and merge.get(W + "val", "continue") == "continue":
                continue  # the merged cell's text stands in its first row
            for p in tc.findall(W + "p"):
                text = self.paragraph(p, scope="cell", block_no=block, table_no=self.open["table_no"], row_no=self.open["n_rows"], col_no=c + 1)
                self.open["has_text"] |= bool(text.strip())


class _Plain(ET.TreeBuilder):
    """Builds a tree; Word's files have no document type, and one could name entities that grow."""

    def doctype(self, name, pubid, system):
        raise ValueError("a document type isn't allowed")


class _Puller(_Plain):
    """Hands blocks and rows of tables to a body as they end, and lets go of them."""

    def __init__(self, body: _Body):
        super().__init__()
        self.to, self.path, self.blocks = body, [], 0

    def start(self, tag, attrs):
        node = super().start(tag, attrs)
        self.path.append(node)
        return node

    def end(self, tag):
        node, depth = super().end(tag), len(self.path)
        self.path.pop()
        if depth in (3, 4) and self.path[1].tag == W + "body":
            if depth == 3:
                self.to.block(node, self.blocks)
                self.blocks += 1
                self.path[1].clear()
            elif tag == W + "tr" and self.path[2].tag == W + "tbl":
                self.to.row(self.path[2], node, self.blocks)
                self.path[2].remove(node)
            elif self.path[2].tag not in (W + "p", W + "tbl", W + "sectPr"):
                self.path[2].clear()
        return node


class _Begun(Exception):
    """The root of an XML document has begun."""


def _has_plain_start(data: bytes) -> bool:
    """Whether a document comes to its root without a document type; what can't be read so far has none of either."""

    def begun(*_):
        raise _Begun

    parser, types = expat.ParserCreate(), []
    parser.StartDoctypeDeclHandler = lambda *_: types.append(1)
    parser.StartElementHandler = begun
    try:
        parser.Parse(data, True)
    except _Begun:
        return not types
    except Exception:  # noqa: BLE001  the whole parser says what is wrong
        pass
    return False


def _start(stream, room: list[int]) -> tuple[bytes, bool]:
    """(bytes, whether they are all) of a member's first ``WHOLE_TREE``; ``room`` holds the bytes that the archive may still inflate to."""
    held, size = [], 0
    while size <= WHOLE_TREE and (chunk := _read(stream, room)):
        held.append(chunk)
        size += len(chunk)
    return b"".join(held), size <= WHOLE_TREE


def _read(stream, room: list[int]) -> bytes:
    chunk = stream.read(1 << 16)
    room[0] -= len(chunk)
    if room[0] < 0:
        raise ValueError("the archive inflates to more than is allowed")
    return chunk


def _fed(target, data: bytes, stream=None, room: list[int] | None = None):
    """What ``target`` makes of XML: ``data`` and what is left in ``stream``."""
    parser = ET.XMLParser(target=target)
    while data:
        parser.feed(data)
        data = stream and _read(stream, room)
    return parser.close()


def _tree(data: bytes):
    return ET.fromstring(data) if _has_plain_start(data) else _fed(_Plain(), data)


def _member(archive: zipfile.ZipFile, member: str, room: list[int]) -> bytes:
    with archive.open(member) as stream:
        held = []
        while chunk := _read(stream, room):
            held.append(chunk)
    return b"".join(held)


def _pull_document(archive: zipfile.ZipFile, member: str, body: _Body, room: list[int]) -> None:
    """Hand ``body`` the document's blocks: of a small one from its whole tree, of others as they end."""
    with archive.open(member) as stream:
        data, ended = _start(stream, room)
        if ended and _has_plain_start(data):
            body.document(ET.fromstring(data))
        else:
            _fed(_Puller(body), data, stream, room)


_sheets: dict[bytes, tuple] = {}


def _sheet(data: bytes) -> tuple[dict, str | None, list[dict]]:
    """(names by id, the default paragraph style's name, rows) of a style sheet, which nobody may change: they are remembered."""
    if data in _sheets:
        return _sheets[data]
    entries = _tree(data).findall(W + "style")
    shown = {s.get(W + "styleId"): _value(s, "name") for s in entries}
    default = next((_value(s, "name") for s in entries if s.get(W + "default") == "1" and s.get(W + "type") == "paragraph"), None)
    rows = [{"name": _value(s, "name"), "base_name": shown.get(_value(s, "basedOn")), **_paragraph_format(s.find(_PPR)), **_font(s.find(_RPR))} for s in entries]
    if len(data) <= SHEET_BYTES:
        if len(_sheets) >= SHEETS:
            _sheets.clear()
        _sheets[data] = shown, default, rows
    return shown, default, rows


def parse_docx(file, wanted=COLUMNS, most_inflated: int = MOST_INFLATED) -> dict:
    """A row of SCHEMA but for the file name, from bytes or a seekable file; raises for what isn't a Word document.

    Only the columns of ``wanted`` are filled.  All that is read of the archive inflates to
    ``most_inflated`` bytes at most.
    """
    wanted, room = frozenset(wanted), [most_inflated]
    with zipfile.ZipFile(io.BytesIO(file) if isinstance(file, bytes) else file) as archive:
        names = set(archive.namelist())
        if "word/document.xml" not in names:
            raise ValueError("there is no document in the archive")
        sheet = "word/styles.xml" in names and wanted & {"styles", "paragraphs", "runs"}
        shown, default, styles = _sheet(_member(archive, "word/styles.xml", room)) if sheet else ({}, None, [])
        core = _tree(_member(archive, "docProps/core.xml", room)) if "docProps/core.xml" in names and wanted & set(CORE) else None
        body = _Body(shown, default, wanted)
        if wanted & {"paragraphs", "runs", "tables", "sections"}:
            _pull_document(archive, "word/document.xml", body, room)
    found = {k: None if core is None else core.findtext(tag) for k, tag in CORE.items()}
    found |= {"styles": styles, "paragraphs": body.paragraphs, "runs": body.runs, "tables": body.tables, "sections": body.sections}
    return {k: v for k, v in found.items() if k in wanted}


def parse_files(files: DataFrame) -> DataFrame:
    """(doc_id and SCHEMA) of files (doc_id, filename, content), one row for each; a null content isn't parsed."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([files.schema["doc_id"], *StructType.fromDDL(SCHEMA).fields])
    kinds = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            held, load = [], 0
            for doc, name, content in zip(*(batch.column(c) for c in ("doc_id", "filename", "content"))):
                data = content.as_py()
                try:
                    row = {"parse_error": "there is no file"} if data is None else parse_docx(data)
                except Exception as e:  # noqa: BLE001  any file may be malformed in any way
                    row = {"parse_error": f"{type(e).__name__}: {e}"}
                held.append({"doc_id": doc.as_py(), "filename": name.as_py(), **row})
                load += len(data or b"")
                if len(held) >= 64 or load >= 1 << 22:
                    yield pa.RecordBatch.from_pylist(held, schema=kinds)
                    held, load = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=kinds)

    return files.select("doc_id", "filename", "content").mapInArrow(run, schema)


def read_docx(spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS, **options) -> DataFrame:
    """Parsed Word files under ``path``, with ``columns`` of what is in them; other extensions are rows with a parse_error.

    ``doc_id`` is the hash of the whole path: files of one name in two folders are two documents.
    """
    from paperloom.sources.word import WordFiles

    spark.dataSource.register(WordFiles)
    return spark.read.format("docx").schema(word_schema(columns)).options(**options).load(path)


def word_schema(columns: tuple[str, ...] = COLUMNS):
    """The schema of the source ``docx``, with the columns given of those that come from within a file."""
    from pyspark.sql.types import StructType

    every = StructType.fromDDL(WHOLE_SCHEMA)
    return StructType([f for f in every.fields if f.name not in COLUMNS or f.name in columns])


def parsed_docs(files: DataFrame) -> DataFrame:
    """Parsed rows of ``files`` (doc_id, filename, content)."""
    allowed = extension_ok(F.col("filename"))
    read = parse_files(files.withColumn("content", F.when(allowed, F.col("content"))))
    told = F.when(~extension_ok(F.col("filename")), "not a .docx file").otherwise(F.col("parse_error"))
    return read.withColumn("parse_error", told).withColumn("paper_code", paper_code(F.col("filename")))


def table(parsed: DataFrame, name: str) -> DataFrame:
    """One of styles, paragraphs, runs, tables and sections as rows by doc_id."""
    return parsed.select("doc_id", F.explode(name).alias("x")).select("doc_id", "x.*")
