"""Papers made of the driver's tables, which hold no manuscripts.

Each customer becomes a paper and each of its orders a paragraph, a figure, a table and a list entry
of it.  ``BLOCKS`` is that paper as rows, in SQL that both engines run; ``word_files`` makes the file
of it, and ``write_files`` puts the files in a folder.
"""

from __future__ import annotations

import io
import zipfile
from functools import cache

from pyspark.sql import DataFrame, functions as F

#: In a text, ``~`` begins a second run, which has the properties of ``rpr``, and ``^`` begins and ends a superscript.
BLOCKS = """(WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS n FROM {orders}),
    d AS (SELECT DISTINCT doc_id FROM o)
    SELECT doc_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS k, 'title' AS kind, CASE WHEN doc_id % 4 = 0 THEN 'Normal' ELSE 'JACoW_Paper Title' END AS style,
        CASE WHEN doc_id % 5 = 0 THEN 'A great study' WHEN doc_id % 3 = 0 THEN 'A small STUDY' ELSE 'A GREAT STUDY' END AS text, CASE WHEN doc_id % 5 = 0 THEN '<w:caps/>' ELSE '' END AS rpr FROM d
    UNION ALL SELECT doc_id, 1, 0, 0, 'authors', 'JACoW_Author List', 'A. Bee^*^, C.D. Dee', '' FROM d WHERE doc_id % 17 > 0
    UNION ALL SELECT doc_id, 2, 0, 0, 'abstract', 'JACoW_Abstract_Heading', CASE WHEN doc_id % 19 = 0 THEN 'Summary' ELSE 'Abstract' END, '' FROM d
    UNION ALL SELECT doc_id, 3, 0, 0, 'body', 'JACoW_Body Text Indent', 'This abstract is long enough to count as a paragraph of the body.', '' FROM d
    UNION ALL SELECT doc_id, 10 * n, n, k, 'body', CASE WHEN k % 7 = 0 THEN 'Normal' ELSE 'JACoW_Body Text Indent' END, concat('Study ', CAST(n AS STRING), ' of the storage ring looks at Fig. ', CAST(n AS STRING), CASE WHEN n = 1 AND doc_id % 13 = 0 THEN ' and Figure 3000000000 ' ELSE '' END,
        CASE WHEN n % 3 = 0 THEN '' ELSE concat(' and Table ', CAST(n AS STRING)) END, ' and cites [', CAST(CASE WHEN n % 6 = 0 THEN 1 ELSE n END AS STRING), '] in passing.'), '' FROM o
    UNION ALL SELECT doc_id, 10 * n + 1, n, k, 'figure', CASE WHEN k % 5 = 0 THEN 'Table Caption' ELSE 'Figure Caption' END, concat(CASE WHEN n % 8 = 7 THEN 'Fig. ' ELSE 'Figure ' END, CAST(n AS STRING), CASE WHEN n % 8 = 7 THEN '' WHEN n % 4 = 3 THEN '.' ELSE ':' END, ' A beam'), '' FROM o WHERE n % 2 = 1
    UNION ALL SELECT doc_id, 10 * n + 2, n, k, 'title of table', CASE WHEN n % 8 = 0 THEN 'Figure Caption' ELSE 'Table Caption' END, CASE WHEN n % 4 = 0 THEN concat('Table ', CAST(CAST(n / 2 AS BIGINT) AS STRING), ': Beam Data') ELSE 'Table 9 rates.' END, '' FROM o WHERE n % 2 = 0
    UNION ALL SELECT doc_id, 10 * n + 3, n, k, 'table', 'Normal', 'x', '' FROM o WHERE n % 2 = 0
    UNION ALL SELECT doc_id, 10 * n + 4, n, k, 'heading', 'JACoW_Section Heading', 'RESULTS', '' FROM o WHERE n % 3 = 0
    UNION ALL SELECT doc_id, 1000000, 0, 0, 'references', 'Normal', 'REFERENCES', '' FROM d
    UNION ALL SELECT doc_id, 1000000 + n, n, k, 'entry', 'JACoW_Reference #1-9 when >= 10 Refs', CASE WHEN n % 5 = 0 THEN concat('[', CAST(n AS STRING), '] A paper') ELSE concat('[', CAST(n AS STRING), ']', chr(9), 'A paper, ~doi:10.1/x') END,
        CASE WHEN n % 2 = 1 THEN '<w:rFonts w:ascii="Liberation Mono"/><w:sz w:val="16"/>' ELSE '' END FROM o)"""

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
#: The formats that the rules ask for, by style: alignment, space before and after and indent in twips, run properties.
_SHEET = {
    "JACoW_Paper Title": ("center", 0, 60, "", '<w:b/><w:sz w:val="28"/>'),
    "JACoW_Author List": ("center", 180, 240, "", '<w:sz w:val="24"/>'),
    "JACoW_Abstract_Heading": ("", 0, 60, "", '<w:i/><w:sz w:val="24"/>'),
    "JACoW_Section Heading": ("center", 180, 60, "", '<w:b/><w:sz w:val="24"/>'),
    "JACoW_Body Text Indent": ("both", 0, 0, 'w:firstLine="187"', '<w:sz w:val="20"/>'),
    "Figure Caption": ("center", 60, 60, "", '<w:sz w:val="20"/>'),
    "Table Caption": ("center", 60, 60, "", '<w:sz w:val="20"/>'),
    "JACoW_Reference #1-9 when >= 10 Refs": ("both", 0, 60, 'w:hanging="295"', '<w:sz w:val="18"/>'),
}


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


@cache
def _grid() -> str:
    cell = f"<w:tc>{_paragraph('Normal', 'x', '')}</w:tc>"
    return f"<w:tbl><w:tblPr/><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid>{2 * f'<w:tr>{cell}{cell}</w:tr>'}</w:tbl>"


def _paragraph(style: str, text: str, rpr: str) -> str:
    def run(piece: str, props: str) -> str:
        body = "<w:tab/>".join(f'<w:t xml:space="preserve">{_escape(x)}</w:t>' for x in piece.split("\t"))
        return f"<w:r>{props and f'<w:rPr>{props}</w:rPr>'}{body}</w:r>"

    runs = []
    for n, part in enumerate(text.split("~")):
        for m, piece in enumerate(part.split("^")):
            runs.append(run(piece, '<w:vertAlign w:val="superscript"/>' if m % 2 else rpr if n or "~" not in text else ""))
    return f'<w:p><w:pPr><w:pStyle w:val="{_escape(style)}"/></w:pPr>{"".join(runs)}</w:p>'


@cache
def _styles() -> str:
    made = [f'<w:styles {_NS}><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>']
    for name, (align, before, after, indent, rpr) in _SHEET.items():
        ppr = (align and f'<w:jc w:val="{align}"/>') + f'<w:spacing w:before="{before}" w:after="{after}"/>' + (indent and f"<w:ind {indent}/>")
        made.append(f'<w:style w:type="paragraph" w:styleId="{_escape(name)}"><w:name w:val="{_escape(name)}"/><w:pPr>{ppr}</w:pPr><w:rPr>{rpr}</w:rPr></w:style>')
    return "".join(made) + "</w:styles>"


def _core(doc_id: int) -> str:
    """What a file says of itself."""
    said = {"dc:creator": f"A. Bee {doc_id}", "dc:language": "en-GB", "cp:revision": doc_id % 7, "dcterms:created": f"2024-01-{1 + doc_id % 28:02d}T10:20:30Z"} | ({"cp:version": "1.2"} if doc_id % 2 else {})
    spaces = 'xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/"'
    return f"<cp:coreProperties {spaces}>{''.join(f'<{k}>{v}</{k}>' for k, v in said.items())}</cp:coreProperties>"


def word_file(doc_id: int, blocks) -> bytes:
    """The .docx of a paper's (style, text, rpr, kind) in order; every 29th isn't one, every 23rd has an insertion, every fifth says nothing of itself."""
    if doc_id % 29 == 0:
        return b"not a file"
    grid = _grid()
    body = "".join(grid if kind == "table" else _paragraph(style, text, rpr) for style, text, rpr, kind in blocks)
    tracked = "<w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p>" if doc_id % 23 == 0 else ""
    page = f'<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="{1077 if doc_id % 2 else 2098}" w:bottom="1077" w:left="1134" w:right="1134"/></w:sectPr>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}{tracked}{page}</w:body></w:document>")
        archive.writestr("word/styles.xml", _styles())
        if doc_id % 5:
            archive.writestr("docProps/core.xml", _core(doc_id))
    return out.getvalue()


#: Papers that a worker holds as Python objects at a time.
AT_ONCE = 64


def _few(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def word_files(blocks: DataFrame) -> DataFrame:
    """(doc_id, filename, content) of BLOCKS' rows."""
    lines = F.array_sort(F.collect_list(F.struct("pos", "style", "text", "rpr", "kind")))
    spark = blocks.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    papers = blocks.repartition(tasks, "doc_id").groupBy("doc_id").agg(lines.alias("lines"))

    def run(batches):
        import pyarrow as pa

        for batch in _few(batches):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lines"))))
            made = [word_file(doc, [(x["style"], x["text"], x["rpr"], x["kind"]) for x in lines]) for doc, lines in rows]
            names = [f"p{doc}.{'pdf' if doc % 31 == 0 else 'docx'}" for doc, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(made, pa.binary())], names=["doc_id", "filename", "content"])

    return papers.mapInArrow(run, "doc_id bigint, filename string, content binary")


def write_files(files: DataFrame, folder: str) -> int:
    """Put each file of ``word_files`` in ``folder``, under its name; how many.  A task's retry writes the same again."""
    from paperloom.sources.word import file_system

    def run(batches):
        import pyarrow as pa

        to, path, _ = file_system(folder)
        to.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("filename").to_pylist(), batch.column("content")):
                with to.open_output_stream(f"{path}/{name}") as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("filename", "content").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
