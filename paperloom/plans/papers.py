"""Registered queries over Word files, from bytes to findings, and their SQL.

The files are those of ``fixtures``.  What the checks must find follows from the rows they are made of
by rules written out below, without the checks' code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.operators import scoring
from paperloom.plans import upload
from paperloom.plans.fixtures import BLOCKS, word_files, write_files
from paperloom.sources.docx import parsed_docs, read_docx, table
from paperloom.sources.stage import scratch


def parsed_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return upload.prepared(parsed_docs(word_files(spark.sql(f"SELECT * FROM {BLOCKS}", orders=orders))))


#: Every paragraph of a paper that can be read, with its number: a table is four paragraphs.
_PARAGRAPHS = f"""blocks AS (SELECT * FROM {BLOCKS.replace("{orders}", "orders")} WHERE doc_id % 29 > 0 AND doc_id % 31 > 0),
    placed AS (SELECT *, coalesce(sum(CASE WHEN kind = 'table' THEN 4 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS para_no,
        sum(CASE WHEN kind = 'table' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS tables_so_far, max(n) OVER (PARTITION BY doc_id) AS m FROM blocks),
    good AS (SELECT * FROM placed WHERE doc_id % 23 > 0 AND doc_id % 19 > 0)"""
_PARSE_SQL = f"""WITH {_PARAGRAPHS}
    SELECT doc_id, para_no::BIGINT AS para_no, 'body' AS scope, NULL::INT AS table_no, NULL::INT AS row_no, NULL::INT AS col_no, replace(replace(text, '~', ''), '^', '') AS text, style AS style_name FROM placed WHERE kind <> 'table'
    UNION ALL SELECT doc_id, (para_no + 2 * r + c)::BIGINT, 'cell', tables_so_far::INT, (r + 1)::INT, (c + 1)::INT, 'x', 'Normal' FROM placed, range(2) a(r), range(2) b(c) WHERE kind = 'table'
    UNION ALL SELECT DISTINCT doc_id, max(para_no) OVER (PARTITION BY doc_id)::BIGINT + 1, 'body', NULL::INT, NULL::INT, NULL::INT, '', 'Normal' FROM placed WHERE doc_id % 23 = 0"""


def _case(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'ok' ELSE 'fail' END"


_KNOWN = "style <> 'Normal'"
_FOUND = f"""{_PARAGRAPHS}, single AS (
    SELECT doc_id, 'Document' AS section, 0 AS item_no, 'parsed_ok' AS check_name, 'fail' AS verdict FROM (SELECT DISTINCT o_custkey AS doc_id FROM orders) WHERE doc_id % 29 = 0 OR doc_id % 31 = 0 OR doc_id % 23 = 0 OR doc_id % 19 = 0
    UNION ALL SELECT doc_id, 'Title', para_no, 'style_ok', {_case("style <> 'Normal'")} FROM good WHERE kind = 'title'
    UNION ALL SELECT doc_id, 'Title', para_no, 'title_style_ok', {_case("style <> 'Normal'")} FROM good WHERE kind = 'title'
    UNION ALL SELECT doc_id, 'Title', para_no, 'case_ok', {_case("doc_id % 5 = 0 OR doc_id % 3 > 0")} FROM good WHERE kind = 'title'
    UNION ALL SELECT doc_id, CASE kind WHEN 'authors' THEN 'Authors' ELSE 'Abstract' END, para_no, c, 'ok' FROM good, (VALUES ('style_ok'), ('title_style_ok')) v(c) WHERE kind IN ('authors', 'abstract')
    UNION ALL SELECT DISTINCT doc_id, 'Authors', 0, 'found_ok', {_case("doc_id % 17 > 0")} FROM good
    UNION ALL SELECT doc_id, 'Headings', para_no, 'style_ok', 'ok' FROM good WHERE kind = 'heading'
    UNION ALL SELECT doc_id, 'Paragraphs', para_no, 'style_ok', {_case("style <> 'Normal'")} FROM good WHERE kind = 'body'
    UNION ALL SELECT doc_id, 'Figures', n, c, CASE c WHEN 'used_ok' THEN 'ok' WHEN 'caption_ok' THEN {_case("n % 4 = 1")} ELSE {_case("n % 2 = 1")} END FROM good, (VALUES ('caption_ok'), ('unique_ok'), ('used_ok'), ('found_ok')) v(c) WHERE kind = 'body' AND n > 0
    UNION ALL SELECT doc_id, 'Figures', n, 'style_ok', CASE WHEN style = 'Figure Caption' THEN 'ok' ELSE 'unknown' END FROM good WHERE kind = 'figure'
    UNION ALL SELECT doc_id, 'Tables', n // 2, c, CASE c WHEN 'text_format_ok' THEN {_case("n % 4 = 0")} WHEN 'order_ok' THEN {_case("n % 4 = 0 OR n = 18")} WHEN 'used_ok' THEN {_case("(n // 2) % 3 > 0")} WHEN 'style_ok' THEN CASE WHEN style = 'Table Caption' THEN 'ok' ELSE 'unknown' END END
        FROM good, (VALUES ('text_format_ok'), ('order_ok'), ('used_ok'), ('style_ok')) v(c) WHERE kind = 'title of table'
    UNION ALL SELECT doc_id, 'References', n, c, CASE c WHEN 'used_ok' THEN {_case("n % 6 > 0")} WHEN 'order_ok' THEN {_case("NOT (n > 6 AND n % 6 > 0)")} WHEN 'unique_ok' THEN 'ok' WHEN 'text_ok' THEN {_case("n % 5 > 0 AND n % 2 = 1")} ELSE {_case("(m <= 9 OR n <= 9) AND NOT (n % 5 = 0 AND n % 2 = 1)")} END
        FROM good, (VALUES ('used_ok'), ('order_ok'), ('unique_ok'), ('text_ok'), ('style_ok')) v(c) WHERE kind = 'entry'
    UNION ALL SELECT doc_id, 'Styles', 0, 'style_ok', v FROM (SELECT DISTINCT doc_id FROM good), (SELECT CASE WHEN r < 6 THEN 'ok' ELSE 'fail' END AS v FROM range(14) t(r))
    UNION ALL SELECT doc_id, 'Margins', 0, c, CASE WHEN c = 'columns_ok' OR doc_id % 2 = 0 THEN 'ok' ELSE 'fail' END FROM (SELECT DISTINCT doc_id FROM good), (VALUES ('margins_ok'), ('columns_ok')) v(c)
    UNION ALL SELECT doc_id, 'Parsed Document', para_no + i, 'style_ok', CASE WHEN {_KNOWN} THEN 'ok' ELSE 'unknown' END FROM good, range(4) t(i) WHERE i = 0 OR kind = 'table'),
    found AS (SELECT doc_id, section, item_no, 1 AS items, check_name, verdict FROM single
    UNION ALL SELECT DISTINCT doc_id, 'Figures', CASE g WHEN 0 THEN m + 1 ELSE 3000000000 END, CASE g WHEN 0 THEN 2999999999 - m ELSE 1 END, c, CASE WHEN g = 1 AND c = 'used_ok' THEN 'ok' ELSE 'fail' END
        FROM good, range(2) a(g), (VALUES ('caption_ok'), ('unique_ok'), ('used_ok'), ('found_ok')) v(c) WHERE doc_id % 13 = 0)"""
#: The catalogue knows the title of every other paper, and of every fourth no author more than the paper names.
_KNOWN_FOUND = f"""{_FOUND}, known AS (SELECT doc_id, 'Catalogue' AS section, CASE WHEN i = 4 THEN 0 ELSE i END AS item_no, 1 AS items, CASE i WHEN 0 THEN 'title_ok' WHEN 4 THEN 'authors_ok' ELSE 'author_ok' END AS check_name,
        CASE WHEN i = 0 THEN {_case("doc_id % 2 = 0 AND (doc_id % 3 > 0 OR doc_id % 5 = 0)")} WHEN i = 4 THEN {_case("doc_id % 4 = 1 AND doc_id % 17 > 0")} WHEN doc_id % 17 = 0 OR i = 3 THEN 'fail' WHEN i = 1 THEN 'ok' ELSE 'unknown' END AS verdict
        FROM (SELECT DISTINCT doc_id FROM good WHERE doc_id % 7 > 0), range(5) t(i) WHERE NOT (i = 3 AND doc_id % 4 = 1)),
    every AS (SELECT * FROM found UNION ALL SELECT * FROM known)"""
_SCORES = """counted AS (SELECT doc_id, CASE WHEN grouping(section) = 1 THEN 'total' ELSE section END AS section, coalesce(sum(items) FILTER (verdict = 'ok'), 0)::BIGINT AS positive, coalesce(sum(items) FILTER (verdict = 'unknown'), 0)::BIGINT AS unknown,
    coalesce(sum(items) FILTER (verdict = 'fail'), 0)::BIGINT AS negative FROM every GROUP BY GROUPING SETS ((doc_id, section), (doc_id)))"""


def docx_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers as files in a folder, read by the data source with no more than their paragraphs."""
    folder = scratch(spark, "word-files")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    write_files(word_files(spark.sql(f"SELECT * FROM {BLOCKS}", orders=orders)), folder)
    number = F.regexp_extract("filename", r"\d+", 0).cast("bigint")
    parsed = read_docx(spark, folder, ("paragraphs",)).where("parse_error is null").withColumn("doc_id", number)
    return table(parsed, "paragraphs").select("doc_id", "para_no", "scope", "table_no", "row_no", "col_no", "text", "style_name")


def upload_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upload.upload_check(parsed_papers(spark, sf_dir)).drop("message", "details")


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and authors of the papers, of every seventh without the paper's code."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    title = F.when(F.col("c_custkey") % 2 == 0, "A great  study").otherwise("Another")
    names = F.array(*map(F.lit, ("C. D. Dee", "A. X. Bee", "Z. Zed")))
    code = F.when(F.col("c_custkey") % 7 > 0, F.format_string("P%d", "c_custkey"))
    return customers.select(code.alias("paper_id"), title.alias("title"), F.when(F.col("c_custkey") % 4 == 1, F.slice(names, 1, 2)).otherwise(names).alias("authors"))


def section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parsed_papers(spark, sf_dir)
    return scoring.section_summary(upload.guards(parsed).where("reason is null"), upload.all_findings(parsed, _catalogue(spark, sf_dir)))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores that the stored reports hold, and whether each is found by its own hash."""
    made = upload.report(parsed_papers(spark, sf_dir), _catalogue(spark, sf_dir))
    scores = F.from_json("report", "scores map<string,array<bigint>>")["scores"]
    rows = made.select("doc_id", "filename", (F.concat(F.sha1("report"), F.lit(".json")) == F.col("key")).alias("key_ok"), F.explode(scores).alias("section", "n"))
    return rows.select("doc_id", "filename", "key_ok", "section", *(F.col("n")[i].alias(c) for i, c in enumerate(("positive", "unknown", "negative"))))


def catalogue_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upload.catalogue_check(parsed_papers(spark, sf_dir), _catalogue(spark, sf_dir)).drop("message", "details")


def upload_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the findings say, and what was measured."""
    found = upload.upload_check(parsed_papers(spark, sf_dir)).where("message is not null and section <> 'Styles'")
    return found.select("doc_id", "section", "item_no", "check_name", "message", "details")


def strict_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the reference lists where the style is asked for by name."""
    found = upload.upload_check(parsed_papers(spark, sf_dir), strict=True, only=("References",))
    return found.select("doc_id", "item_no", "check_name", "verdict")


def report_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored reports hold beside scores: metadata, verdicts of sections, and how many findings there are."""
    made = upload.report(parsed_papers(spark, sf_dir), _catalogue(spark, sf_dir))
    held = "metadata struct<author:string,revision:string,version:string,language:string,created:string,modified:string>, sections map<string,string>, summary array<struct<items:bigint>>"
    rows = made.select("doc_id", F.from_json("report", held).alias("r"))
    verdicts = F.array_join(F.array_sort(F.transform(F.map_entries("r.sections"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return rows.select("doc_id", "r.metadata.*", verdicts.alias("verdicts"), F.size("r.summary").cast("bigint").alias("n_findings"))


QUERIES = {f.__name__: f for f in (docx_parse, upload_check, section_summary, report, catalogue_check, upload_messages, strict_references, report_body)}
_CENTRED = '{"alignment":"CENTER","font_size":10.0,"before":3.0,"after":3.0}'
_MESSAGES_SQL = f"""WITH {_PARAGRAPHS},
    found AS (SELECT doc_id, 'Document' AS section, 0 AS item_no, 'parsed_ok' AS check_name, CASE WHEN doc_id % 31 = 0 THEN 'not a .docx file' WHEN doc_id % 29 = 0 THEN 'BadZipFile: File is not a zip file' WHEN doc_id % 23 = 0 THEN 'tracked changes are on' WHEN doc_id % 19 = 0 THEN 'abstract header not found' END AS message, NULL AS details
        FROM (SELECT DISTINCT o_custkey AS doc_id FROM orders)
    UNION ALL SELECT DISTINCT doc_id, 'Authors', 0, 'found_ok', CASE WHEN doc_id % 17 = 0 THEN 'authors not found' END, NULL FROM good
    UNION ALL SELECT doc_id, 'Title', para_no, 'style_ok', CASE WHEN style = 'Normal' THEN 'alignment: None should be CENTER; font_size: 10.0 should be 14.0; after: None should be 3.0; bold: None should be True' ELSE '' END,
        CASE WHEN style = 'Normal' THEN '{{"font_size":10.0}}' ELSE '{{"alignment":"CENTER","font_size":14.0,"before":0.0,"after":3.0,"bold":true}}' END FROM good WHERE kind = 'title'
    UNION ALL SELECT doc_id, CASE kind WHEN 'authors' THEN 'Authors' WHEN 'abstract' THEN 'Abstract' ELSE 'Headings' END, para_no, 'style_ok', '', CASE kind WHEN 'authors' THEN '{{"alignment":"CENTER","font_size":12.0,"before":9.0,"after":12.0}}'
        WHEN 'abstract' THEN '{{"font_size":12.0,"before":0.0,"after":3.0,"italic":true}}' ELSE '{{"alignment":"CENTER","font_size":12.0,"before":9.0,"after":3.0,"bold":true}}' END FROM good WHERE kind IN ('authors', 'abstract', 'heading')
    UNION ALL SELECT doc_id, 'Paragraphs', para_no, 'style_ok', CASE WHEN style = 'Normal' THEN 'alignment: None should be JUSTIFY; first_line: None should be 9.35' ELSE '' END,
        CASE WHEN style = 'Normal' THEN '{{"font_size":10.0}}' ELSE '{{"alignment":"JUSTIFY","font_size":10.0,"before":0.0,"after":0.0,"first_line":9.35}}' END FROM good WHERE kind = 'body'
    UNION ALL SELECT doc_id, 'Figures', n, c, CASE c WHEN 'style_ok' THEN '' ELSE text END, CASE c WHEN 'style_ok' THEN '{_CENTRED}' END FROM good, (VALUES ('caption_ok'), ('unique_ok'), ('used_ok'), ('found_ok'), ('style_ok')) v(c) WHERE kind = 'figure'
    UNION ALL SELECT doc_id, 'Tables', n // 2, c, CASE c WHEN 'order_ok' THEN 'rows: 2, columns: 2, floating: False' WHEN 'style_ok' THEN '' WHEN 'text_format_ok' THEN CASE WHEN n % 4 = 0 THEN '' ELSE 'Does not use "Table N: " format; Has a . at the end of the sentence; Not in Title Case/Initial Caps' END END,
        CASE c WHEN 'style_ok' THEN '{_CENTRED}' END FROM good, (VALUES ('text_format_ok'), ('order_ok'), ('style_ok')) v(c) WHERE kind = 'title of table'
    UNION ALL SELECT doc_id, 'References', n, 'style_ok', concat_ws('; ', CASE WHEN n % 5 = 0 AND n % 2 = 1 THEN 'font_size: 8.0 should be 9.0' END, CASE WHEN m > 9 AND n > 9 THEN 'first_line: -14.75 should be -19.3' END),
        concat('{{"alignment":"JUSTIFY","font_size":', CASE WHEN n % 5 = 0 AND n % 2 = 1 THEN '8.0' ELSE '9.0' END, ',"before":0.0,"after":3.0,"first_line":-14.75}}') FROM good WHERE kind = 'entry'
    UNION ALL SELECT doc_id, 'References', n, 'text_ok', CASE WHEN n % 5 = 0 THEN concat('Number format error should be [', n, '] followed by a tab') WHEN n % 2 = 0 THEN 'URLs and DOIs should be Liberation Mono and size 8pt' ELSE '' END, NULL FROM good WHERE kind = 'entry'
    UNION ALL SELECT DISTINCT doc_id, 'Margins', 0, 'margins_ok', 'A4', NULL FROM good
    UNION ALL SELECT doc_id, 'Parsed Document', para_no + i, 'style_ok', CASE WHEN kind = 'table' THEN concat('Table ', tables_so_far, ':<br/>row ', i // 2 + 1, ', col ', i % 2 + 1) ELSE 'No' END, NULL FROM good, range(4) t(i) WHERE i = 0 OR kind = 'table')
    SELECT doc_id, section, item_no::BIGINT AS item_no, check_name, message, details FROM found WHERE message IS NOT NULL"""
_SUMMARY_SQL = f"""WITH {_KNOWN_FOUND}, folded AS (SELECT doc_id, section, CASE WHEN count(*) FILTER (verdict = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (verdict = 'unknown') > 0 THEN 'unknown' ELSE 'ok' END AS verdict
            FROM every WHERE NOT (section = 'Tables' AND check_name = 'used_ok') AND check_name NOT IN ('title_style_ok', 'author_ok') GROUP BY doc_id, section)
        SELECT d.doc_id, s.section, coalesce(verdict, CASE WHEN s.section = 'References' THEN 'fail' ELSE 'ok' END) AS verdict FROM (SELECT DISTINCT doc_id FROM good) d,
            (VALUES ('Title'), ('Authors'), ('Abstract'), ('Headings'), ('Paragraphs'), ('Figures'), ('Tables'), ('References'), ('Styles'), ('Margins'), ('Parsed Document')) s(section)
        LEFT JOIN folded f ON f.doc_id = d.doc_id AND f.section = s.section
        UNION ALL SELECT doc_id, section, verdict FROM folded WHERE section = 'Catalogue'"""
ORACLE_SQL = {
    "docx_parse": _PARSE_SQL,
    "upload_check": f"WITH {_FOUND} SELECT doc_id, section, item_no::BIGINT AS item_no, items::BIGINT AS items, check_name, verdict FROM found",
    "section_summary": _SUMMARY_SQL,
    "report": f"WITH {_KNOWN_FOUND}, {_SCORES} SELECT doc_id, 'p' || doc_id || CASE WHEN doc_id % 31 = 0 THEN '.pdf' ELSE '.docx' END AS filename, true AS key_ok, section, positive, unknown, negative FROM counted",
    "catalogue_check": f"WITH {_KNOWN_FOUND} SELECT doc_id, section, item_no::BIGINT AS item_no, items::BIGINT AS items, check_name, verdict FROM known",
    "upload_messages": _MESSAGES_SQL,
    "strict_references": f"WITH {_FOUND} SELECT doc_id, item_no::BIGINT AS item_no, check_name, CASE WHEN check_name = 'style_ok' THEN CASE WHEN m > 9 AND item_no <= 9 THEN 'ok' ELSE 'fail' END ELSE verdict END AS verdict FROM found JOIN (SELECT DISTINCT doc_id, m FROM good) USING (doc_id) WHERE section = 'References'",
    "report_body": f"""WITH {_KNOWN_FOUND}, summed AS ({_SUMMARY_SQL}), listed AS (SELECT doc_id, string_agg(section || '=' || verdict, ',' ORDER BY section || '=' || verdict) AS verdicts FROM summed GROUP BY doc_id), counts AS (SELECT doc_id, count(*) AS n_findings FROM every GROUP BY doc_id)
        SELECT doc_id, CASE WHEN says THEN 'A. Bee ' || doc_id END AS author, CASE WHEN says THEN (doc_id % 7)::VARCHAR END AS revision, CASE WHEN says AND doc_id % 2 = 1 THEN '1.2' END AS version, CASE WHEN says THEN 'en-GB' END AS language,
            CASE WHEN says THEN lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || '/01/2024 10:20' END AS created, NULL::VARCHAR AS modified, verdicts, n_findings
        FROM (SELECT *, doc_id % 5 > 0 AND doc_id % 29 > 0 AND doc_id % 31 > 0 AS says FROM counts) LEFT JOIN listed USING (doc_id)""",
}
