"""The registered queries and their SQL.

The driver's tables hold no manuscripts, so inputs are made from their columns by an INPUT in SQL
that both engines run; what is under test is the operator applied to it, against SQL of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.functions import text as T, titlecase
from paperloom.operators import captions, citations, geometry, latex, matching, queue, routing, scoring, spans, styles
from paperloom.plans import papers, upload
from paperloom.sources import landing, reports as report_store
from paperloom.sources.stage import scratch
from paperloom.streaming import claims, queue as stream_queue

TABLES = "region nation customer supplier part orders lineitem events documents".split()
QUERIES: dict = dict(papers.QUERIES)
ORACLE_SQL: dict = dict(papers.ORACLE_SQL)
FLAGSHIP = "bibitem_issues"


#: Line numbers repeat within the driver's orders; here they count an order's lines.
LINEITEM = """(SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS INT) AS l_linenumber FROM {lineitem})"""


def _input(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def _query(*inputs: str, sql: str | None = None):
    """Register a function of the inputs' DataFrames; ``sql`` may use {0}, {1}... for the inputs."""

    inputs = tuple(i.replace("{lineitem}", LINEITEM) for i in inputs)

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(_input(spark, sf_dir, i) for i in inputs))

        QUERIES[f.__name__] = run
        if sql:
            shown = sql
            for n, i in enumerate(inputs):
                shown = shown.replace(f"{{{n}}}", f"({i})")
            for t in TABLES:
                shown = shown.replace(f"{{{t}}}", t)
            ORACLE_SQL[f.__name__] = shown
        return f

    return keep


# --- queue and catalogue

QUEUE = """SELECT o_orderkey AS id, o_custkey AS event_id, o_orderkey % 97 AS contribution_id, o_orderdate AS requested,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS scan_start, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderdate END AS scanned FROM {orders}"""
CONFERENCE = "SELECT c_custkey AS id, c_name AS code, c_nationkey % 2 AS is_published FROM {customer}"
RECENT = "SELECT user_id % 5 AS event_id, event_id % 211 AS contribution_id, ts AS requested FROM {events}"
REFERENCE = "SELECT o_orderkey AS id, concat('P', CAST(o_orderkey % 500 AS STRING)) AS paper_id, o_custkey % 3 AS conference_id, concat(o_orderpriority, ' ', CAST(o_orderkey AS STRING)) AS title FROM {orders}"
AUTHOR_REFERENCE = "SELECT CASE WHEN l_orderkey % 3 > 0 THEN l_orderkey END AS reference_id, l_partkey AS author_id FROM {lineitem}"
AUTHOR = "SELECT p_partkey AS id, CASE WHEN p_size % 10 > 0 THEN p_name END AS name FROM {part}"
NOW = "2024-01-30 00:00:00"


@_query(QUEUE, sql="SELECT * FROM {0} WHERE scanned IS NULL AND scan_start IS NULL ORDER BY requested, id LIMIT 1")
def queue_head(items):
    return queue.head(items)


@_query(CONFERENCE, sql="SELECT id, code FROM {0} WHERE is_published = 0 ORDER BY id DESC")
def unpublished_listing(conferences):
    return queue.unpublished(conferences)


@_query(RECENT, sql=f"SELECT DISTINCT contribution_id FROM {{0}} WHERE event_id = 3 AND requested >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS")
def recent_distinct_24h(items):
    return queue.recently_queued(items, 3, NOW)


@_query(RECENT, sql="SELECT contribution_id FROM {0} WHERE event_id = 2")
def cached_contributions(items):
    return queue.cached_contributions(items, 2)


@_query(
    REFERENCE, AUTHOR_REFERENCE, AUTHOR,
    sql="""SELECT paper_id, conference_id, max_by(title, r.id) AS title, coalesce(string_agg(name, '|' ORDER BY r.id, a.id, name) FILTER (name IS NOT NULL), '') AS authors
        FROM {0} r LEFT JOIN {1} b ON r.id = b.reference_id LEFT JOIN {2} a ON b.author_id = a.id GROUP BY paper_id, conference_id""",
)
def reference_author_lookup(reference, bridge, author):
    return matching.bibliography(reference, bridge, author).withColumn("authors", F.array_join("authors", "|"))


LOG = """SELECT CASE WHEN l_orderkey % 4 > 0 THEN l_orderkey END AS id, CAST(l_shipdate AS TIMESTAMP) + l_linenumber * INTERVAL '1' MINUTE AS at, CASE WHEN l_returnflag = 'R' THEN 'done' ELSE 'claimed' END AS state, CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS failure_reason
    FROM {lineitem}"""


@_query(
    "SELECT o_orderkey AS id FROM {orders}", LOG,
    sql="""SELECT i.id, CASE WHEN state = 'done' THEN 'done' WHEN state = 'claimed' AND l."at" >= TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 60 MINUTES THEN 'claimed' ELSE 'waiting' END AS status, failure_reason
        FROM {0} i LEFT JOIN (SELECT id, max("at") AS "at", arg_max(state, "at") AS state, arg_max(struct_pack(f := failure_reason), "at").f AS failure_reason FROM {1} GROUP BY id) l ON i.id = l.id""",
)
def queue_status(items, log):
    return queue.latest_state(items, log, "1996-01-01 00:00:00")


@_query("SELECT event_id AS id, ts AS modificationTime, event_type FROM {events}", sql=f"SELECT count(*) AS deleted FROM {{0}} WHERE modificationTime < TIMESTAMP '{NOW}' - INTERVAL 5 MINUTES")
def expiry_sweep(objects):
    return queue.expired(objects, NOW).agg(F.count("*").alias("deleted"))


@_query("SELECT p_partkey AS id, p_name AS report FROM {part}", sql="SELECT id, sha1(report) || '.json' AS key, 'This paper has been checked. See the [report](https://x/' || sha1(report) || ').' AS body FROM {0}")
def content_hash(reports):
    key = queue.content_key(F.col("report"))
    return reports.select("id", key.alias("key"), queue.word_comment(key, "https://x/").alias("body"))


@_query(
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'No issues found' ELSE o_orderpriority END AS body FROM {orders}",
    sql="SELECT id, CASE WHEN body <> 'No issues found' THEN concat('The references have been checked:', chr(10), chr(10), body, chr(10), chr(10), '[How references are checked](https://x)') END AS comment FROM {0}",
)
def latex_comment(bodies):
    return bodies.select("id", queue.latex_comment(F.col("body"), "https://x").alias("comment"))


@_query(
    "SELECT p_partkey AS id, concat(p_name, ' ', p_type) AS report FROM {part}",
    sql="SELECT DISTINCT sha1(report) || '.json' AS key, report FROM {0} WHERE id % 7 = 0",
)
def stored_reports(made):
    """Reports put in two batches that overlap, and those of every seventh paper read back by key."""
    path = scratch(made.sparkSession, "reports")
    keyed = made.withColumn("key", queue.content_key(F.col("report")))
    report_store.put(keyed.where("id % 3 < 2"), path)
    report_store.put(keyed.where("id % 3 > 0"), path)
    return report_store.lookup(keyed.where("id % 7 = 0"), path)


CLAIMS = """SELECT l_orderkey AS id, TIMESTAMP '2024-01-01 00:00:00' + (l_linenumber * 25 + l_suppkey % 11) * INTERVAL '1' MINUTE AS at,
    CASE WHEN l_partkey % 5 < 3 THEN 'claim' WHEN l_partkey % 5 = 3 THEN 'done' ELSE 'failed' END AS kind, concat('w', CAST(l_suppkey % 2 AS STRING)) AS worker FROM {lineitem}"""
#: One step for each event of an item, in order; a claim lapses 60 minutes after it, if an event or the end of time comes then.
CLAIM_SQL = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "at") AS i FROM {0}),
    s AS (SELECT id, 0::BIGINT AS i, NULL::TIMESTAMP AS "at", NULL::VARCHAR AS state, NULL::VARCHAR AS worker, NULL::VARCHAR AS owner, NULL::TIMESTAMP AS since, 0 AS attempt, false AS ended, false AS lapsed, NULL::VARCHAR AS gone, NULL::TIMESTAMP AS gone_at, 0 AS gone_attempt FROM (SELECT DISTINCT id FROM e)
        UNION ALL SELECT id, i, "at", state, worker, CASE WHEN state = 'claimed' THEN worker WHEN state IN ('done', 'waiting') OR live IS NULL THEN NULL ELSE live END, CASE WHEN state = 'claimed' THEN "at" ELSE since END,
            attempt + CASE WHEN state = 'claimed' THEN 1 ELSE 0 END, ended OR state = 'done', owner IS NOT NULL AND live IS NULL, owner, since + INTERVAL 60 MINUTES, attempt
        FROM (SELECT *, CASE WHEN kind = 'claim' THEN CASE WHEN live IS NOT NULL OR ended THEN 'refused' ELSE 'claimed' END WHEN live = worker THEN CASE kind WHEN 'done' THEN 'done' ELSE 'waiting' END ELSE 'late' END AS state
            FROM (SELECT e.id, e.i, e."at", e.kind, e.worker, s.owner, s.since, s.attempt, s.ended, CASE WHEN e."at" < s.since + INTERVAL 60 MINUTES THEN s.owner END AS live FROM s JOIN e ON s.id = e.id AND e.i = s.i + 1)))
    SELECT id, "at", state, worker, attempt FROM s WHERE i > 0
    UNION ALL SELECT id, gone_at, 'lapsed', gone, gone_attempt FROM s WHERE lapsed
    UNION ALL SELECT id, since + INTERVAL 60 MINUTES, 'lapsed', owner, attempt FROM s WHERE owner IS NOT NULL AND i = (SELECT max(i) FROM e WHERE e.id = s.id) AND since + INTERVAL 60 MINUTES <= (SELECT max("at") - INTERVAL 10 MINUTES FROM e)"""


@_query(CLAIMS, sql=CLAIM_SQL)
def claim_transitions(events):
    """The events as a stream of files, worked off to its end."""
    spark, folder = events.sparkSession, scratch(events.sparkSession, "claims")
    events.write.parquet(f"{folder}/in")
    return claims.run(spark, spark.readStream.schema(events.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint")


# --- routing

NOTICES = """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'create' WHEN 'view' THEN 'update' WHEN 'purchase' THEN NULL ELSE 'delete' END AS action,
    CASE WHEN event_id % 11 > 0 THEN user_id END AS contrib_id, CASE WHEN event_id % 7 = 0 THEN 'slides' WHEN event_id % 13 > 0 THEN 'paper' END AS editable_type,
    CASE WHEN event_id % 17 > 0 THEN concat('indico-', event_type, '-', CAST(user_id AS STRING)) END AS event, CASE WHEN event_id % 2 = 0 THEN event_id END AS revision_id FROM {events}"""


@_query(
    NOTICES,
    sql="""SELECT id, reason, reason IS NULL OR reason LIKE '%not handled' AS logged, reason IS NULL AS queued, CASE WHEN event IS NOT NULL THEN split_part(event, '-', -1) END AS event_id, coalesce(revision_id, -1) AS revision_id
        FROM (SELECT *, CASE WHEN coalesce(CAST(event AS VARCHAR), CAST(contrib_id AS VARCHAR), action, editable_type, CAST(revision_id AS VARCHAR)) IS NULL THEN 'payload missing' WHEN event IS NULL THEN 'event missing' WHEN contrib_id IS NULL THEN 'contrib_id missing' WHEN action IS NULL THEN 'action missing' WHEN editable_type IS NULL THEN 'editable_type missing'
            WHEN action NOT IN ('create', 'update') THEN 'action not handled' WHEN editable_type <> 'paper' THEN 'editable_type not handled' END AS reason FROM {0})""",
)
def notify_validation(notices):
    return routing.validate(notices).select("id", "reason", "logged", "queued", "event_id", "revision_id")


QUEUED_SQL = """WITH told AS (SELECT *, action IN ('create', 'update') AND editable_type = 'paper' AS good, coalesce(CAST(contrib_id AS VARCHAR), '') <> '' AND event IS NOT NULL AND action IS NOT NULL AND editable_type IS NOT NULL AS whole FROM {0})
    SELECT 'log' AS kept, split_part(event, '-', -1) AS event_id, contrib_id, coalesce(revision_id, -1) AS revision_id FROM told WHERE whole
    UNION ALL SELECT 'queue', split_part(event, '-', -1), contrib_id, coalesce(revision_id, -1) FROM told WHERE whole AND good"""


def _arrived(notices: DataFrame) -> tuple[DataFrame, str]:
    """The notices as a stream of JSON files, and a folder for what comes of it."""
    folder = scratch(notices.sparkSession, "notices")
    notices.drop("id").write.json(f"{folder}/in")
    return stream_queue.notifications(notices.sparkSession, f"{folder}/in"), folder


@_query(NOTICES, sql=QUEUED_SQL)
def notification_queue(notices):
    """The tables that the stream of notices has left."""
    stream, folder = _arrived(notices)
    stream_queue.start(stream, f"{folder}/log", f"{folder}/queue", f"{folder}/checkpoint").awaitTermination()
    read = notices.sparkSession.read
    told = [read.parquet(f"{folder}/{name}").select(F.lit(name).alias("kept"), "event_id", "contrib_id", "revision_id") for name in ("log", "queue")]
    return told[0].unionByName(told[1])


@_query(NOTICES, sql=f"SELECT DISTINCT event_id, contrib_id FROM ({QUEUED_SQL}) WHERE kept = 'queue'")
def guarded_queue(notices):
    """What is queued if a submission may be so once in 24 hours."""
    stream, folder = _arrived(notices)
    for q in stream_queue.start_guarded(stream, f"{folder}/log", f"{folder}/queue", f"{folder}/checkpoint"):
        q.awaitTermination()
    return notices.sparkSession.read.parquet(f"{folder}/queue").select("event_id", "contrib_id")


FILES = """SELECT l_orderkey AS contribution_id, l_suppkey % 9 - 1 AS rev, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN 'a.docx' WHEN 'N' THEN 'b.tex' ELSE 'c.bib' END AS filename,
    CASE l_partkey % 5 WHEN 0 THEN 180 WHEN 1 THEN 31 WHEN 2 THEN 182 WHEN 3 THEN 354 ELSE 99 END AS file_type, l_partkey % 50 AS commenter FROM {lineitem}"""


def _contributions(files: DataFrame) -> DataFrame:
    file = F.struct("filename", F.col("file_type").cast("int").alias("file_type"))
    by_rev = files.groupBy("contribution_id", "rev").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", file.alias("f")))), lambda x: x["f"]).alias("files"),
        F.transform(F.array_sort(F.collect_list(F.struct("n", "commenter"))), lambda x: F.struct(F.struct(x["commenter"].alias("id")).alias("user"))).alias("comments"),
    )
    return by_rev.groupBy("contribution_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rev").alias("id"), "files", "comments"))).alias("revisions")).withColumn("event_id", F.lit(1))


REVISION_SQL = """SELECT contribution_id, max(rev) FILTER (rev > -1) AS latest, CASE WHEN max(CASE WHEN rev = 2 THEN 1 END) = 1 THEN 2 END AS second FROM {0} GROUP BY contribution_id"""


@_query(FILES, sql=REVISION_SQL)
def latest_revision(files):
    c = _contributions(files)
    return c.select("contribution_id", routing.pick_revision(F.col("revisions"), F.lit(-1))["id"].alias("latest"), routing.pick_revision(F.col("revisions"), F.lit(2))["id"].alias("second"))


_HAS = "max(CASE WHEN filename LIKE '%{}' {} THEN 1 ELSE 0 END) = 1"
TYPE_SQL = f"""SELECT contribution_id, rev,
    CASE WHEN {_HAS.format('.docx', '')} THEN 'word' WHEN {_HAS.format('.tex', 'AND file_type IN (180, 31, 352)')} THEN CASE WHEN {_HAS.format('.bib', '')} THEN 'bibtex' ELSE 'latex' END ELSE 'unknown' END AS finder,
    CASE WHEN {_HAS.format('.docx', 'AND file_type IN (180, 31, 352)')} THEN 'word' WHEN {_HAS.format('.tex', 'AND file_type IN (180, 31, 352)')} THEN CASE WHEN {_HAS.format('.bib', 'AND file_type IN (182, 354)')} THEN 'bibtex' ELSE 'latex' END ELSE 'unknown' END AS worker,
    max(CASE WHEN commenter = 7 THEN 1 ELSE 0 END) = 1 AS commented FROM {{0}} GROUP BY contribution_id, rev"""


@_query(FILES, sql=TYPE_SQL)
def paper_type_routing(files):
    each = _contributions(files).select("contribution_id", F.explode("revisions").alias("r"))
    kinds = [routing.paper_type(F.col("r.files"), m).alias(m) for m in ("finder", "worker")]
    return each.select("contribution_id", F.col("r.id").alias("rev"), *kinds, routing.commented_by(F.col("r.comments"), 7).alias("commented"))


@_query(
    FILES,
    sql="""SELECT contribution_id, rev, min_by(filename, n) FILTER (filename = 'a.docx') AS first_docx,
        coalesce(min_by(filename, n) FILTER (filename = 'a.docx' AND file_type IN (180, 31, 352)), min_by(filename, n) FILTER (filename = 'b.tex' AND file_type IN (180, 31, 352))) AS name,
        CAST(coalesce(min_by(file_type, n) FILTER (filename = 'a.docx' AND file_type IN (180, 31, 352)), min_by(file_type, n) FILTER (filename = 'b.tex' AND file_type IN (180, 31, 352))) AS INT) AS type FROM {0} GROUP BY contribution_id, rev""",
)
def paper_file(files):
    each = _contributions(files).select("contribution_id", F.explode("revisions").alias("r"))
    found = routing.paper_file(F.col("r.files"), "worker")
    return each.select("contribution_id", F.col("r.id").alias("rev"), routing.first_docx(F.col("r.files"))["filename"].alias("first_docx"), found["filename"].alias("name"), found["file_type"].alias("type"))


@_query(
    FILES,
    sql="""SELECT contribution_id AS id, count(DISTINCT rev) AS n_revisions, count(*) AS n_files, max(rev) FILTER (rev > -1) AS latest, NULL::VARCHAR AS bad FROM {0} WHERE contribution_id % 10 > 0 GROUP BY contribution_id
        UNION ALL SELECT DISTINCT NULL::BIGINT, 0, 0, NULL::BIGINT, concat('submission ', contribution_id, ' is not to be had') FROM {0} WHERE contribution_id % 10 = 0""",
)
def contributions_json(files):
    """Submissions as JSON lines, every tenth no JSON at all, read back."""
    spark, folder = files.sparkSession, scratch(files.sparkSession, "submissions")
    told = F.to_json(F.struct(F.struct(F.col("contribution_id").alias("id")).alias("contribution"), "revisions"))
    sad = F.concat(F.lit("submission "), F.col("contribution_id").cast("string"), F.lit(" is not to be had"))
    _contributions(files).select(F.when(F.col("contribution_id") % 10 > 0, told).otherwise(sad).alias("value")).write.text(folder)
    read = landing.read_contributions(spark, folder)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    n_files = F.coalesce(F.aggregate("revisions", F.lit(0).cast("bigint"), lambda n, r: n + F.size(r["files"])), F.lit(0))
    latest = routing.latest_revision(F.col("revisions"))["id"]
    return read.select(F.col("contribution.id").alias("id"), F.greatest(size("revisions"), F.lit(0)).alias("n_revisions"), n_files.alias("n_files"), latest.alias("latest"), F.col("_corrupt_record").alias("bad"))


@_query("SELECT o_custkey AS event_id, o_orderkey AS contribution_id FROM {orders}", sql="SELECT event_id, contribution_id FROM {0}")
def paper_list(papers_of):
    """Events' lists of papers, from JSON."""
    bodies = papers_of.groupBy("event_id").agg(F.to_json(F.collect_list(F.struct(F.col("contribution_id").alias("id"), F.lit("A title").alias("title")))).alias("body"))
    return landing.paper_list(bodies)


DISCOVER_SQL = f"""WITH typed AS ({TYPE_SQL}), top AS (SELECT contribution_id, max(rev) FILTER (rev > -1) AS revision_id FROM {{0}} GROUP BY contribution_id)
    SELECT top.contribution_id, revision_id, coalesce(finder, 'unknown') AS type, coalesce(commented, false) AS commented,
        CASE WHEN revision_id IS NULL THEN 'none' WHEN coalesce(finder, 'unknown') NOT IN ('latex', 'word') THEN 'cache' WHEN commented THEN 'none' ELSE 'queue' END AS route
    FROM top LEFT JOIN typed ON top.contribution_id = typed.contribution_id AND revision_id = rev
    WHERE top.contribution_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND top.contribution_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '2%')"""


@_query(FILES, "SELECT 1 AS event_id, o_orderkey AS contribution_id FROM {orders} WHERE o_orderstatus = 'F'", "SELECT 1 AS event_id, o_orderkey AS contribution_id FROM {orders} WHERE o_orderpriority LIKE '2%'", sql=DISCOVER_SQL)
def discover_anti_join(files, queued, cached):
    return routing.discover(_contributions(files), queued, cached, 7).drop("event_id")


FOUND = "SELECT user_id % 50 AS event_id, event_id AS contribution_id, CASE event_type WHEN 'click' THEN 'queue' WHEN 'view' THEN 'cache' ELSE 'none' END AS route FROM {events}"


@_query(FOUND, sql="SELECT event_id, count(*) FILTER (route = 'queue') AS queue_items, count(*) FILTER (route = 'cache') AS cached_items, count(*) FILTER (route = 'none') AS passed_over FROM {0} GROUP BY event_id")
def discovery_counts(found):
    return routing.discovery_counts(found)


@_query(FOUND, sql=f"SELECT event_id, contribution_id, 'unknown' AS paper_type, TIMESTAMP '{NOW}' AS checked FROM {{0}} WHERE route = 'cache'")
def cache_rows(found):
    return routing.cache_rows(found, NOW)


RESULTS = """SELECT o_custkey AS event_id, o_orderkey AS contribution_id, o_orderkey % 9 AS revision_id, CASE o_orderkey % 3 WHEN 0 THEN 'word' WHEN 1 THEN 'latex' ELSE 'none' END AS kind, concat(o_orderpriority, '.json') AS key,
    CASE WHEN o_orderkey % 4 = 0 THEN 'No issues found' ELSE o_orderpriority END AS body FROM {orders}"""


@_query(
    RESULTS,
    sql="""SELECT event_id, contribution_id, revision_id, CASE kind WHEN 'word' THEN 'This paper has been checked. See the [report](https://x/' || replace(key, '.json', '') || ').'
        ELSE concat('The references have been checked:', chr(10), chr(10), body, chr(10), chr(10), '[How references are checked](https://x/)') END AS text FROM {0} WHERE kind = 'word' OR (kind = 'latex' AND body <> 'No issues found')""",
)
def comments_listing(results):
    return queue.comments(results, "https://x/")


@_query(
    "SELECT l_orderkey AS id, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN 'word' WHEN 'N' THEN 'latex' ELSE 'unknown' END AS kind, CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 4 = 1 END AS editor FROM {lineitem}",
    sql="SELECT id, n, CASE WHEN coalesce(editor, false) THEN 'editor revision' WHEN kind IN ('word', 'latex') THEN kind ELSE 'Unknown file type' END AS target FROM {0}",
)
def dispatch_target(items):
    return items.select("id", "n", routing.dispatch(F.col("kind"), F.col("editor")).alias("target"))


# --- titles and authors

_INITIAL = "upper(substr(p_name, 1 + {} % 5, 1))"
OURS = f"""SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS pos, CASE WHEN l_partkey % 7 = 0 THEN concat('X. ', p_brand) WHEN l_partkey % 3 = 0 THEN concat({_INITIAL.format('p_partkey')}, '. Ä', p_name, '*')
    ELSE concat({_INITIAL.format('p_partkey')}, '.', upper(substr(p_name, 2, 1)), '. ', p_name) END AS name FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""
THEIRS = f"""SELECT l_orderkey AS doc_id, CAST(10 - l_linenumber AS BIGINT) AS pos, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN concat({_INITIAL.format('p_partkey')}, '. AE', p_name)
    WHEN l_partkey % 5 = 0 THEN concat({_INITIAL.format('p_partkey')}, '. ', p_name) ELSE concat({_INITIAL.format('p_partkey')}, '. ', upper(substr(p_name, 2, 1)), '. ', p_name) END AS name FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""
_VALUE = "trim(translate(replace(replace(name, '.', '. '), '  ', ' '), '-*†', ''))"
_SURNAME = "CASE WHEN strpos(reverse(value), '.') > 0 THEN right(value, greatest(strpos(reverse(value), '.') - 2, 0)) ELSE substr(value, 2) END"
_LOOSE = f"replace(replace(left(value, 2) || ' ' || ({_SURNAME}), 'Ä', 'AE'), 'ä', 'ae')"
AUTHOR_SQL = f"""
    WITH d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY pos) AS k, {_LOOSE} AS loose FROM (SELECT doc_id, pos, name, {_VALUE} AS value FROM {{0}} WHERE name IS NOT NULL)),
    c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY pos) AS k, {_LOOSE} AS loose FROM (SELECT doc_id, pos, name, {_VALUE} AS value FROM {{1}} WHERE name IS NOT NULL)),
    e AS (SELECT d.doc_id, d.name AS document, c.name AS catalogue, 'ok' AS verdict, 1 AS step, c.pos AS pos FROM d JOIN c ON d.doc_id = c.doc_id AND d.value = c.value AND d.k = c.k),
    l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, loose ORDER BY pos) AS j FROM d WHERE NOT EXISTS (SELECT 1 FROM c WHERE d.doc_id = c.doc_id AND d.value = c.value AND d.k = c.k)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, loose ORDER BY pos) AS j FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = c.doc_id AND d.value = c.value AND d.k = c.k)),
    f AS (SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.name, '') AS document, coalesce(r.name, '') AS catalogue,
            CASE WHEN l.name IS NOT NULL AND r.name IS NOT NULL THEN 'unknown' ELSE 'fail' END AS verdict,
            CASE WHEN l.name IS NOT NULL AND r.name IS NOT NULL THEN 2 WHEN r.name IS NOT NULL THEN 3 ELSE 4 END AS step, coalesce(r.pos, l.pos) AS pos
          FROM l FULL JOIN r ON l.doc_id = r.doc_id AND l.loose = r.loose AND l.j = r.j)
    SELECT doc_id, document, catalogue, verdict, row_number() OVER (PARTITION BY doc_id ORDER BY step, pos) AS ord FROM (SELECT * FROM e UNION ALL SELECT * FROM f)"""


@_query(OURS, THEIRS, sql=AUTHOR_SQL)
def author_match(ours, theirs):
    return matching.match_authors(ours, theirs)


#: Transliterations as the SQL has them, apart from those that Unicode's decomposition gives.
_LONG = {
    "ä": "ae", "Ä": "AE", "æ": "ae", "Æ": "AE", "ö": "oe", "Ö": "OE", "ø": "oe", "Ø": "OE", "ü": "ue", "Ü": "UE", "ß": "SS", "ð": "dh", "Ð": "Dh", "þ": "th", "Þ": "Th",
    "ж": "zh", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "ju", "я": "ja", "Ж": "zh", "Ч": "ch", "Ш": "sh", "Щ": "sch", "Ю": "ju", "Я": "ja",
}
_SHORT = "đd,ĐD,ƒf,Ƒf,ħh,Ħh,łl,Łl,ŧt,Ŧt,µu".replace("Ƒf", "ƑF").replace("Ħh", "ĦH").replace("Łl", "ŁL").replace("Ŧt", "ŦT").split(",") + [
    f"{c}{x}" for small, plain in zip("абвгдезийклмнопрстуфхцыэ", "abvgdezijklmnoprstufhcye") for c, x in ((small, plain), (small.upper(), "E" if small == "е" else plain))
] + ["ёe", "ЁE"]
_TRANSLIT = f"translate(text, '{''.join(x[0] for x in _SHORT)}ъьЪЬ', '{''.join(x[1] for x in _SHORT)}')"
for _k, _v in _LONG.items():
    _TRANSLIT = f"replace({_TRANSLIT}, '{_k}', '{_v}')"
_TRANSLIT = f"strip_accents({_TRANSLIT})"
DOCS = "SELECT doc_id, coalesce(text, '') AS text FROM {documents}"


@_query(DOCS, sql=f"SELECT doc_id, sha1({_TRANSLIT}) AS plain FROM {{0}}")
def transliteration(docs):
    return docs.select("doc_id", F.sha1(T.transliterate(F.col("text"))).alias("plain"))


@_query(DOCS, sql=r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '\p{Lu}')) / nullif(len(regexp_extract_all(text, '\p{L}')), 0) > 0.7, false) AS case_ok FROM {0}")
def title_case_ratio(docs):
    return docs.select("doc_id", T.upper_ratio_ok(F.col("text")).alias("case_ok"))


TITLES = "SELECT p_partkey AS id, concat('**', upper(p_name), ' of ', p_type, '*') AS ours, CASE WHEN p_size % 2 = 0 THEN concat(p_name, '  OF ', p_type) ELSE p_name END AS theirs FROM {part}"


@_query(TITLES, sql=r"SELECT id, CASE WHEN translate(trim(upper(ours), '*'), chr(10) || chr(9) || ' ', '') = translate(regexp_replace(upper(theirs), ' +', ' ', 'g'), chr(10) || chr(9) || ' ', '') THEN 'ok' ELSE 'fail' END AS verdict FROM {0}")
def title_match(titles):
    return titles.select("id", matching.title_verdict(F.col("ours"), F.col("theirs")).alias("verdict"))


AUTHOR_TEXT = """SELECT o_orderkey AS id, concat('A. Bee', CAST(o_orderkey % 9 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN ' and ' ELSE ', ' END, 'J.-L. Vay', chr(10), 'G. D''Alessandro, M.J. de Loos, Ph. Richerot', ', ', o_orderpriority, ', C. Ü', chr(160), 'Élan') AS text FROM {orders}"""


@_query(
    AUTHOR_TEXT,
    sql=r"""SELECT id, coalesce(string_agg(x, '|' ORDER BY n), '') AS names FROM (
        SELECT id, unnest(string_split(replace(replace(replace(text, chr(10), ' , '), chr(160), ' '), ' and ', ', '), ', ')) AS x, generate_subscripts(string_split(replace(replace(replace(text, chr(10), ' , '), chr(160), ' '), ' and ', ', '), ', '), 1) AS n FROM {0})
        WHERE regexp_matches(x, '^(-?[\pL\pN_]\. ?)+([\pL\pN_]{2,} ?)+') GROUP BY id""",
)
def author_tokens(rows):
    return rows.select("id", F.array_join(T.author_names(F.col("text")), "|").alias("names"))


FILENAMES = "SELECT p_partkey AS id, concat(p_brand, CASE p_size % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.v2.DOCX' WHEN 2 THEN '' ELSE '.pdf' END) AS filename FROM {part}"


@_query(FILENAMES, sql=r"SELECT id, contains(filename, '.') AND lower(split_part(filename, '.', -1)) = 'docx' AS allowed, upper(regexp_replace(filename, '\.[^.]*$', '')) AS code FROM {0}")
def file_guard(rows):
    return rows.select("id", T.extension_ok(F.col("filename")).alias("allowed"), T.paper_code(F.col("filename")).alias("code"))


# --- citations

GROUPS = """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS n, CASE l_partkey % 6 WHEN 0 THEN CAST(l_linenumber AS STRING) WHEN 1 THEN concat(CAST(l_linenumber AS STRING), '-', CAST(l_linenumber + 2 AS STRING))
    WHEN 2 THEN concat(CAST(l_linenumber + 1 AS STRING), ', ', CAST(l_linenumber AS STRING)) WHEN 3 THEN CASE WHEN l_suppkey % 3 = 0 THEN ' ' WHEN l_suppkey % 3 = 1 THEN concat(CAST(l_linenumber + 2 AS STRING), '-', CAST(l_linenumber AS STRING)) ELSE concat(CAST(l_linenumber AS STRING), '-', CAST(l_linenumber + 9 AS STRING), '-', CAST(l_suppkey % 2 AS STRING)) END WHEN 4 THEN concat(CAST(l_linenumber AS STRING), ',,', CAST(l_linenumber + 1 AS STRING), '-', CAST(l_linenumber + 1 AS STRING)) ELSE '1 2' END AS g FROM {lineitem}"""
EXPAND_SQL = r"""SELECT doc_id, n, CASE WHEN bool_and(ok) AND (contains(any_value(g), ',') OR trim(any_value(g)) <> '') THEN coalesce(string_agg(ids, ',' ORDER BY i), '') END AS ids FROM (
    SELECT doc_id, n, g, i, regexp_matches(p, '^\s*\d+\s*(-\s*\d+\s*)?(-\s*\d+\s*)?$') AS ok,
        array_to_string(CASE WHEN regexp_matches(p, '^\s*\d+\s*(-\s*\d+\s*)?(-\s*\d+\s*)?$') THEN range(trim(split_part(p, '-', 1))::BIGINT, trim(CASE WHEN contains(p, '-') THEN split_part(p, '-', 2) ELSE p END)::BIGINT + 1,
            CASE WHEN regexp_matches(p, '-.*-') THEN trim(split_part(p, '-', 3))::BIGINT + 2 ELSE 1 END) END, ',') AS ids
    FROM (SELECT doc_id, n, g, unnest(string_split(g, ',')) AS p, generate_subscripts(string_split(g, ','), 1) AS i FROM {0}) WHERE trim(p) <> '' OR NOT contains(g, ','))
    GROUP BY doc_id, n"""


@_query(GROUPS, sql=EXPAND_SQL)
def citation_expand(groups):
    return groups.select("doc_id", "n", F.array_join(citations.expand_group(F.col("g")), ",").alias("ids"))


def _cited(groups: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("n", "ids"))))
    return groups.withColumn("ids", citations.expand_group(F.col("g"))).groupBy("doc_id").agg(F.transform(rows, lambda r: r["ids"]).alias("groups"))


#: One step for each number, each end of a group and each number waiting then; ``i`` is the event, ``todo`` what waits to be looked at.
ORDER_SQL = f"""WITH RECURSIVE g AS (SELECT e.doc_id, e.n, string_split(ids, ',') AS ids FROM ({EXPAND_SQL}) e WHERE ids IS NOT NULL),
    ev AS (SELECT doc_id, list(ref ORDER BY n, j) AS refs FROM (
        SELECT doc_id, n, j, CASE WHEN j <= len(ids) THEN try_cast(ids[j] AS INT) END AS ref, j > len(ids) AS ends FROM (SELECT doc_id, n, ids, unnest(range(1, len(ids) + 2)) AS j FROM g)) WHERE ref IS NOT NULL OR ends GROUP BY doc_id),
    run AS (SELECT d.doc_id, coalesce(refs, []::INT[]) AS refs, 1::BIGINT AS i, false AS ending, 0 AS k, []::INT[] AS seen, []::INT[] AS todo, []::INT[] AS ooo FROM (SELECT DISTINCT doc_id FROM {{0}}) d LEFT JOIN ev ON d.doc_id = ev.doc_id
        UNION ALL SELECT r.doc_id, refs, CASE WHEN ending AND len(todo) > 0 THEN r.i WHEN ending OR refs[i] IS NOT NULL THEN r.i + 1 ELSE r.i END,
            CASE WHEN ending THEN len(todo) > 0 ELSE refs[i] IS NULL END,
            CASE WHEN coalesce(CASE WHEN ending THEN todo[1] ELSE refs[i] END, -1) = k + 1 THEN k + 1 ELSE k END,
            CASE WHEN ending THEN CASE WHEN todo[1] = k + 1 THEN list_filter(seen, lambda x: x <> k + 1) ELSE seen END WHEN refs[i] > k + 1 AND NOT list_contains(seen, refs[i]) THEN list_append(seen, refs[i]) ELSE seen END,
            CASE WHEN ending THEN todo[2:] WHEN refs[i] IS NULL THEN seen ELSE []::INT[] END,
            CASE WHEN ending AND len(todo) = 0 THEN list_concat(ooo, seen) ELSE ooo END
        FROM run r WHERE i <= len(refs)),
    last AS (SELECT doc_id, max_by(ooo, i) AS ooo FROM run GROUP BY doc_id)
    SELECT doc_id, array_to_string(list_sort(list_distinct(ooo)), ',') AS out_of_order FROM last"""


@_query(GROUPS, sql=ORDER_SQL)
def citation_order(groups):
    return _cited(groups).select("doc_id", F.array_join(F.array_sort(citations.out_of_order(F.col("groups"))), ",").alias("out_of_order"))


ITEMS = "SELECT l_orderkey AS doc_id, CAST(l_linenumber * 10 AS BIGINT) AS para_no, CAST(CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE l_linenumber END AS INT) AS id FROM {lineitem}"
PLAIN_GROUPS = "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS n, CASE WHEN l_returnflag <> 'A' THEN CAST(l_linenumber AS STRING) ELSE 'none' END AS g FROM {lineitem}"


@_query(
    ITEMS, PLAIN_GROUPS,
    sql="""SELECT i.doc_id, para_no, id, place, unique_ok, place = id AND NOT (place IN (SELECT n FROM {1} g WHERE g.doc_id = i.doc_id AND g.g <> 'none') AND place > coalesce(k, 0)) AS order_ok, place IN (SELECT n FROM {1} g WHERE g.doc_id = i.doc_id AND g.g <> 'none') AS used_ok,
        count(*) OVER (PARTITION BY i.doc_id) AS total
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_no) AS place, row_number() OVER (PARTITION BY doc_id, id ORDER BY para_no) = 1 AS unique_ok FROM {0}) i
        LEFT JOIN (SELECT doc_id, max(n) FILTER (n = r) AS k FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM {1} WHERE g <> 'none') GROUP BY doc_id) m ON m.doc_id = i.doc_id""",
)
def reference_items(items, groups):
    return citations.check_items(items, _cited(groups))


LISTED = """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS para_no, CASE WHEN l_linenumber = 1 THEN 'Text' WHEN l_linenumber = 2 THEN concat('[1]', chr(9), 'A') WHEN l_partkey % 3 = 0 THEN concat(CAST(l_linenumber - 1 AS STRING), '. B')
    ELSE concat(' [', CAST(l_linenumber - 1 AS STRING), '] C') END AS text FROM {lineitem}"""


#: Paragraphs one after the other: an entry's own number, or the next one within the first four characters once the list is on.
LIST_SQL = r"""WITH RECURSIVE p AS (SELECT doc_id, para_no, row_number() OVER (PARTITION BY doc_id ORDER BY para_no) AS i, TRY_CAST(nullif(regexp_extract(trim(text), '^[[](\d+)[]]', 1), '') AS INT) AS own, left(trim(text), 4) AS head FROM {0}),
    run AS (SELECT doc_id, 0::BIGINT AS i, NULL::BIGINT AS para_no, false AS listed, 0 AS last, NULL::INT AS id, NULL::BOOLEAN AS numbered FROM (SELECT DISTINCT doc_id FROM {0})
        UNION ALL SELECT p.doc_id, p.i, p.para_no, listed OR coalesce(own = 1 AND p.i > 1, false), coalesce(own, CASE WHEN listed AND contains(head, (last + 1)::VARCHAR) THEN last + 1 END, last),
            coalesce(own, CASE WHEN listed AND contains(head, (last + 1)::VARCHAR) THEN last + 1 END), own IS NOT NULL FROM run r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1)
    SELECT doc_id, para_no, id, numbered FROM run WHERE id IS NOT NULL"""


@_query(LISTED, sql=LIST_SQL)
def reference_list(paragraphs):
    return citations.list_items(paragraphs)


# --- captions

FIGURES = """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS seq, CASE l_partkey % 6 WHEN 0 THEN concat('Figure ', CAST(l_linenumber AS STRING), ': A beam.') WHEN 1 THEN concat('Fig. ', CAST(l_linenumber AS STRING), ' shows it')
    WHEN 2 THEN concat('See Fig. ', CAST(l_linenumber + 1 AS STRING), ' and Figure ', CAST(l_linenumber AS STRING), '.') WHEN 3 THEN concat('Figure', CAST(l_linenumber AS STRING), '. Bad') WHEN 4 THEN 'Figure 2: Twice' ELSE 'Nothing' END AS text FROM {lineitem}"""
FIGURE_SQL = r"""
    WITH p AS (SELECT doc_id, seq, trim(text) AS text FROM {0}),
    c AS (SELECT doc_id, seq, text, regexp_extract(text, '^Figure \d+[.:]') AS name FROM p WHERE regexp_matches(text, '^Figure \d+[.:]')),
    w AS (SELECT doc_id, seq, text, regexp_extract(text, '^Fig.\s?\d+|^Figure\s?\d+[.\s]+') AS name FROM p WHERE regexp_matches(text, '^Fig.\s?\d+|^Figure\s?\d+[.\s]+')),
    h AS (SELECT doc_id, seq, text, trim(unnest(regexp_extract_all(text, 'Fig.\s?\d+|Figure\s?\d+[.\s-]+'))) AS name, generate_subscripts(regexp_extract_all(text, 'Fig.\s?\d+|Figure\s?\d+[.\s-]+'), 1) AS n FROM p),
    r AS (SELECT * FROM h WHERE NOT (ends_with(name, '.') AND starts_with(text, name))),
    ids AS (SELECT *, regexp_replace(name, '\D', '', 'g')::INT AS id FROM (SELECT 'c' AS kind, doc_id, seq, 0 AS n, name, text FROM c UNION ALL SELECT 'w', doc_id, seq, 0, name, text FROM w UNION ALL SELECT 'r', doc_id, seq, n, name, text FROM r)),
    every AS (SELECT doc_id, unnest(range(1, max(id) + 1))::INT AS id FROM ids GROUP BY doc_id),
    refs AS (SELECT doc_id, id, string_agg(name, '|' ORDER BY seq, n) AS refs FROM ids WHERE kind = 'r' GROUP BY doc_id, id),
    counts AS (SELECT doc_id, id, count(*) FILTER (kind = 'c') AS nc, count(*) FILTER (kind = 'w') AS nw FROM ids GROUP BY doc_id, id),
    shown AS (SELECT i.doc_id, i.id, name, text FROM ids i JOIN counts k ON i.doc_id = k.doc_id AND i.id = k.id WHERE kind = CASE WHEN nc > 0 THEN 'c' ELSE 'w' END)
    SELECT e.doc_id, e.id, s.name, s.text, coalesce(refs, '') AS refs, refs IS NOT NULL AS used_ok,
        coalesce(CASE WHEN nc > 0 THEN nc = 1 WHEN nw > 0 THEN nw = 1 END, false) AS unique_ok, coalesce(nc + nw > 0, false) AS found_ok, coalesce(nc = 1 AND ends_with(s.name, ':'), false) AS caption_ok
    FROM every e LEFT JOIN counts k ON e.doc_id = k.doc_id AND e.id = k.id LEFT JOIN refs r ON e.doc_id = r.doc_id AND e.id = r.id LEFT JOIN shown s ON e.doc_id = s.doc_id AND e.id = s.id"""


@_query(FIGURES, sql=FIGURE_SQL)
def figure_correlation(paragraphs):
    found = captions.each_number(captions.correlate_figures(captions.figure_marks(paragraphs)))
    return found.withColumn("refs", F.array_join("refs", "|")).withColumn("id", F.col("id").cast("int")).drop("seq")


#: Numbers far apart and beyond an int, with what stands between them left out.
FAR_FIGURES = """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS seq, concat(CASE WHEN l_partkey % 3 = 0 THEN 'Figure ' WHEN l_partkey % 3 = 1 THEN 'Fig. ' ELSE 'See Fig. ' END,
    CAST(CASE WHEN l_suppkey % 5 = 0 THEN CAST(3000000000 AS BIGINT) + l_suppkey WHEN l_suppkey % 5 = 1 THEN 0 ELSE l_linenumber * (l_suppkey % 7) END AS STRING), ': A beam') AS text FROM {lineitem}"""
GAP_SQL = r"""
    WITH m AS (SELECT doc_id, seq, CASE WHEN text LIKE 'Figure %' THEN 'c' WHEN text LIKE 'Fig. %' THEN 'w' ELSE 'r' END AS kind, regexp_extract(text, '\d+')::BIGINT AS id FROM {0}),
    g AS (SELECT doc_id, id, count(*) FILTER (kind = 'c') AS c, count(*) FILTER (kind = 'w') AS w, count(*) FILTER (kind <> 'c') AS r, coalesce(lag(id) OVER (PARTITION BY doc_id ORDER BY id), 0) AS before FROM m WHERE id > 0 GROUP BY doc_id, id)
    SELECT doc_id, id, 1::BIGINT AS numbers, r > 0 AS used_ok, CASE WHEN c > 0 THEN c = 1 ELSE w = 1 END AS unique_ok, c + w > 0 AS found_ok, c = 1 AS caption_ok, unnest(range(CASE WHEN c > 0 THEN c ELSE greatest(w, 1) END)) AS k FROM g
    UNION ALL SELECT doc_id, before + 1, id - before - 1, false, false, false, false, 0 FROM g WHERE id - before > 1"""


@_query(FAR_FIGURES, sql=f"SELECT * EXCLUDE (k) FROM ({GAP_SQL})")
def figure_gaps(paragraphs):
    return captions.correlate_figures(captions.figure_marks(paragraphs)).drop("seq", "name", "text", "refs")


TABLES_TEXT = """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS table_no, CASE l_partkey % 5 WHEN 0 THEN concat('Table ', CAST(l_linenumber AS STRING), ': Beam Data') WHEN 1 THEN concat('Tables ', CAST(l_linenumber AS STRING), ' and 9 and Table', chr(160), '4')
    WHEN 2 THEN 'Table 1: Beam data of the Ring.' WHEN 3 THEN concat('In Table ', CAST(l_linenumber AS STRING), '.') ELSE 'Table 2 Rates' END AS text FROM {lineitem}"""


@_query(
    TABLES_TEXT, "SELECT l_orderkey AS doc_id, CASE l_partkey % 5 WHEN 0 THEN concat('Table ', CAST(l_linenumber AS STRING), ': Beam Data') END AS text FROM {lineitem}",
    sql=r"""SELECT doc_id, w::INT AS id FROM (SELECT doc_id, unnest(string_split(h, ' ')) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(replace(text, chr(160), ' '), 'Table\s?\d+|Tables\s?\d+\sand\s\d+')) AS h FROM {0} p
        WHERE NOT EXISTS (SELECT 1 FROM {1} t WHERE t.doc_id = p.doc_id AND t.text = p.text))) WHERE regexp_matches(w, '^\d+$')""",
)
def table_refs(paragraphs, titles):
    return captions.table_references(paragraphs, titles)


@_query(
    TABLES_TEXT, "SELECT l_orderkey AS doc_id, CAST(l_suppkey % 7 AS INT) AS id FROM {lineitem}",
    sql=r"""SELECT t.doc_id, t.id, t.text, coalesce(u, 0) AS uses, coalesce(u, 0) > 0 AS used_ok, regexp_extract(trim(text), '^Table \d+') = 'Table ' || t.id AS order_ok,
        CASE WHEN NOT regexp_matches(trim(text), '^Table \d+:') THEN 'Does not use "Table N: " format|' ELSE '' END || CASE WHEN regexp_matches(trim(text), '\.$') THEN 'Has a . at the end of the sentence' ELSE '' END AS messages
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY table_no) AS id FROM {0}) t LEFT JOIN (SELECT doc_id, id, count(*) AS u FROM {1} GROUP BY doc_id, id) r ON t.doc_id = r.doc_id AND t.id = r.id""",
)
def table_order(titles, references):
    m = captions.caption_messages(F.col("text"))
    shown = F.concat(F.when(F.array_contains(m, captions.MESSAGES[0]), captions.MESSAGES[0] + "|").otherwise(""), F.when(F.array_contains(m, captions.MESSAGES[1]), captions.MESSAGES[1]).otherwise(""))
    return captions.number_tables(titles, references).select("doc_id", "id", "text", "uses", "used_ok", "order_ok", shown.alias("messages"))


#: What is left of a caption without digits and marks is title case if every word but "of" and "the" within begins with a capital.
CAPTION_SQL = r"""WITH t AS (SELECT *, trim(text) AS c, regexp_replace(regexp_replace(trim(text), '[^a-zA-Z ]', ' ', 'g'), ' +', ' ', 'g') AS plain FROM {0}),
    w AS (SELECT doc_id, table_no, bool_and(word = '' OR regexp_matches(word, '^[A-Z]') OR (i > 1 AND i < last AND word IN ('of', 'the', 'and', 'in'))) AS cased FROM (
        SELECT doc_id, table_no, word, i, max(CASE WHEN word <> '' THEN i END) OVER (PARTITION BY doc_id, table_no) AS last FROM (SELECT doc_id, table_no, unnest(string_split(plain, ' ')) AS word, generate_subscripts(string_split(plain, ' '), 1) AS i FROM t)) GROUP BY doc_id, table_no),
    m AS (SELECT t.*, array_to_string(list_filter([CASE WHEN NOT regexp_matches(c, '^Table \d+:') THEN 'Does not use "Table N: " format' END, CASE WHEN ends_with(c, '.') THEN 'Has a . at the end of the sentence' END, CASE WHEN NOT cased THEN 'Not in Title Case/Initial Caps' END], lambda x: x IS NOT NULL), '|') AS messages
        FROM t JOIN w ON t.doc_id = w.doc_id AND t.table_no = w.table_no)
    SELECT doc_id, table_no, text, messages, messages = '' AS text_format_ok FROM m"""


@_query(TABLES_TEXT, sql=CAPTION_SQL)
def caption_format(titles):
    return captions.caption_format(titles).withColumn("messages", F.array_join("messages", "|"))


CAPTION_LENGTHS = "SELECT p_partkey AS id, repeat('x', CAST(p_size * 2 AS INT)) AS text, p_size % 3 > 0 AS good, p_size % 5 > 0 AS known FROM {part}"


@_query(
    CAPTION_LENGTHS,
    sql="SELECT id, CASE WHEN length(text) > 55 THEN 'table_caption_lines' ELSE 'table_caption_line' END AS rule, CASE WHEN length(text) > 40 AND length(text) < 80 THEN 'unknown' WHEN NOT known THEN 'unknown' WHEN good THEN 'ok' ELSE 'fail' END AS verdict FROM {0}",
)
def caption_routing(rows):
    return rows.select("id", captions.caption_rule(F.col("text"), "table").alias("rule"), captions.caption_style_verdict(F.col("text"), F.col("good"), F.col("known")).alias("verdict"))


@_query("SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS actual FROM {part}", sql="SELECT id, actual > 25 AS gt, actual < 25 AS lt, actual >= 25 AS ge, actual <= 25 AS le, actual = 25 AS eq FROM {0}")
def comparisons(rows):
    return rows.select("id", *(styles.compare(F.col("actual"), op, 25.0).alias(n) for op, n in ((">", "gt"), ("<", "lt"), (">=", "ge"), ("<=", "le"), ("=", "eq"))))


FLOATS = "SELECT l_orderkey AS id, l_linenumber AS n, l_returnflag = 'A' AS anchored, CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_quantity AS INT) END AS y, CASE WHEN l_linestatus = 'F' THEN 'auto' ELSE 'dxa' END AS w FROM {lineitem}"


@_query(FLOATS, sql="SELECT id, n, anchored AND coalesce(y > 11, true) AND w = 'auto' AS floating FROM {0}")
def floating_tables(tables):
    return tables.select("id", "n", captions.is_floating(F.col("anchored"), F.col("y"), F.col("w")).alias("floating"))


# --- LaTeX

_BS = "chr(92)"
def _braced(name: str, inside: str) -> str:
    """SQL for a backslash, a name and braces; braces are spelled by number, since they name inputs here."""
    return f"{_BS}, '{name}', chr(123), '{inside}', chr(125)"


_CITED = f"""concat(CAST(l_linenumber AS STRING), ' 你 A. Author', CASE l_partkey % 4 WHEN 0 THEN ', et al.,' WHEN 1 THEN concat(', ', {_braced("emph", "et al.")}, ',') WHEN 2 THEN ' et al.' ELSE '' END, chr(10), '  in IPAC, ',
    CASE l_suppkey % 6 WHEN 0 THEN 'doi:10.1234/AB-5678' WHEN 1 THEN concat({_braced("url", "doi:10.18429/JACoW")}) WHEN 2 THEN 'doi: 10.5678/9012' WHEN 3 THEN concat({_braced("url", "10.9012/34.")}) WHEN 4 THEN 'https://doi.org/10.1000/X1' ELSE 'none' END,
    CASE WHEN l_partkey % 13 = 0 THEN concat(chr(10), '% note', chr(10)) ELSE chr(10) END)"""
LINES = f"SELECT l_orderkey AS id, CAST(l_linenumber AS INT) AS n, {_CITED} AS body, concat('% made of ', o_orderpriority, chr(10)) AS head FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey"


def _tex(lines: DataFrame) -> DataFrame:
    item = F.concat(F.lit("\\bibitem{k"), F.col("n").cast("string"), F.lit("}"), F.col("body"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("t")))), lambda x: x["t"]), "")
    return lines.groupBy("id").agg(F.concat(F.max("head"), F.lit("\\begin{document}\n"), items, F.lit("\\end{thebibliography}\n\\end{document}\n")).alias("content")).withColumnRenamed("id", "filename")


_NOTE = "contains(body, '%')"
PLACED_SQL = f"""placed AS (SELECT id, n, body, length(max(head) OVER (PARTITION BY id)) + 17
        + coalesce(sum(length(body) + 11 + length(n::VARCHAR)) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 11 + length(n::VARCHAR) AS start FROM {{0}})"""
ITEM_SQL = rf"""WITH {PLACED_SQL}
    SELECT id AS filename, 'k' || n AS name, trim(regexp_replace(body, '\s+', ' ', 'g'), ' ' || chr(10) || chr(9)) AS ref, start::INT AS start, (start + length(body))::INT AS "end",
        coalesce(list_extract(regexp_extract_all(trim(regexp_replace(body, '\s+', ' ', 'g'), ' ' || chr(10) || chr(9)), '10.\d{{4,9}}/[-._;()/:A-Z0-9]+'), -1), '') AS doi FROM placed WHERE NOT {_NOTE}"""


@_query(LINES, sql=ITEM_SQL)
def bibitem_extract(lines):
    checked = latex.check_tex(_tex(lines))
    return checked.select("filename", F.explode("items").alias("i")).select("filename", "i.name", "i.ref", "i.start", "i.end", "i.doi")


def _issue_sql(kind: str, raises: str, excuses: str | None = None) -> str:
    hit = f"regexp_extract(body, '{raises}')"
    extra = f" AND NOT regexp_matches(body, '{excuses}')" if excuses else ""
    return f"SELECT id AS filename, '{kind}' AS type, (start + strpos(body, {hit}) - 1)::INT AS start, (start + strpos(body, {hit}) - 1 + length({hit}))::INT AS \"end\" FROM placed WHERE NOT {_NOTE} AND regexp_matches(body, '{raises}'){extra}"


ISSUE_SQL = f"WITH {PLACED_SQL} " + " UNION ALL ".join((
    _issue_sql("ET_AL_WITH_COMMA", r",\s*(?:\\(?:emph|textit)[{])?et al"), _issue_sql("ET_AL_NOT_WRAPPED", r"et al[.]", r"\\(?:emph|textit)[{]et al[.][}]"), _issue_sql("DOI_CONTAINS_SPACE", r"doi:\s10"),
    _issue_sql("DOI_NOT_WRAPPED", r"doi:10.", r"\\url[{]doi:10[.]"), _issue_sql("NO_DOI_PREFIX", r"\\url[{]10[.]"), _issue_sql("DOI_IS_URL", r"https?://doi.org"),
))


@_query(LINES, sql=ISSUE_SQL)
def bibitem_issues(lines):
    checked = latex.check_tex(_tex(lines))
    return checked.select("filename", F.explode("issues").alias("i")).select("filename", "i.type", "i.start", "i.end")


@_query(LINES, sql=f"SELECT filename, 'issue' AS kind, type AS what, start, \"end\" FROM ({ISSUE_SQL}) UNION ALL SELECT filename, 'item', concat(doi, '|', ref), start, \"end\" FROM ({ITEM_SQL})")
def latex_payload(lines):
    """The reports on LaTeX sources, read back from their JSON."""
    place = "location:struct<start:int,end:int>"
    held = F.from_json("payload", f"issues array<struct<type:string,{place}>>, bibItems array<struct<doi:string,ref:string,{place}>>")
    read = latex.payload(latex.check_tex(_tex(lines))).select("filename", held.alias("r"))
    kinds = (("issue", "issues", F.col("x.type")), ("item", "bibItems", F.concat_ws("|", "x.doi", "x.ref")))
    told = [read.select("filename", F.explode(f"r.{name}").alias("x")).select("filename", F.lit(kind).alias("kind"), what.alias("what"), "x.location.*") for kind, name, what in kinds]
    return told[0].unionByName(told[1])


BREAKS = "SELECT p_partkey AS id, concat(p_name, chr(92), chr(92), CASE WHEN p_size % 3 = 0 THEN concat(' ', chr(92), 'x') ELSE concat(chr(92), chr(92), p_type) END) AS text FROM {part}"


@_query(BREAKS, sql="SELECT id, replace(text, chr(92) || chr(92), '') AS text FROM {0}")
def tex_line_breaks(rows):
    return rows.select("id", T.without_line_breaks(F.col("text")).alias("text"))


DOIS = "SELECT p_partkey AS id, concat('First DOI: 10.1234/', CAST(p_size AS STRING), CASE WHEN p_size % 2 = 0 THEN concat(', last 10.9012/Q', CAST(p_partkey AS STRING), '.') ELSE ' 10.12/no' END) AS text FROM {part}"


@_query(DOIS, sql=r"SELECT id, coalesce(list_extract(regexp_extract_all(text, '10.\d{4,9}/[-._;()/:A-Z0-9]+'), -1), '') AS doi, regexp_replace(coalesce(list_extract(regexp_extract_all(text, '10\.\d{4,9}/[-._;()/:A-Za-z0-9]+'), -1), ''), '[.;:]+$', '') AS clean FROM {0}")
def last_doi(rows):
    return rows.select("id", latex.last_doi(F.col("text")).alias("doi"), latex.last_doi(F.col("text"), compat=False).alias("clean"))


# --- pages and styles

PAGES = """SELECT p_partkey AS doc_id, 0 AS section_no, CAST(CASE p_size % 4 WHEN 0 THEN 7560000 WHEN 1 THEN 7772400 WHEN 2 THEN 7556500 ELSE 7000000 END AS BIGINT) AS page_w, CAST(CASE WHEN p_size % 3 = 0 THEN 10062000 ELSE 10692000 END AS BIGINT) AS page_h,
    CAST(CASE WHEN p_size % 5 = 0 THEN 684000 WHEN p_size % 5 = 1 THEN 685800 ELSE 1332000 END AS BIGINT) AS top, CAST(684000 AS BIGINT) AS bottom, CAST(720000 AS BIGINT) AS left, CAST(CASE WHEN p_size % 7 = 0 THEN 932688 ELSE 720000 END AS BIGINT) AS right,
    CAST(CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS INT) AS cols_num, CAST(CASE WHEN p_size % 2 = 0 THEN 289 ELSE 720 END AS INT) AS cols_space_twips FROM {part}"""
PAGES = PAGES.replace(" AS left,", " AS `left`,").replace(" AS right,", " AS `right`,").replace("`left`", "l_margin").replace("`right`", "r_margin")
_UNIT = "CASE WHEN page_size = 'Letter' THEN round_even({0} / 914400.0, 2) WHEN page_size IN ('A4', 'JACoW') THEN round_even({0} / 36000.0, 0) END"
PAGE_SQL = f"""WITH c AS (SELECT *, CASE WHEN round_even(page_w / 10000.0, 0) = 756 THEN CASE WHEN round_even(page_h / 10000.0, 0) = 1006 THEN 'JACoW' ELSE 'A4' END WHEN round_even(page_w / 10000.0, 0) = 777 THEN 'Letter'
        ELSE round_even(page_w / 36000.0, 0)::INT || ' x ' || round_even(page_h / 36000.0, 0)::INT || ' mm' END AS page_size FROM {{0}}),
    m AS (SELECT *, {_UNIT.format('top')} AS t, {_UNIT.format('bottom')} AS b, {_UNIT.format('l_margin')} AS l, {_UNIT.format('r_margin')} AS r, round_even(cols_space_twips * 635 / 360000.0, 2) AS gutter_cm FROM c)
    SELECT doc_id, page_size, t::DOUBLE AS top_margin, r::DOUBLE AS right_margin, gutter_cm::DOUBLE AS gutter_cm,
        coalesce(CASE page_size WHEN 'A4' THEN t = 37 AND b = 19 AND l = 20 AND r = 20 WHEN 'JACoW' THEN t = 19 AND b = 19 AND l = 20 AND r = 20 WHEN 'Letter' THEN t = 0.75 AND b = 0.75 AND l = 0.79 AND r = 1.02 END, false) AS margins_ok,
        coalesce(cols_num, 1) = 1 OR (cols_num = 2 AND gutter_cm = 0.51) AS columns_ok FROM m"""


@_query(PAGES, sql=PAGE_SQL)
def page_margins(sections):
    checked = geometry.check_sections(sections.withColumnsRenamed({"l_margin": "left", "r_margin": "right"}))
    return checked.select("doc_id", "page_size", "top_margin", "right_margin", "gutter_cm", "margins_ok", "columns_ok")


STYLES = """SELECT CAST(r_regionkey AS BIGINT) AS doc_id, n_name AS name, r_name AS base_name, CASE WHEN n_nationkey % 2 = 0 THEN 'CENTER' END AS alignment, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 38100 END AS BIGINT) AS before_emu, CAST(NULL AS BIGINT) AS after_emu,
    CAST(NULL AS BIGINT) AS first_line_emu, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 187325 END AS BIGINT) AS hanging_emu, CAST(NULL AS BIGINT) AS left_emu, CASE WHEN n_nationkey % 4 = 0 THEN true END AS bold, CAST(NULL AS BOOLEAN) AS italic, CAST(NULL AS BOOLEAN) AS all_caps,
    CAST(CASE WHEN n_nationkey % 4 = 1 THEN 127000 END AS BIGINT) AS size_emu, CAST(NULL AS STRING) AS font_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
    UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name, CAST(NULL AS STRING), 'JUSTIFY', CAST(0 AS BIGINT), CAST(38100 AS BIGINT), CAST(118745 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false, CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN), CAST(114300 AS BIGINT), 'Times' FROM {region}"""
PARAS = """SELECT CAST(n_regionkey AS BIGINT) AS doc_id, c_custkey AS para_no, n_name AS style_name, CASE WHEN c_custkey % 7 = 0 THEN 'LEFT' END AS alignment, CAST(NULL AS BIGINT) AS before_emu, CAST(CASE WHEN c_custkey % 5 = 0 THEN 152400 END AS BIGINT) AS after_emu,
    CAST(CASE WHEN c_custkey % 6 = 0 THEN 0 END AS BIGINT) AS first_line_emu, CAST(NULL AS BIGINT) AS hanging_emu, CAST(NULL AS BIGINT) AS left_emu FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""
RUNS = """SELECT CAST(n_regionkey AS BIGINT) AS doc_id, o_custkey AS para_no, CAST(o_orderkey AS INT) AS run_no, CASE WHEN o_orderkey % 9 = 0 THEN '  ' WHEN o_orderkey % 8 = 0 THEN 'doi:10' ELSE 'run' END AS text, CASE WHEN o_orderkey % 3 = 0 THEN true END AS bold,
    CASE WHEN o_orderkey % 5 = 0 THEN false END AS italic, CAST(NULL AS BOOLEAN) AS all_caps, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 177800 END AS BIGINT) AS size_emu, CAST(NULL AS STRING) AS font_name
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""
RESOLVE_SQL = """
    WITH s AS (SELECT a.doc_id, a.name, coalesce(a.alignment, b.alignment) AS alignment, coalesce(a.before_emu, b.before_emu) AS be, coalesce(a.after_emu, b.after_emu) AS ae, coalesce(a.first_line_emu, b.first_line_emu) AS fe,
            coalesce(a.hanging_emu, b.hanging_emu) AS he, coalesce(a.bold, b.bold) AS bold, coalesce(a.italic, b.italic) AS italic, coalesce(a.size_emu, b.size_emu) AS size, coalesce(a.font_name, b.font_name) AS font
        FROM {1} a LEFT JOIN {1} b ON a.doc_id = b.doc_id AND a.base_name = b.name),
    f AS (SELECT doc_id, para_no, max_by(bold, run_no) FILTER (bold IS NOT NULL) AS bold, max_by(italic, run_no) FILTER (italic IS NOT NULL) AS italic, max_by(size_emu, run_no) FILTER (size_emu IS NOT NULL) AS size
        FROM {2} WHERE trim(text) <> '' AND NOT starts_with(text, 'doi:') GROUP BY doc_id, para_no),
    r AS (SELECT p.doc_id, p.para_no, p.style_name, nullif(coalesce(p.alignment, s.alignment), 'LEFT') AS alignment, coalesce(p.before_emu, be) / 12700 AS before, coalesce(p.after_emu, ae) / 12700 AS after,
            CASE WHEN coalesce(p.first_line_emu, fe, 0) <> 0 THEN coalesce(p.first_line_emu, fe) / 12700 WHEN coalesce(he, 0) <> 0 THEN -he / 12700 ELSE coalesce(p.first_line_emu, fe)::DOUBLE END AS first_line,
            coalesce(f.bold, s.bold) AS bold, coalesce(f.italic, s.italic) AS italic, coalesce(coalesce(f.size, s.size) / 12700, 10.0) AS font_size, coalesce(s.font, 'Times new Roman') AS font_name
        FROM {0} p LEFT JOIN s ON p.doc_id = s.doc_id AND p.style_name = s.name LEFT JOIN f ON p.doc_id = f.doc_id AND p.para_no = f.para_no)
    """


def _resolved(paragraphs, sheet, runs):
    return styles.resolve(paragraphs, sheet, styles.run_fonts(runs, citations.URL_STARTS))


@_query(PARAS, STYLES, RUNS, sql=RESOLVE_SQL + "SELECT doc_id, para_no, alignment, before, after, first_line, bold, italic, font_size, font_name FROM r")
def style_resolution(paragraphs, sheet, runs):
    return _resolved(paragraphs, sheet, runs).select("doc_id", "para_no", "alignment", "before", "after", "first_line", "bold", "italic", "font_size", "font_name")


@_query(
    PARAS, STYLES, RUNS,
    sql=RESOLVE_SQL + """SELECT doc_id, para_no, CASE para_no % 3 WHEN 0 THEN 'body' WHEN 1 THEN 'authors' ELSE 'figure_caption_line' END AS rule,
        coalesce(CASE para_no % 3 WHEN 0 THEN alignment = 'JUSTIFY' ELSE alignment = 'CENTER' END, false) AS alignment_ok,
        coalesce(CASE para_no % 3 WHEN 0 THEN coalesce(after, 0) = 0 WHEN 1 THEN after = 12 ELSE after >= 3 END, false) AS after_ok,
        CASE para_no % 3 WHEN 0 THEN NULL WHEN 1 THEN bold IS NULL OR NOT bold ELSE bold IS NULL END AS bold_ok,
        CASE WHEN para_no % 3 = 0 THEN coalesce(first_line = 9.35, false) END AS first_line_ok FROM r""",
)
def style_rules(paragraphs, sheet, runs):
    rule = F.when(F.col("para_no") % 3 == 0, "body").when(F.col("para_no") % 3 == 1, "authors").otherwise("figure_caption_line")
    checked = styles.check_style(_resolved(paragraphs, sheet, runs).withColumn("rule", rule))
    return checked.select("doc_id", "para_no", "rule", "alignment_ok", "after_ok", "bold_ok", "first_line_ok")


@_query("SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'Heading' WHEN 1 THEN 'Heading 2' WHEN 2 THEN 'Heading 3' ELSE n_name END AS style FROM {nation}", sql="SELECT id, CASE style WHEN 'Heading 2' THEN 'subsection' WHEN 'Heading 3' THEN 'third_level' ELSE 'section' END AS rule FROM {0}")
def heading_guess(rows):
    return rows.select("id", styles.heading_level(F.col("style")).alias("rule"))


EMBEDDED = "SELECT l_orderkey AS doc_id, CASE l_linenumber WHEN 1 THEN 'JACoW_Paper Title' WHEN 2 THEN 'JACoW_Author List' ELSE 'Normal' END AS name FROM {lineitem}"


@_query(EMBEDDED, sql="SELECT d.doc_id, s.style, EXISTS (SELECT 1 FROM {0} e WHERE e.doc_id = d.doc_id AND e.name = s.style) AS style_ok FROM (SELECT DISTINCT doc_id FROM {0}) d, (VALUES " + ", ".join(f"('{s}')" for s in styles.REQUIRED_STYLES) + ") s(style)")
def embedded_styles(sheet):
    return styles.embedded_styles(sheet.select("doc_id").distinct(), sheet)


INVENTORY = """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS para_no, CASE WHEN l_returnflag = 'A' THEN 'cell' ELSE 'body' END AS scope, 1 AS table_no, CAST(l_linenumber AS INT) AS row_no, 2 AS col_no,
    CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE 'text' END AS text, CASE l_suppkey % 4 WHEN 0 THEN 'JACoW_Paper Title' WHEN 1 THEN 'Caption' WHEN 2 THEN 'Normal' ELSE 'Odd Style' END AS style_name FROM {lineitem}"""


@_query(INVENTORY, sql="SELECT doc_id, para_no, style_name, CASE WHEN scope = 'cell' THEN 'Table ' || table_no || ':<br/>row ' || row_no || ', col ' || col_no ELSE 'No' END AS in_table, CASE WHEN style_name IN ('Normal', 'Odd Style') THEN 'unknown' ELSE 'ok' END AS verdict FROM {0} WHERE trim(text) <> ''")
def paragraph_inventory(paragraphs):
    return styles.paragraph_inventory(paragraphs)


@_query(INVENTORY, sql="SELECT doc_id, style_name, count(*) AS count FROM {0} WHERE trim(text) <> '' GROUP BY doc_id, style_name")
def style_histogram(paragraphs):
    return styles.style_histogram(paragraphs)


@_query(
    INVENTORY, EMBEDDED,
    sql="SELECT doc_id, para_no FROM {0} p WHERE trim(text) <> '' AND scope = 'body' AND style_name NOT IN ('Caption', 'Normal') AND NOT EXISTS (SELECT 1 FROM {1} s WHERE s.doc_id = p.doc_id AND s.name = p.style_name AND s.name LIKE 'JACoW%')",
)
def foreign_paragraphs(paragraphs, sheet):
    return styles.foreign_paragraphs(paragraphs, sheet).select("doc_id", "para_no")


RUN_TEXTS = "SELECT l_orderkey AS doc_id, 1 AS para_no, CAST(l_linenumber AS INT) AS run_no, concat(l_shipmode_, 'é') AS text, l_returnflag = 'A' AS all_caps, CASE WHEN l_linestatus = 'F' THEN l_partkey % 2 = 0 END AS superscript FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'air' ELSE 'rail' END AS l_shipmode_ FROM {lineitem})"


@_query(
    RUN_TEXTS,
    sql="SELECT doc_id, para_no, string_agg(CASE WHEN all_caps THEN upper(text) ELSE text END, '' ORDER BY run_no) AS cased, coalesce(string_agg(text, '' ORDER BY run_no) FILTER (NOT coalesce(superscript, false)), '') AS plain FROM {0} GROUP BY doc_id, para_no",
)
def run_texts(runs):
    cased = styles.cased_text(runs).withColumnRenamed("text", "cased")
    return cased.join(styles.without_superscripts(runs).withColumnRenamed("text", "plain"), ["doc_id", "para_no"])


SEGMENTS = """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS para_no, 'body' AS scope, CASE WHEN l_linenumber = 4 THEN ' Abstract ' WHEN l_linenumber = 6 THEN 'REFERENCES' WHEN l_partkey % 6 = 0 THEN ' ' ELSE 'text' END AS text,
    CASE WHEN l_linenumber <= 1 + l_orderkey % 3 THEN 'Title' ELSE 'Other' END AS style_name FROM {lineitem}"""
SEGMENT_SQL = """WITH b AS (SELECT *, lower(trim(text)) AS t, trim(text) <> '' AS shown FROM {0}),
    x AS (SELECT *, min(CASE WHEN t = 'abstract' THEN para_no END) OVER d AS a, min(CASE WHEN shown THEN para_no END) OVER d AS ti,
        last_value(CASE WHEN shown THEN style_name END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b WINDOW d AS (PARTITION BY doc_id)),
    y AS (SELECT *, min(CASE WHEN t = 'references' AND para_no > coalesce(a, -1) THEN para_no END) OVER d AS r, min(CASE WHEN shown AND para_no > ti AND style_name IS DISTINCT FROM prev THEN para_no END) OVER d AS au FROM x WINDOW d AS (PARTITION BY doc_id))
    SELECT doc_id, para_no, CASE WHEN para_no >= coalesce(r, 99) THEN 'references' WHEN para_no > coalesce(a, 99) THEN 'body' WHEN para_no = coalesce(a, 99) THEN 'head'
        WHEN para_no >= ti AND para_no < least(coalesce(au, a, 99), coalesce(a, 99)) THEN 'title' WHEN para_no >= au AND para_no < coalesce(a, 99) THEN 'authors' ELSE 'before' END AS part FROM y"""


@_query(SEGMENTS, sql=SEGMENT_SQL)
def paper_segments(paragraphs):
    return upload.segments(paragraphs).select("doc_id", "para_no", "part")


# --- verdicts

FINDINGS = """SELECT l_orderkey AS doc_id, CASE l_linenumber % 3 WHEN 0 THEN 'Title' WHEN 1 THEN 'Figures' ELSE 'Languages' END AS section, CASE WHEN l_partkey % 7 > 0 THEN CASE l_returnflag WHEN 'A' THEN 'fail' WHEN 'N' THEN 'ok' ELSE 'unknown' END END AS verdict FROM {lineitem}"""


@_query(
    FINDINGS,
    sql="""SELECT doc_id, CASE WHEN grouping(section) = 1 THEN 'total' ELSE section END AS section, count(*) FILTER (verdict = 'ok') AS positive, count(*) FILTER (verdict = 'unknown') AS unknown, count(*) FILTER (verdict = 'fail') AS negative
        FROM {0} WHERE section <> 'Languages' GROUP BY GROUPING SETS ((doc_id, section), (doc_id))""",
)
def verdict_score(findings):
    return scoring.score(findings)


@_query(
    FINDINGS,
    sql="SELECT doc_id, section, CASE WHEN count(*) FILTER (verdict = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (verdict = 'unknown') > 0 THEN 'unknown' ELSE 'ok' END AS verdict FROM {0} GROUP BY doc_id, section",
)
def tri_state_fold(findings):
    return scoring.section_verdicts(findings)


#: Types of parts followed by compounds, names, phrases, initials, addresses and small words, some all in capitals.
TITLES = """SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN upper(t) ELSE t END AS text FROM (SELECT p_partkey, p_size, concat(upper(substr(p_type, 1, 1)), lower(substr(p_type, 2)), CASE p_size % 4 WHEN 0 THEN ' of the ' WHEN 1 THEN ' Of The ' WHEN 2 THEN ' and ' ELSE ' ' END,
    CASE p_partkey % 11 WHEN 0 THEN 'x-ray and step-by-step' WHEN 1 THEN 'To/From the LHC' WHEN 2 THEN concat('O', chr(39), 'Brien: A Study') WHEN 3 THEN concat('D', chr(39), 'arcy for mcDonald') WHEN 4 THEN 'J.R. Smith vs. 3d' WHEN 5 THEN 'A Walk-In' WHEN 6 THEN 'a Walk-in'
        WHEN 7 THEN 'See http://x.y/of. the End' WHEN 8 THEN concat('d', chr(39), 'Arcy via McDonald') WHEN 9 THEN '(Ring) pre-LHC' ELSE 'Ring' END) AS t FROM {part}) titles"""
TITLE_SQL = r"""WITH w AS (SELECT id, text, unnest(string_split(text, ' ')) AS raw, generate_subscripts(string_split(text, ' '), 1) AS i FROM {0}),
    p AS (SELECT id, text, i, CASE WHEN text = upper(text) AND NOT regexp_matches(raw, '^([A-Z]\.)+[A-Z]?$') THEN lower(raw) ELSE raw END AS word, max(i) OVER (PARTITION BY id) AS last, i = 1 OR regexp_matches(lag(raw) OVER (PARTITION BY id ORDER BY i), '[:.;?!-]$') AS opens FROM w),
    s AS (SELECT *, regexp_matches(word, '[A-Za-z]\.[A-Za-z]|.//') AS shaped FROM p),
    l AS (SELECT *, CASE WHEN shaped THEN [word] ELSE regexp_extract_all(word, '[^/-]*[/-]|[^/-]+') END AS parts FROM s),
    e AS (SELECT * EXCLUDE (parts), unnest(parts) AS part, generate_subscripts(parts, 1) AS j, len(parts) AS n FROM l),
    c AS (SELECT id, text, i, j, CASE WHEN shaped THEN part
        WHEN lower(rtrim(part, '-/')) IN ('a', 'and', 'by', 'for', 'of', 'the', 'to', 'via', 'vs.', 'in') AND NOT ((opens AND j = 1) OR (i = last AND j = n)) THEN lower(part)
        WHEN regexp_matches(substr(part, 2), '[A-Z]') THEN part
        WHEN part[2] = chr(39) AND lower(part[1]) = 'd' THEN 'd' || chr(39) || upper(part[3]) || substr(part, 4) WHEN part[2] = chr(39) AND lower(part[1]) = 'o' THEN 'O' || chr(39) || upper(part[3]) || substr(part, 4)
        WHEN lower(part[1:2]) = 'mc' THEN 'Mc' || upper(part[3]) || substr(part, 4) WHEN part[1] = '(' THEN '(' || upper(part[2]) || substr(part, 3) ELSE upper(part[1]) || substr(part, 2) END AS cased FROM e),
    j AS (SELECT id, text, i, string_agg(cased, '' ORDER BY j) AS cased FROM c GROUP BY id, text, i), t AS (SELECT id, text, string_agg(cased, ' ' ORDER BY i) AS shown FROM j GROUP BY id, text)
    SELECT id, shown, shown = text AS title_case FROM t"""


@_query(TITLES, sql=TITLE_SQL)
def title_case(rows):
    return rows.select("id", titlecase.title_case(F.col("text")).alias("shown"), titlecase.is_title_case(F.col("text")).alias("title_case"))


# --- spans

SPANS = """SELECT CAST(l_suppkey % 100 AS BIGINT) AS doc_id, l_orderkey AS id, l_linenumber AS n, CAST((l_orderkey * 3701 + l_linenumber * 17) % 2000000 AS BIGINT) AS start,
    CAST((l_orderkey * 3701 + l_linenumber * 17) % 2000000 + l_quantity * 200 AS BIGINT) AS stop FROM {lineitem}"""
MARKS = "SELECT CAST(o_custkey % 100 AS BIGINT) AS doc_id, CAST((o_orderkey * 5303) % 2000000 AS BIGINT) AS start, CAST((o_orderkey * 5303) % 2000000 + o_orderkey % 1500 AS BIGINT) AS stop FROM {orders}"


@_query(
    SPANS, MARKS,
    sql="""SELECT s.doc_id, s.id, s.n, s.start, s.stop, EXISTS (FROM {1} m WHERE m.doc_id = s.doc_id AND m.start >= s.start AND m.stop <= s.stop) AS holds, EXISTS (FROM {1} m WHERE m.doc_id = s.doc_id AND m.start <= s.start AND m.stop > s.start) AS inside FROM {0} s""",
)
def span_containment(items, marks):
    items, marks = (x.withColumnRenamed("stop", "end") for x in (items, marks))
    return spans.starts_inside(spans.holds_any(items, marks), marks).withColumnRenamed("end", "stop")


@_query(
    SPANS, MARKS,
    sql="SELECT s.doc_id, s.start, s.stop, m.start AS mark_start, m.stop AS mark_stop FROM {0} s JOIN {1} m ON m.doc_id = s.doc_id AND m.start >= s.start AND m.stop <= s.stop",
)
def span_pairs(items, marks):
    items, marks = (x.withColumnRenamed("stop", "end") for x in (items, marks))
    return spans.pairs(items, marks).withColumnsRenamed({"end": "stop", "mark_end": "mark_stop"})
