"""Registered queries of the queue and of the drivers: what they leave in tables that change together."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import claims, drivers
from ..session import shared_folder
from ..sources.commits import Commits
from ..sources.readers import table
from .catalog import _cut_sql, _entities_sql, query
from .views import JOBS_SQL, jobs

_NOW, _LEASE = dt.datetime(2024, 1, 30, 12, 0), dt.timedelta(minutes=10)


def _store(spark) -> Commits:
    return Commits(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


@query(f"""WITH {JOBS_SQL}, q AS (SELECT job_id, kind, row_number() OVER (ORDER BY created_at, job_id) AS n FROM jobs WHERE status = 'queued'),
f AS (SELECT *, n <= 100 AS a, n > 100 AND n <= 250 AS b FROM q), s AS (SELECT *, CASE WHEN b THEN CASE job_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' ELSE 'queued' END END AS settled FROM f),
c AS (SELECT *, (a OR NOT b OR settled = 'queued') AS free FROM s), d AS (SELECT *, free AND count(*) FILTER (free) OVER (ORDER BY n) <= 300 AS c FROM c)
SELECT job_id, kind, CASE WHEN c THEN 'running' WHEN a THEN 'running' WHEN b THEN settled ELSE 'queued' END AS status, CAST(CAST(a OR b AS INT) + CAST(c AS INT) AS INT) AS attempts,
CASE WHEN c THEN 'c' WHEN a THEN 'a' WHEN b AND settled <> 'queued' THEN 'b' END AS claimer, CASE WHEN NOT c AND settled = 'failed' THEN 'bad' END AS error FROM d""")
def claimed_jobs(spark, folder):
    """Every waiting job after three workers: one whose leases run out, one that settles what it holds, one that comes later."""
    log = _store(spark)
    waiting = jobs(spark, folder).filter("status = 'queued'").select("job_id", "kind", "payload", F.col("created_at").cast("timestamp").alias("created_at"))
    claims.submit(log, waiting)
    claims.claim(log, "a", 100, _NOW, _LEASE)
    held = claims.claim(log, "b", 150, _NOW, _LEASE)
    k = F.col("job_id") % 3
    claims.settle(log, "b", held.select("job_id", F.when(k == 0, "complete").when(k == 1, "failed").otherwise("queued").alias("status"), F.when(k == 1, "bad").alias("error")))
    claims.settle(log, "a", held.select("job_id", F.lit("complete").alias("status"), F.lit(None).cast("string").alias("error")))  # not a's jobs
    claims.claim(log, "c", 300, _NOW + _LEASE, _LEASE)
    return claims.current(log).select("job_id", "kind", "status", "attempts", "claimer", "error")


_BODY_SQL = f"array_to_string(list_filter(list_transform(string_split({_cut_sql('html')}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"


@query(f"""WITH RECURSIVE t AS (SELECT page_id, html FROM pages),
l AS (SELECT p.page_id AS job_id, 'https://x.org/' || (p.page_id // 2) AS url, coalesce(h.html, p.html) AS html FROM pages p LEFT JOIN t h ON p.page_id % 5 = 4 AND h.page_id = p.page_id - 3),
b AS (SELECT job_id, CASE WHEN job_id % 11 = 3 THEN NULL ELSE url END AS url, trim({_entities_sql("regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)")}) AS title, {_BODY_SQL} AS body FROM l),
j AS (SELECT *, CASE WHEN url IS NULL THEN 'no address of a page' WHEN length(trim(body)) < 200 THEN 'no text worth reading' END AS error FROM b),
g AS MATERIALIZED (SELECT row_number() OVER (ORDER BY job_id) AS n, job_id, url, sha256(body) AS hash FROM j WHERE error IS NULL),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS job_id, CAST(NULL AS VARCHAR) AS url, false AS new, CAST([] AS VARCHAR[]) AS urls, CAST([] AS VARCHAR[]) AS hashes, CAST([] AS VARCHAR[]) AS first, CAST(NULL AS VARCHAR) AS stands
  UNION ALL SELECT g.n, g.job_id, g.url, NOT (list_contains(urls, g.url) OR list_contains(hashes, g.hash)), CASE WHEN list_contains(urls, g.url) OR list_contains(hashes, g.hash) THEN urls ELSE urls || [g.url] END, CASE WHEN list_contains(urls, g.url) OR list_contains(hashes, g.hash) THEN hashes ELSE hashes || [g.hash] END, first,
  CASE WHEN list_contains(urls, g.url) THEN g.url WHEN list_contains(hashes, g.hash) THEN urls[list_position(hashes, g.hash)] ELSE g.url END FROM r JOIN g ON g.n = r.n + 1)
SELECT job_id, CASE WHEN new THEN 'inserted' ELSE 'existing' END AS action, stands AS address, CAST(NULL AS VARCHAR) AS error FROM r WHERE n > 0
UNION ALL SELECT job_id, 'failed', NULL, error FROM j WHERE error IS NOT NULL""")
def articles_taken_in(spark, folder):
    """All pages as fetched articles, by a job each: pairs share an address, some pages a text, some have no address. The
    address is that of the document which stands for the job."""
    pages = table(spark, folder, "pages")
    other = pages.select((F.col("page_id") + 3).alias("page_id"), F.col("html").alias("other")).filter("page_id % 5 = 4")
    address = F.concat(F.lit(" https://x.org/"), F.floor(F.col("page_id") / 2).cast("string"), F.lit("#"), F.col("page_id").cast("string"))
    landed = pages.join(other, "page_id", "left").select(F.col("page_id").alias("job_id"), F.when(F.col("page_id") % 11 != 3, address).alias("url"), F.coalesce("other", "html").alias("html"))
    log = _store(spark)
    found = drivers.articles(log, landed, lambda c: F.array(F.length(c).cast("float")))
    address = log.frame("documents", drivers.DOCUMENTS).select("document_id", F.col("source_id").alias("address"))
    return found.join(address, "document_id", "left").select("job_id", "action", "address", "error")


@query("""WITH p AS (SELECT p_partkey AS job_id, '/a/' || p_brand || ' - ' || p_name || ' ' || p_type AS path, p_brand AS author, p_name || ' ' || p_type AS title FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY job_id) = 1 AS new FROM p)
SELECT job_id, CASE WHEN job_id % 7 = 3 THEN 'skipped' WHEN new THEN 'inserted' ELSE 'skipped' END AS action, CASE WHEN new THEN title END AS title, CASE WHEN new THEN author END AS author, CAST(new AND job_id % 7 <> 3 AS BIGINT) AS jobs FROM
(SELECT * EXCLUDE new, job_id % 7 <> 3 AND row_number() OVER (PARTITION BY path, job_id % 7 = 3 ORDER BY job_id) = 1 AS new FROM f)""")
def audiobooks_taken_in(spark, folder):
    """Folders of audiobooks, some of them empty, some named alike: documents, entries and jobs of one commit."""
    part = table(spark, folder, "part")
    path = F.concat(F.lit("/a/"), "p_brand", F.lit(" - "), "p_name", F.lit(" "), "p_type")
    none = F.lit(None).cast("string")
    landed = part.select(F.col("p_partkey").alias("job_id"), path.alias("path"), none.alias("title"), none.alias("author"), none.alias("narrator"), F.when(F.col("p_partkey") % 7 == 3, 0).otherwise(2).alias("n_files"))
    log = _store(spark)
    found = drivers.audiobooks(log, landed)
    books = log.frame("documents", drivers.DOCUMENTS).filter("content_type = 'audiobook'").select("document_id", "title", "author")
    asked = log.frame("jobs", drivers.JOBS).groupBy(F.get_json_object("payload", "$.document_id").alias("document_id")).agg(F.count("*").alias("jobs"))
    own = F.col("action") == "inserted"
    met = found.join(books, "document_id", "left").join(asked, "document_id", "left")
    return met.select("job_id", "action", F.when(own, F.col("title")).alias("title"), F.when(own, F.col("author")).alias("author"), F.when(own, F.col("jobs")).otherwise(0).alias("jobs"))


# Posts, journals, commemorations, notebooks


def _hash_embed(c):
    return F.array(F.length(c).cast("float"))


@query("""WITH p AS (SELECT 'at://' || source || '/' || doc_id % 700 AS uri, source AS author, text, doc_id AS seen, doc_id % 10 = 3 OR trim(coalesce(text, '')) = '' AS skips FROM documents),
o AS (SELECT uri, arg_min(text, seen) AS text, min(seen) AS seen FROM p WHERE NOT skips GROUP BY uri), w AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY seen, uri) = 1 AS new FROM o)
SELECT uri AS source_id, CASE WHEN new THEN 'inserted' ELSE 'existing' END AS action, CASE WHEN new THEN substr(text, 1, 80) END AS title FROM w UNION ALL SELECT DISTINCT uri, 'skipped', CAST(NULL AS VARCHAR) FROM p WHERE skips""")
def posts_taken_in(spark, folder):
    """All documents as posts: some share an address or a text, some are reposts."""
    d = table(spark, folder, "documents")
    found = d.select(F.concat(F.lit("at://"), "source", F.lit("/"), (F.col("doc_id") % 700).cast("string")).alias("uri"), F.col("source").alias("author"), "text", F.col("doc_id").alias("at"), (F.col("doc_id") % 10 == 3).alias("repost"))
    log = _store(spark)
    told = drivers.posts(log, found, _hash_embed)
    titles = log.frame("documents", drivers.DOCUMENTS).select("document_id", "title")
    return told.join(titles, "document_id", "left").select("source_id", "action", "title")


@query("""WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS uuid, max(o_orderkey) FILTER (o_orderstatus <> 'O') AS before, max(o_orderkey) AS last FROM orders GROUP BY o_custkey)
SELECT uuid AS source_id, CASE WHEN before IS NULL THEN 'inserted' WHEN before = last THEN 'skipped' ELSE 'updated' END AS action, o_orderpriority || ' ' || last AS title, coalesce(n_name, '') AS journal, CAST(1 AS BIGINT) AS chunks FROM a JOIN orders ON o_orderkey = last LEFT JOIN nation ON n_nationkey = o_custkey % 30""")
def journal_taken_in(spark, folder):
    """Customers' orders as entries that were edited again and again, taken in twice; journals are nations, some of them
    missing."""
    o = table(spark, folder, "orders")
    entries = o.select(F.col("o_custkey").cast("string").alias("uuid"), F.concat(F.lit("## "), "o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string"), F.lit("\nsome text")).alias("markdown"), F.lit(0.0).alias("created"), F.col("o_orderkey").cast("double").alias("modified"), F.lit(0).alias("starred"), (F.col("o_custkey") % 30).alias("journal"), "o_orderstatus")
    journals = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("name"))
    log = _store(spark)
    drivers.journal(log, entries.filter("o_orderstatus <> 'O'"), journals, _hash_embed)
    told = drivers.journal(log, entries, journals, _hash_embed)
    held = log.frame("documents", drivers.DOCUMENTS).select("document_id", "title", F.col("raw_path").alias("journal"))
    pieces = log.frame("chunks", drivers.CHUNKS).groupBy("document_id").agg(F.count("*").alias("chunks"))
    return told.join(held, "document_id").join(pieces, "document_id").select("source_id", "action", "title", "journal", "chunks")


@query("""WITH p AS (SELECT p_partkey, 'p' || CASE WHEN p_partkey % 50 = 49 THEN 1 ELSE p_partkey END || '_anglican' AS slug, p_size, p_partkey % 4 <> 0 AS known FROM part), t AS (SELECT *, count(*) OVER (PARTITION BY slug) AS twins FROM p)
SELECT slug AS source_id, CASE WHEN twins > 1 OR p_size % 10 = 9 THEN 'failed' WHEN known THEN 'processed' ELSE 'no_feast' END AS action, CASE WHEN twins > 1 THEN 'slug given more than once' WHEN p_size % 10 = 9 THEN 'a collect without text' END AS error,
CAST(CASE WHEN twins > 1 OR p_size % 10 = 9 THEN 0 ELSE 2 + CASE WHEN known AND p_size % 3 <> 0 THEN 1 ELSE 0 END END AS BIGINT) AS documents FROM t""")
def commemorations_taken_in(spark, folder):
    """Parts as commemorations: some have no feast or bio, some share a slug, some a collect without text."""
    k, s = F.col("p_partkey"), F.col("p_size")
    slug = F.concat(F.lit("p"), F.when(k % 50 == 49, F.lit(1)).otherwise(k).cast("string"), F.lit("_anglican"))
    part = table(spark, folder, "part")
    collect = lambda rite, said: F.struct(F.lit(rite).alias("rite"), said.alias("text"))
    landed = part.select(slug.alias("slug"), F.col("p_name").alias("name"), F.when(s % 3 != 0, F.col("p_type")).alias("bio"), F.array(collect("rite_i", F.col("p_brand")), collect("rite_ii", F.when(s % 10 == 9, F.lit(" ")).otherwise(F.col("p_type")))).alias("collects"))
    feasts = part.filter(k % 4 != 0).select(F.concat(F.lit("p"), k.cast("string"), F.lit("_anglican")).alias("slug"), k.alias("id"))
    log = _store(spark)
    told = drivers.commemorations(log, landed, feasts, _hash_embed)
    made = log.frame("documents", drivers.DOCUMENTS).groupBy(F.regexp_replace("source_id", "_rite-i+$", "").alias("source_id")).agg(F.count("*").alias("documents"))
    return told.join(made, "source_id", "left").select("source_id", "action", "error", F.coalesce("documents", F.lit(0)).alias("documents"))


@query("""WITH c AS (SELECT 'B' || lpad(CAST(conv_id AS VARCHAR), 9, '0') AS asin, turn // 3 AS page, turn, 'Loc ' || turn // 2 AS location, 'said ' || role || ' ' || turn AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY asin, location ORDER BY page, turn) AS n FROM c WHERE page % 5 <> 4)
SELECT 'kindle_book' AS content_type, asin AS source_id, 'Book ' || asin AS title, CAST(NULL AS VARCHAR) AS content_hash FROM c GROUP BY asin
UNION ALL SELECT 'kindle_highlight', asin || '#' || location, text, sha256(text) FROM o WHERE n = 1""")
def notebooks_taken_in(spark, folder):
    """Conversations as books with pages of highlights, some of which can't be read, in two runs of which the first is capped."""
    c = table(spark, folder, "conversations").withColumn("asin", F.concat(F.lit("B"), F.lpad(F.col("conv_id").cast("string"), 9, "0"))).withColumn("page", F.floor(F.col("turn") / 3).cast("int"))
    t = F.col("turn").cast("string")
    card = F.concat(F.lit('<div class="kp-notebook-row-separator"><input id="kp-annotation-location" value="Loc '), F.floor(F.col("turn") / 2).cast("string"), F.lit('"><span id="highlight">said '), "role", F.lit(" "), t, F.lit("</span></div>"))
    cards = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", card.alias("c")))), lambda x: x["c"]), "")
    pages = c.groupBy("asin", "page").agg(cards.alias("cards")).select("asin", "page", F.when(F.col("page") % 5 == 4, "broken").otherwise(F.concat(F.lit('<div id="kp-notebook-annotations">'), "cards", F.lit("</div>"))).alias("html"))
    book = F.concat(F.lit('<div class="kp-notebook-library-each-book" id="'), "asin", F.lit('"><h2 class="kp-notebook-searchable">Book '), "asin", F.lit("</h2></div>"))
    library = c.groupBy("asin").agg(F.first(book).alias("html"))
    log = _store(spark)
    _, told = drivers.notebooks(log, library, pages, _hash_embed, cap=100)
    drivers.notebooks(log, library, pages, _hash_embed, after=told["after"])
    return log.frame("documents", drivers.DOCUMENTS).select("content_type", "source_id", "title", "content_hash")
