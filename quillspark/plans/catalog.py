"""The registered queries of the engine itself, each over whole tables, with DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html, text, vectors
from ..functions import json as js
from ..operators import chunks, dedupe, matching, reports, search, threads
from ..operators import jobs as job_ops
from ..session import shared_folder
from ..sources import sinks
from ..sources.readers import table
from ..streaming import events as streams
from .views import JOBS_SQL, NOW, as_jobs, jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _question(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q"))


_DISTANCE = "list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


# Search


@query(f"SELECT e.vec_id, round({_DISTANCE}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_DISTANCE}, e.vec_id LIMIT 10")
def knn_topk(spark, folder):
    found = search.nearest(table(spark, folder, "embeddings"), _question(spark, folder), 10, "vec_id")
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT e.vec_id, e.label, round({_DISTANCE}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY {_DISTANCE}, e.vec_id LIMIT 10")
def knn_filtered(spark, folder):
    every = table(spark, folder, "embeddings")
    allowed = every.filter(search.all_of([F.col("label") == 3, None]))
    found = search.nearest(search.restricted(every, allowed, "vec_id"), _question(spark, folder), 10, "vec_id")
    return found.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"""WITH d AS (SELECT e.vec_id, e.label, e.vec_id % 100 AS document_id, {_DISTANCE} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM d),
b AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY distance, vec_id) AS n FROM r WHERE rank <= 5)
SELECT vec_id, CAST(label AS BIGINT) AS label, document_id, round(distance, 6) AS distance FROM b WHERE n = 1 ORDER BY distance, vec_id LIMIT 20""")
def knn_fanout_dedupe(spark, folder):
    every = table(spark, folder, "embeddings").withColumn("document_id", F.col("vec_id") % 100)
    fanned = search.nearest_of_each(every, _question(spark, folder), "label", 5, "vec_id")
    return search.merged(fanned, "document_id", 20, "vec_id").select("vec_id", F.col("label").cast("bigint").alias("label"), "document_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, similarity FROM (SELECT e.vec_id, greatest(0, least(1, 1 - {_DISTANCE})) AS s, round(greatest(0, least(1, 1 - {_DISTANCE})), 4) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE s >= 0.2")
def floor_similarity(spark, folder):
    found = search.distances(table(spark, folder, "embeddings"), _question(spark, folder))
    return search.over_floor(found, 0.2).select("vec_id", "similarity")


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vector_norms(spark, folder):
    packed = table(spark, folder, "embeddings").withColumn("packed", vectors.pack("embedding"))
    return packed.withColumn("unpacked", vectors.unpack("packed")).select("vec_id", F.round(vectors.norm(F.col("unpacked")), 6).alias("norm"))


@query("""WITH t AS (SELECT item_id AS id, array_to_string(string_split(text, ' ')[1:3], ' ') AS title FROM benchmark)
SELECT seed_id, id, matched, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY matched DESC, id) AS rank FROM (
SELECT d.doc_id AS seed_id, t.id, CAST(length(t.title) AS INT) AS matched FROM t JOIN documents d ON contains(lower(d.text), lower(t.title))
WHERE length(t.title) >= 4 AND regexp_matches(lower(d.text), CASE WHEN regexp_matches(t.title, '^[\\p{L}\\p{N}_]') THEN '(^|[^\\p{L}\\p{N}_])' ELSE '[\\p{L}\\p{N}_]' END || regexp_escape(lower(t.title)) ||
CASE WHEN regexp_matches(t.title, '[\\p{L}\\p{N}_]$') THEN '($|[^\\p{L}\\p{N}_])' ELSE '[\\p{L}\\p{N}_]' END))) WHERE rank <= 5""")
def title_matches(spark, folder):
    titles = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), F.array_join(F.slice(F.split("text", " "), F.lit(1), F.lit(3)), " ").alias("title"))
    seeds = table(spark, folder, "documents").select(F.col("doc_id").alias("seed_id"), F.col("text").alias("seed"))
    return search.title_matches(titles, seeds).select("seed_id", "id", F.col("matched").cast("int").alias("matched"), F.col("rank").cast("bigint").alias("rank"))


# Reports


@query("""SELECT CAST(CASE WHEN grouping(source) = 1 AND grouping(lang) = 1 THEN 3 WHEN grouping(source) = 1 THEN 2 ELSE 0 END AS INT) AS level, source AS kind, lang AS status, count(*) AS n
FROM documents GROUP BY GROUPING SETS ((), (lang), (source, lang))""")
def progress_grouping_sets(spark, folder):
    return reports.progress(table(spark, folder, "documents"), "source", "lang")


@query("SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS by_status FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def counts_by_type_and_status(spark, folder):
    nested = reports.counts_nested(table(spark, folder, "documents"), "source", "lang")
    return nested.select("source", F.array_join(F.transform(F.array_sort(F.map_entries("by_status")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("by_status"))


@query("""SELECT subject, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS names, NOT starts_with(subject, '_other:') AS controlled
FROM (SELECT source, unnest([lang, '_other:' || source, lang]) AS subject FROM documents) GROUP BY subject""")
def subject_frequency(spark, folder):
    rows = table(spark, folder, "documents").withColumn("subjects", F.to_json(F.array("lang", F.concat(F.lit("_other:"), "source"), "lang")))
    return reports.subject_frequency(rows, "subjects", "source").select("subject", "n", F.array_join("names", ",").alias("names"), "controlled")


@query(f"""WITH {JOBS_SQL} SELECT max(completed_at) FILTER (status = 'complete') AS last_completed,
count(*) FILTER (status = 'failed' AND completed_at > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS failed_last_hour,
count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE) AS running_long, count(*) AS jobs FROM jobs""")
def health_signals(spark, folder):
    return reports.health(jobs(spark, folder), _now())


@query(f"WITH {JOBS_SQL} SELECT status, count(*) AS n FROM jobs WHERE completed_at > TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND completed_at <= TIMESTAMP '{NOW}' AND status IN ('complete', 'failed') GROUP BY 1")
def throughput_last_day(spark, folder):
    return reports.throughput(jobs(spark, folder), _now(), 86_400)


@query(f"WITH {JOBS_SQL} SELECT job_id, kind, completed_at FROM jobs WHERE status = 'complete' ORDER BY completed_at DESC, job_id DESC LIMIT 20")
def recent_completed(spark, folder):
    return reports.recent_completed(jobs(spark, folder), 20).select("job_id", "kind", "completed_at")


@query(f"WITH {JOBS_SQL} SELECT job_id, kind, created_at FROM jobs WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 1")
def queue_head(spark, folder):
    return reports.oldest_pending(jobs(spark, folder)).select("job_id", "kind", "created_at")


@query(f"WITH {JOBS_SQL} SELECT job_id, round(epoch_us(TIMESTAMP '{NOW}') / 1e6 - epoch_us(started_at) / 1e6, 0) AS seconds FROM jobs WHERE status = 'running'")
def in_flight(spark, folder):
    return reports.in_flight(jobs(spark, folder), _now()).select("job_id", F.round((F.unix_micros(_now().cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6, 0).alias("seconds"))


@query(f"""WITH {JOBS_SQL} SELECT job_id, kind, payload, count(*) OVER (PARTITION BY kind, payload ORDER BY completed_at RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS failures
FROM jobs WHERE status = 'failed'""")
def repeated_failures(spark, folder):
    return reports.repeated_failures(jobs(spark, folder), 6 * 3600).select("job_id", "kind", "payload", "failures")


@query("SELECT lang AS label, max(n_chars) AS last FROM documents GROUP BY 1 ORDER BY last DESC, label LIMIT 30")
def distinct_labels(spark, folder):
    return reports.distinct_labels(table(spark, folder, "documents"), F.col("lang"), "n_chars", 30)


@query("SELECT e.event_type, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT event_type FROM events) e LEFT JOIN (SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY 1) c USING (event_type)")
def zero_filled_counts(spark, folder):
    events = table(spark, folder, "events")
    counts = events.filter("value > 50").groupBy("event_type").agg(F.count("*").alias("n"))
    return reports.zero_filled(counts, events.select("event_type").distinct(), "event_type")


@query("""SELECT o_orderpriority, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY GROUPING SETS ((), (l_returnflag), (o_orderpriority, l_returnflag))""")
def revenue_rollup(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_discount")
    joined = items.join(table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    p, f = F.col("o_orderpriority"), F.col("l_returnflag")
    return joined.groupingSets([[], [f], [p, f]], p, f).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT user_id, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def top_per_group(spark, folder):
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, folder, "events").withColumn("rank", F.row_number().over(order).cast("bigint")).filter("rank <= 3").select("user_id", "event_id", "value", "rank")


# Jobs


@query(f"""WITH {JOBS_SQL}, t AS (SELECT *, date_diff('second', date_trunc('second', started_at), TIMESTAMP '{NOW}') AS age, CASE kind WHEN 'ingest_library' THEN 5400 WHEN 'ingest_article' THEN 900 WHEN 'ingest_podcast' THEN 3600 WHEN 'ingest_capture' THEN 600 WHEN 'classify_book' THEN 300 ELSE 1800 END AS threshold FROM jobs WHERE status = 'running')
SELECT job_id, kind, age, CAST(threshold AS INT) AS threshold FROM t WHERE age > threshold""")
def zombies(spark, folder):
    return job_ops.zombies(jobs(spark, folder), _now()).select("job_id", "kind", "age", "threshold")


@query(f"""WITH {JOBS_SQL}, e AS (SELECT *, CASE WHEN status = 'failed' THEN payload END AS error FROM jobs)
SELECT user_id, coalesce(arg_min(status, {{'a': created_at, 'b': job_id}}) FILTER (status IN ('complete', 'failed')), arg_max(status, {{'a': created_at, 'b': job_id}})) AS status, count(*) AS events, arg_max(error, {{'a': created_at, 'b': job_id}}) FILTER (error IS NOT NULL) AS error FROM e GROUP BY 1""")
def job_state_fold(spark, folder):
    events = jobs(spark, folder).withColumn("error", F.when(F.col("status") == "failed", F.col("payload")))
    return job_ops.current_state(events, "user_id", "created_at", "job_id")


@query(f"""WITH {JOBS_SQL} SELECT user_id, kind, CASE WHEN count(*) FILTER (status = 'complete') > 0 THEN 'complete' ELSE arg_max(status, created_at) END AS status, arg_max(payload, created_at) AS payload, count(*) FILTER (status = 'running') AS attempts FROM jobs GROUP BY 1, 2""")
def stage_state_fold(spark, folder):
    return job_ops.stage_state(jobs(spark, folder), ["user_id", "kind"], "created_at")


@query(f"WITH {JOBS_SQL} SELECT status, count(*) AS n FROM jobs WHERE NOT (status IN ('complete', 'failed') AND coalesce(completed_at, created_at) < TIMESTAMP '{NOW}' - INTERVAL 14 DAY) GROUP BY 1")
def purge_old_jobs(spark, folder):
    return job_ops.kept_jobs(jobs(spark, folder), _now(), 14).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {JOBS_SQL} SELECT job_id, CASE WHEN k % 7 = 0 THEN 'queued' WHEN k % 2 = 0 AND k % 5 < 3 THEN 'queued' ELSE 'failed' END AS next_status,
CAST(CASE WHEN k % 7 = 0 THEN greatest(0, k % 5 - 1) ELSE k % 5 END AS INT) AS attempts, CASE WHEN k % 7 <> 0 AND k % 2 = 0 AND k % 5 >= 3 THEN 'retry_exhausted' END AS error FROM jobs""")
def retry_transitions(spark, folder):
    k = F.col("k")
    after = job_ops.next_status(k % 5, k % 2 == 0, k % 7 == 0)
    return jobs(spark, folder).withColumn("after", after).select("job_id", F.col("after.status").alias("next_status"), "after.attempts", "after.error")


@query("SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.page_id AND l.toxic = 1) AND coalesce((SELECT max(quality) FROM labels l WHERE l.doc_id = p.page_id), -1) < 1")
def changed_pages(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.lit(1).alias("edited"))
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "page_id")
    return job_ops.changed_pages(pages, labels.withColumn("edited", F.col("quality")), labels.filter("toxic = 1"), "page_id", "edited").select("page_id")


@query("SELECT d.doc_id AS id, max(l.page_id) AS job_id FROM documents d JOIN pages l ON d.doc_id = l.page_id OR regexp_extract(l.url, 'https?://([^/:?#]+)', 1) = d.source || '.example.com' GROUP BY 1")
def repair_matches(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("path"), F.concat("source", F.lit(".example.com")).alias("url"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("page_id"))
    failed = table(spark, folder, "pages").select(F.col("page_id").alias("job_id"), F.col("page_id").cast("string").alias("path"), text.hostname(F.col("url")).alias("url"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("page_id"))
    return job_ops.repair_matches(docs, failed)


# Joins, sets, dedupe and merges


@query("SELECT d.doc_id, d.source, false AS labelled FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT d.doc_id, d.source, true FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_semi(spark, folder):
    docs, labels = table(spark, folder, "documents").select("doc_id", "source"), table(spark, folder, "labels")
    return dedupe.without(docs, labels, "doc_id").withColumn("labelled", F.lit(False)).union(docs.join(labels.select("doc_id"), "doc_id", "left_semi").withColumn("labelled", F.lit(True)))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY text")
def dedupe_hash(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return dedupe.first_of_key(docs, F.col("content_hash"), "doc_id").select("doc_id", "content_hash")


@query("""WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM (SELECT doc_id, sha256(text) AS a, concat_ws(':', source, lang, n_chars) AS b FROM documents)),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, false AS won, CAST([] AS VARCHAR[]) AS as_, CAST([] AS VARCHAR[]) AS bs
UNION ALL SELECT o.n, o.doc_id, o.a, o.b, NOT (list_contains(as_, o.a) OR list_contains(bs, o.b)), CASE WHEN list_contains(as_, o.a) OR list_contains(bs, o.b) THEN as_ ELSE as_ || [o.a] END, CASE WHEN list_contains(as_, o.a) OR list_contains(bs, o.b) THEN bs ELSE bs || [o.b] END FROM r JOIN o ON o.n = r.n + 1)
SELECT doc_id, a AS content_hash, b AS source_id FROM r WHERE won""")
def two_key_first_wins(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.concat_ws(":", "source", "lang", F.col("n_chars").cast("string")).alias("source_id"))
    return dedupe.two_key_first_wins(docs, "doc_id", "content_hash", "source_id")


@query("""WITH a AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars > 5000), b AS (SELECT DISTINCT source, lang FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0)
SELECT *, 'lost' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'stayed' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def set_algebra(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    a = docs.filter("n_chars > 5000").select("source", "lang")
    b = docs.join(table(spark, folder, "labels").filter("quality = 0"), "doc_id").select("source", "lang")
    return matching.set_changes(a, b)


@query("""WITH r AS (SELECT doc_id, CASE WHEN n_chars > 1500 THEN '1' ELSE '0' END AS h FROM documents), s AS (SELECT doc_id, max(CAST(quality AS VARCHAR)) AS old FROM labels GROUP BY 1)
SELECT doc_id, CASE WHEN old IS NULL THEN 'insert' WHEN old = h THEN 'skip' ELSE 'update' END AS action FROM r LEFT JOIN s USING (doc_id)""")
def upsert_actions(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.when(F.col("n_chars") > 1500, "1").otherwise("0").alias("h"))
    stored = table(spark, folder, "labels").groupBy("doc_id").agg(F.max(F.col("quality").cast("string")).alias("h"))
    return dedupe.upsert_actions(stored, rows, "doc_id", "h").select("doc_id", "action")


@query("SELECT doc_id, source, CAST(coalesce(l.quality, CAST(n_chars > 1500 AS INT)) AS INT) AS quality FROM (SELECT * FROM documents) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)")
def enrichment_merge(spark, folder):
    stored = table(spark, folder, "documents").select("doc_id", "source", (F.col("n_chars") > 1500).cast("int").alias("quality"))
    patch = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return dedupe.filled(stored, patch, "doc_id", ["quality"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_writer_wins(spark, folder):
    return dedupe.last_of_key(table(spark, folder, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""WITH s AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t, [lower(replace(p_brand, '#', ' '))] AS a, string_split(lower(replace(p_brand, '#', ' ')), ' ') AS b FROM part),
w AS (SELECT p_name || ' ' || p_type AS wanted_id, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t, ['brand', '7'] AS b FROM (SELECT DISTINCT p_name, p_type FROM part)),
m AS (SELECT wanted_id, id, len(list_intersect(w.t, s.t)) / len(list_distinct(list_concat(w.t, s.t))) AS ts, len(list_intersect(w.b, s.b)) / len(list_distinct(list_concat(w.b, s.b))) AS aus FROM w, s)
SELECT wanted_id, id, round(score, 6) AS score FROM (SELECT *, 0.7 * ts + 0.3 * aus AS score, row_number() OVER (PARTITION BY wanted_id ORDER BY 0.7 * ts + 0.3 * aus DESC, id) AS n FROM m WHERE ts >= 0.7) WHERE n = 1""")
def fuzzy_match(spark, folder):
    parts = table(spark, folder, "part")
    title = F.concat_ws(" ", "p_name", "p_type")
    wanted = parts.select(title.alias("wanted_id")).distinct().select("wanted_id", F.col("wanted_id").alias("title"), F.lit("Brand#7").alias("author"))
    stored = parts.select(F.col("p_partkey").alias("id"), title.alias("title"), F.col("p_brand").alias("author"))
    return dedupe.fuzzy_best(wanted, stored).select("wanted_id", "id", F.round("score", 6).alias("score"))


@query("""WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT conv_id, turn, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS ws FROM conversations) WHERE len(ws) > 0),
r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS text, false AS stays, CAST([] AS VARCHAR[][]) AS kept FROM w
UNION ALL SELECT w.conv_id, w.n, w.turn, w.text, k.free, CASE WHEN k.free THEN kept || [w.ws] ELSE kept END FROM r JOIN w ON w.conv_id = r.conv_id AND w.n = r.n + 1, LATERAL (SELECT len(list_filter(kept, lambda x: len(list_intersect(x, w.ws)) >= 0.85 * len(list_distinct(x || w.ws)))) = 0 AS free) k)
SELECT conv_id, turn, text FROM r WHERE stays""")
def greedy_near_duplicates(spark, folder):
    return dedupe.greedy_distinct(table(spark, folder, "conversations"), "conv_id", "turn", "text")


# Text


@query("""SELECT doc_id, CAST(len(w) AS INT) AS n_words, CAST(floor(greatest(len(w) * 1.3, length(text) / 4) + 0.5) AS INT) AS tokens, len(w) >= 2000 AS long, substr(text, 1, 300) AS snippet
FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents)""")
def text_counts(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", F.size(text.words(t)).alias("n_words"), text.approximate_tokens(t).alias("tokens"), text.worth_summary(t).alias("long"), text.snippet(t).alias("snippet"))


@query("""SELECT doc_id, coalesce(substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^#+', ''))), lambda x: x <> '')[1], 1, 80), 'Untitled') AS title,
coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', ''), ''), 'capture') AS slug,
'"' || replace(replace(text, '\\', '\\\\'), '"', '\\"') || '"' AS yaml FROM documents""")
def titles_and_slugs(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", text.derived_title(t, F.lit("Untitled")).alias("title"), text.url_slug(t).alias("slug"), text.yaml_scalar(t).alias("yaml"))


@query("""WITH w AS (SELECT doc_id, text, n_chars, list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, max(n) AS best FROM (SELECT doc_id, tri, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS tri FROM w WHERE len(w) >= 30) GROUP BY 1, 2) GROUP BY 1)
SELECT w.doc_id, round(CASE WHEN len(w.w) >= 30 THEN best / (len(w.w) - 2) ELSE 0 END, 6) AS trigram_share,
length(trim(text)) >= 50 AND length(regexp_replace(text, '[^.?!,;:]', '', 'g')) / len(w.w) >= 0.01 AND (CASE WHEN len(w.w) >= 30 THEN best / (len(w.w) - 2) ELSE 0 END) <= 0.1 AND (n_chars / 15.0 <= 30 OR len(w.w) / (n_chars / 15.0 / 60) BETWEEN 30 AND 400) AS ok FROM w LEFT JOIN g USING (doc_id)""")
def caption_quality(spark, folder):
    t, seconds = F.col("text"), F.col("n_chars") / 15.0
    shared = table(spark, folder, "documents").withColumn("share", text.trigram_share(t))
    return shared.select("doc_id", F.round("share", 6).alias("trigram_share"), text.caption_ok(t, seconds, F.col("share")).alias("ok"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CAST(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, ceil((len(w) - 64) / 448)) END AS INT) AS windows, w[1] AS first_token, w[-1] AS last_token FROM w""")
def token_windows(spark, folder):
    w = chunks.token_windows(text.words(F.col("text")))
    cut = table(spark, folder, "documents").select("doc_id", w.alias("w"))
    return cut.select("doc_id", F.size("w").alias("windows"), F.get("w", F.lit(0))[0].alias("first_token"), F.element_at(F.element_at("w", -1), -1).alias("last_token"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CAST(CASE WHEN len(w) > 1500 THEN ceil((len(w) - 64) / 448) ELSE 1 END AS BIGINT) AS chunks, CAST(CASE WHEN len(w) > 1500 THEN len(w) + 64 * (ceil((len(w) - 64) / 448) - 1) ELSE len(w) END AS BIGINT) AS tokens FROM w WHERE len(w) > 0""")
def hybrid_chunks(spark, folder):
    pieces = chunks.exploded(table(spark, folder, "documents"), chunks.chunks(F.col("text")), "doc_id")
    return chunks.stored_summary(pieces, "doc_id")


@query("""SELECT page_id, regexp_extract(url, 'https?://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[^#]*') AS canonical,
regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[^#]*'), '[?&](utm_source|ref)=[^&]*', '', 'g'), '^([^?&]*)&', '\\1?'), '\\?$', '') AS untracked FROM pages""")
def url_parts(spark, folder):
    u = F.col("url")
    return table(spark, folder, "pages").select("page_id", text.hostname(u).alias("host"), text.canonical_url(u).alias("canonical"), text.canonical_url_untracked(u).alias("untracked"))


@query("""SELECT page_id, regexp_extract(url, '//([^/:?#]+)', 1) || regexp_replace(regexp_extract(url, '//[^/?#]+([^?#]*)', 1), '/$', '') ||
CASE WHEN url LIKE '%.html%' THEN '' ELSE CASE WHEN contains(url, '?') THEN '__q' || substr(sha256(regexp_extract(url, '\\?([^#]*)', 1)), 1, 8) ELSE '' END || '.html' END AS path FROM pages""")
def cache_paths(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.cache_path(F.col("url")).alias("path"))


@query("""SELECT page_id, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) AS title, regexp_extract(html, '<html[^>]* lang="([^"]+)"', 1) AS lang FROM pages""")
def page_titles(spark, folder):
    h = F.col("html")
    return table(spark, folder, "pages").select("page_id", html.raw_title(h).alias("title"), html.language(h).alias("lang"))


@query("""SELECT page_id, regexp_replace(regexp_replace(trim(lower(t)), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g') AS episode, trim(regexp_replace(regexp_replace(lower(t), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key
FROM (SELECT page_id, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) AS t FROM pages)""")
def title_keys(spark, folder):
    titles = table(spark, folder, "pages").select("page_id", html.raw_title(F.col("html")).alias("t"))
    return titles.select("page_id", text.episode_title(F.col("t")).alias("episode"), text.match_key(F.col("t")).alias("key"))


def _entities_sql(text: str) -> str:
    for entity, sign in (("&quot;", '"'), ("&#x27;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{sign}')"
    return text


def _cut_sql(page: str) -> str:
    """A page without hidden elements and comments, blocks' tags as line feeds, other tags out."""
    for tag in sorted(html.HIDDEN):
        page = f"regexp_replace({page}, '(?s)<{tag}\\b.*?</{tag}>', '', 'g')"
    page = f"regexp_replace({page}, '(?s)<!.*?>', '', 'g')"
    page = f"regexp_replace({page}, '</?({'|'.join(sorted(html.BLOCKS))})\\b[^>]*>', chr(10), 'g')"
    return _entities_sql(f"regexp_replace({page}, '<[^>]*>', '', 'g')")


@query(f"""SELECT page_id, {_entities_sql("trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1))")} AS title,
array_to_string(list_filter(list_transform(string_split({_cut_sql('html')}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM pages""")
def article_texts(spark, folder):
    """Reader's text and title of every page, entities resolved."""
    h = F.col("html")
    return table(spark, folder, "pages").select("page_id", html.unescape(html.raw_title(h)).alias("title"), html.article_text(h).alias("text"))


_LINKS_SQL = """l AS (SELECT page_id, url, unnest(range(len(h))) AS position, regexp_extract(url, '^https?://[^/?#]+') || unnest(h) AS target FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="(/[^"#]*)', 1) AS h FROM pages))"""


@query(f"WITH {_LINKS_SQL} SELECT page_id, url, CAST(position AS INT) AS position, target FROM l")
def page_links(spark, folder):
    """Every link of every page, absolute."""
    return html.rows_of_links(table(spark, folder, "pages"), ["page_id", "url"])


@query(f"""WITH {_LINKS_SQL} SELECT DISTINCT url, CAST(0 AS INT) AS round FROM pages UNION ALL
SELECT DISTINCT target, 1 FROM l WHERE lower(regexp_extract(url, '//([^/:?#]+)', 1)) = lower(regexp_extract(target, '//([^/:?#]+)', 1)) AND target NOT IN (SELECT url FROM pages)""")
def crawl_frontier(spark, folder):
    """Pages and targets by the round in which a crawl from all pages reaches them, within the pages' hosts."""
    pages = table(spark, folder, "pages")
    links = html.rows_of_links(pages, ["url"])
    return threads.reached(pages.select("url"), links, text.hostname(F.col("url")) == text.hostname(F.col("target")))


@query("""SELECT c1.conv_id, c1.turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM
(SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '')) AS a FROM conversations) c1 JOIN
(SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '')) AS b FROM conversations) c2 ON c1.conv_id = c2.conv_id AND c2.turn = c1.turn + 1""")
def turn_similarity(spark, folder):
    c = table(spark, folder, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.text_similarity(F.col("text"), F.col("next")), 6).alias("similarity"))


@query("""SELECT conv_id, '---' || chr(10) || 'conversation: "' || conv_id || '"' || chr(10) || '---' || chr(10) || chr(10) || string_agg('### ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) AS markdown FROM conversations GROUP BY 1""")
def thread_markdown(spark, folder):
    return threads.rendered(table(spark, folder, "conversations"), "conv_id", "turn", F.col("role"), F.col("text"), [("conversation", F.any_value("conv_id"))])


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS depth FROM conversations")
def thread_depths(spark, folder):
    c = table(spark, folder, "conversations")
    uri = F.concat_ws(":", "conv_id", "turn")
    parent = F.lag(uri).over(Window.partitionBy("conv_id").orderBy("turn"))
    posts = c.select(uri.alias("uri"), parent.alias("parent"), F.lit(0).alias("position"))
    flat = threads.flattened(posts)
    return flat.select(F.split_part("uri", F.lit(":"), F.lit(1)).cast("bigint").alias("conv_id"), F.split_part("uri", F.lit(":"), F.lit(2)).cast("bigint").alias("turn"), F.col("depth").cast("int").alias("depth"))


# JSON


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k') = '0' THEN '' ELSE json_extract_string(props, '$.k') END AS summary, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_payload(spark, folder):
    e = table(spark, folder, "events")
    renamed = F.replace("props", F.lit('"k"'), F.lit('"title"'))
    return e.select("event_id", js.payload_summary(renamed).alias("summary"), F.try_variant_get(js.decoded(F.col("props")), "$.k", "int").alias("k"))


# Streams


def _event_stream(spark, folder):
    # a pattern, as a stream's plain path must be a folder, and a table may be one file
    return streams.stream(spark, f"{folder}/[e]vents.parquet", table(spark, folder, "events"), "ts")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_throughput(spark, folder):
    hourly = streams.throughput(_event_stream(spark, folder), "ts", "event_type")
    return streams.available(hourly, shared_folder(spark), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM g GROUP BY user_id, g""")
def stream_sessions(spark, folder):
    found = streams.available(streams.sessions(_event_stream(spark, folder), "ts", "user_id"), shared_folder(spark), "complete")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query(f"""WITH {JOBS_SQL} SELECT user_id, coalesce(arg_min(status, {{'a': created_at, 'b': job_id}}) FILTER (status IN ('complete', 'failed')), arg_max(status, {{'a': created_at, 'b': job_id}})) AS status, count(*) AS events FROM jobs GROUP BY 1""")
def stream_job_states(spark, folder):
    return streams.available(streams.states(as_jobs(_event_stream(spark, folder))), shared_folder(spark), "update", ["user_id"])


# Hydration, rendering and matching


@query(f"""WITH h AS (SELECT e.vec_id AS doc_id, {_DISTANCE} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 2, 1 LIMIT 50)
SELECT h.doc_id, round(distance, 6) AS distance, d.source, d.lang, CAST(l.quality AS INT) AS quality, d.text AS chunk_text FROM h JOIN documents d USING (doc_id) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)""")
def hydrated_hits(spark, folder):
    hits = search.nearest(table(spark, folder, "embeddings"), _question(spark, folder), 50, "vec_id").select(F.col("vec_id").alias("doc_id"), F.round("distance", 6).alias("distance"))
    meta = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", F.col("text").alias("chunk_text"))
    return docs.join(hits, "doc_id").join(meta, "doc_id", "left").select("doc_id", "distance", "source", "lang", "quality", "chunk_text")


@query("SELECT conv_id, arg_min(text, turn) AS chunk_text FROM conversations GROUP BY 1")
def first_chunks(spark, folder):
    return search.first_chunk(table(spark, folder, "conversations").withColumnRenamed("turn", "chunk_index"), "conv_id")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def reassembled_texts(spark, folder):
    return chunks.reassembled(table(spark, folder, "conversations").withColumnRenamed("turn", "chunk_index"), "conv_id")


@query("""SELECT page_id, 'Title: ' || trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) || chr(10) || 'URL: ' || url || chr(10) || chr(10) AS header,
sha256(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) || chr(10) || url) AS content_hash FROM pages""")
def embed_headers(spark, folder):
    p = table(spark, folder, "pages").select("page_id", "url", html.raw_title(F.col("html")).alias("title"))
    return p.select("page_id", text.labelled_header([("Title", F.col("title")), ("Author", F.lit(None).cast("string")), ("URL", F.col("url"))]).alias("header"), text.content_hash(F.col("title"), F.col("url")).alias("content_hash"))


@query("""SELECT doc_id, '---' || chr(10) || 'source: "' || source || '"' || chr(10) || 'lang: "' || lang || '"' || chr(10) || '---' || chr(10) || chr(10) || text || chr(10) AS markdown FROM documents""")
def markdown_documents(spark, folder):
    body = sinks.markdown([("source", F.col("source")), ("author", F.lit(None).cast("string")), ("lang", F.col("lang"))], F.col("text"))
    return table(spark, folder, "documents").select("doc_id", body.alias("markdown"))


@query("""SELECT p_partkey, array_to_string(list_distinct(flatten(list_transform(list_filter(string_split(lower(p_name || 's of the ' || p_type || ' 007'), ' '), lambda t: t NOT IN ('a', 'an', 'the', 'of', 'for', 'to', 'and')),
lambda t: CASE WHEN t = '007' THEN ['7'] WHEN length(t) > 3 AND ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN [t, t[1:length(t) - 1]] ELSE [t] END))).list_sort(), ' ') AS tokens FROM part""")
def matcher_tokens(spark, folder):
    title = F.concat("p_name", F.lit("s of the "), "p_type", F.lit(" 007"))
    return table(spark, folder, "part").select("p_partkey", F.array_join(F.array_sort(text.matcher_tokens(title)), " ").alias("tokens"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM events""")
def rolling_hour(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return reports.counted_before(e, "event_id", ["event_type"], "at", 3_600_000_000, "last_hour")


@query("SELECT o_orderkey, o_totalprice, round(greatest(0, least(1, 1 - o_totalprice / 1000000)), 4) AS similarity FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderpriority ILIKE '%urg%'")
def predicates(spark, folder):
    asked = search.all_of([F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"), search.like_pattern(F.col("o_orderpriority"), "urg"), None])
    return table(spark, folder, "orders").filter(asked).select("o_orderkey", "o_totalprice", F.round(vectors.similarity(F.col("o_totalprice") / 1000000), 4).alias("similarity"))
