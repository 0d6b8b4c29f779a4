"""Registered queries of the small functions: names, labels, captions, dates, contracts and matches, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, html, text
from ..functions import json as js
from ..operators import contracts, dedupe, matching, reports, search
from ..operators import jobs as job_ops
from ..sources.readers import table
from .catalog import _now, query
from .views import JOBS_SQL, NOW, jobs


# Names and labels


@query("""SELECT p_partkey, upper(p_name[1]) || substr(p_name, 2) || ' ' || p_brand AS audiobook, p_brand AS author, p_name AS title, p_name || ' ' || p_type AS file, p_type = 'ECONOMY' AS placeholder_free FROM part""")
def folder_labels(spark, folder):
    """Folders of audiobooks, `Author - Title` folders and file names with descriptors."""
    p = table(spark, folder, "part")
    cap = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 100))
    at = F.struct(text.author_title(F.concat("p_brand", F.lit(" - "), "p_name", F.lit("_AAX_64 [Reader, A.]"))).alias("x"))["x"]
    value = text.metadata_value(F.when(F.col("p_type") == "ECONOMY", F.col("p_type")).otherwise(" [Unknown  Author] "))
    return p.select("p_partkey", text.audiobook_title(F.concat(cap, F.lit("_"), "p_brand", F.lit("-LC_32_stereo"))).alias("audiobook"), at["author"].alias("author"), at["title"].alias("title"), text.file_label(F.concat(F.lit(" _"), "p_name", F.lit("_"), "p_type", F.lit(" [OCR] (epub)- "))).alias("file"), value.isNotNull().alias("placeholder_free"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Jane van Doe' WHEN c_custkey % 3 = 1 THEN 'Ann O''Neil' END AS author, 'A Book ' || c_mktsegment AS title, c_custkey % 3 <> 2 AS named FROM customer""")
def book_labels(spark, folder):
    """Titles and authors of book files, and whether a label is a name."""
    c = table(spark, folder, "customer")
    own = F.concat(F.lit("A Book "), "c_mktsegment")
    k = F.col("c_custkey") % 3
    label = F.when(k == 0, F.concat(own, F.lit(" -- JANE VAN DOE"))).when(k == 1, F.concat(F.lit("ANN O'NEIL - "), own)).otherwise(own)
    who = F.when(k == 0, "JANE VAN DOE").when(k == 1, "Ann O'Neil").otherwise("a1b2c3d4e5")
    m = text.book_metadata(label, F.lit("untitled"), F.lit(" "))
    return c.select("c_custkey", m["author"].alias("author"), F.coalesce(m["title"], text.file_label(label)).alias("title"), text.looks_like_author(who).alias("named"))


@query("""SELECT p_partkey, p_name AS title, CAST(1950 + p_size AS INT) AS year, CAST(p_size % 30 AS INT) AS season, CAST(p_size AS INT) AS episode, p_name AS before_year FROM part""")
def video_names(spark, folder):
    p = table(spark, folder, "part")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    name = F.concat(F.lit("[Group] "), F.translate("p_name", " ", "."), F.lit("."), (F.col("p_size") + 1950).cast("string"), F.lit(".S"), two(F.col("p_size") % 30), F.lit("E"), two(F.col("p_size")), F.lit(".1080p.BluRay.x264.mkv"))
    v = text.video_name(name)
    return p.select("p_partkey", v["title"].alias("title"), v["year"].alias("year"), v["season"].alias("season"), v["episode"].alias("episode"), text.video_title(F.concat("p_name", F.lit(" - "), (F.col("p_size") + 1950).cast("string"), F.lit(" 720p"))).alias("before_year"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'Couples ' || o_orderstatus END AS suffix, o_orderkey % 2 = 0 AS couples, CAST(3 AS INT) AS sections FROM orders""")
def session_titles(spark, folder):
    o = table(spark, folder, "orders")
    t = text.session_title(F.concat(F.date_format("o_orderdate", "MMMM d, yyyy"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" — Couples "), "o_orderstatus")).otherwise("")))
    sections = text.highlight_sections(F.concat("o_orderpriority", F.lit("\n### 1. one\nx\n### 2. two\n"), "o_orderstatus"))
    return o.select("o_orderkey", t["date"].alias("day"), t["suffix"].alias("suffix"), t["couples"].alias("couples"), F.size(sections).alias("sections"))


# Captions and texts


@query("""SELECT conv_id, string_agg(role, ' ' ORDER BY turn) FILTER (role <> last OR last IS NULL) AS vtt, string_agg(role, ' ' ORDER BY turn) FILTER (role <> last OR last IS NULL) AS srt, string_agg(role, ' ' ORDER BY turn) AS plain
FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM conversations) GROUP BY 1""")
def caption_texts(spark, folder):
    """Captions in both formats, consecutive repeats once, and a transcript that is none."""
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    c = table(spark, folder, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    time = "00:00:01.000 --> 00:00:02.000"
    vtt = F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join(F.transform("t", lambda r: F.concat(F.lit(f"{time} align:start\n<c>"), r, F.lit("</c>\n"))), "\n"))
    srt = F.array_join(F.transform("t", lambda r: F.concat(F.lit(f"1\r\n{time.replace('.', ',')}\r\n"), r, F.lit("\r\n"))), "\r\n")
    return c.select("conv_id", text.cue_text(vtt).alias("vtt"), text.transcript_text(srt, F.lit("srt")).alias("srt"), text.transcript_text(F.array_join("t", " \n "), F.lit("text/plain")).alias("plain"))


@query("""SELECT doc_id, CAST(len(list_filter(list_transform(string_split_regex(text, '\n{2,}'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')) AS INT) AS paragraphs, text AS bare, CAST(2 AS INT) AS directives, true AS lost, CASE WHEN source = lang THEN NULL ELSE source END AS quote FROM documents""")
def text_parts(spark, folder):
    """Paragraphs, texts without header or code fence, directives, and quotes that a text lacks."""
    d = table(spark, folder, "documents")
    headed = F.concat(F.lit("Title: x\nAuthor: "), "source", F.lit("\n\n"), "text")
    told = F.concat(F.lit("[directive, 2024-01-01] a\nno\n- [directive, 2024-01-02] "), "source")
    fenced = text.without_code_fence(F.concat(F.lit("```markdown\n"), "source", F.lit("\n```")))
    lost = text.directives_lost(told, F.lit("[directive, 2024-01-01] a"))
    missing = text.missing_quotes(F.array(fenced, "lang"), "lang")
    return d.select("doc_id", F.size(text.paragraphs(F.col("text"))).alias("paragraphs"), text.without_header(headed, ["Title", "Author"]).alias("bare"), F.size(text.directives(told)).alias("directives"), (F.array_join(lost, "|") == F.concat(F.lit("- [directive, 2024-01-02] "), "source")).alias("lost"), F.get(missing, F.lit(0)).alias("quote"))


@query("""SELECT p_partkey, 'A Collect for ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' (' || p_type || ')' ELSE '' END AS title, list_filter(['A Collect for ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' (' || p_type || ')' ELSE '' END, p_name || CASE WHEN p_size % 2 = 0 THEN ' (' || p_type || ')' ELSE '' END, CASE WHEN p_size % 2 = 0 AND length(p_type) >= 6 THEN p_type END], lambda x: length(x) >= 6).array_to_string('|') AS phrases FROM part""")
def match_phrases(spark, folder):
    p = table(spark, folder, "part")
    title = F.concat(F.lit("A Collect for "), "p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" ("), "p_type", F.lit(")"))).otherwise(""))
    return p.select("p_partkey", title.alias("title"), F.array_join(text.match_phrases(title), "|").alias("phrases"))


@query("""SELECT p_partkey, replace(p_name, ' ', '_') || '_' || lower(p_type) || '_eete_anglican' AS slug, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), ['x', 'feasts', 'feast']))), ' ') AS tokens, p_size % 2 = 0 AS kind, true AS overlaps FROM part""")
def slug_matches(spark, folder):
    """Slugs of accented names, their tokens, and hits of the expected kind and title."""
    p = table(spark, folder, "part")
    slug = text.ascii_slug(F.concat("p_name", F.lit(" "), "p_type", F.lit(" – Éețé!")), F.lit("anglican"))
    own = F.concat(F.translate("p_name", " ", "_"), F.lit("_x_feasts_rite-ii_anglican"))
    kind = text.kind_matches(F.lit("liturgical_unit"), F.when(F.col("p_size") % 2 == 0, "prayer").otherwise("canticle"), F.concat(F.lit(" Collect "), "p_name"), F.lit("collect"))
    return p.select("p_partkey", slug.alias("slug"), F.array_join(F.array_sort(text.slug_tokens(own)), " ").alias("tokens"), kind.alias("kind"), text.title_overlaps(F.concat("p_name", F.lit(" of the feast")), own).alias("overlaps"))


@query("""SELECT page_id, CASE WHEN page_id % 4 < 3 THEN 'abcdefgh' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') END AS video, 'https://www.youtube.com/watch?v=abcdefgh' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') AS watch, CAST(page_id AS VARCHAR) AS podcast, 'user' || page_id AS actor, 'k' || page_id AS rkey FROM pages""")
def media_addresses(spark, folder):
    """Ids in addresses of videos, podcasts and posts."""
    p = table(spark, folder, "pages").select("page_id")
    i, key = F.col("page_id").cast("string"), F.concat(F.lit("abcdefgh"), F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0"))
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.lit("https://youtu.be/"), key, F.lit("?t=3"))).when(k == 1, F.concat(F.lit("https://www.youtube.com/watch?list=x&v="), key)).when(k == 2, F.concat(F.lit("https://youtube.com/shorts/"), key)).otherwise(F.concat(F.lit("https://example.com/"), key))
    post = text.post_parts(F.concat(F.lit("https://example.com/profile/user"), i, F.lit("/post/k"), i, F.lit("?x")))
    return p.select("page_id", text.video_id(url).alias("video"), text.canonical_video_url(key).alias("watch"), text.podcast_id(F.concat(F.lit("https://podcasts.apple.com/us/podcast/x/id"), i)).alias("podcast"), post["actor"].alias("actor"), post["rkey"].alias("rkey"))


@query("""SELECT page_id, '/feed/' || page_id AS feed, 'About ' || page_id AS about, page_id % 2 = 0 AS login, regexp_extract(html, '<meta charset="([^"]+)"', 1) AS charset FROM pages""")
def page_tags(spark, folder):
    """Feeds, descriptions and log-in forms of pages, attributes in any order and quoting."""
    p = table(spark, folder, "pages")
    i = F.col("page_id").cast("string")
    head = F.concat(F.lit("<head><link rel=x href=/no><LINK href='/feed/"), i, F.lit("' rel=alternate type=\"application/rss+xml\"><link type='application/rss+xml' href='/second'><meta content=\"About "), i, F.lit('" property=og:description></head>'))
    form = F.when(F.col("page_id") % 2 == 0, '<form id="signin">').otherwise("<form>")
    return p.select("page_id", html.feed_link(head).alias("feed"), html.meta_content(head, "property", "og:description").alias("about"), html.is_login_page(form).alias("login"), html.attribute(F.regexp_extract("html", "(<meta [^>]*>)", 1), "charset").alias("charset"))


@query("""SELECT event_id, event_type = 'view' AS limited, event_type = 'click' AS transient, event_type = 'error' AS asin, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS given FROM events""")
def marked_texts(spark, folder):
    """Markers of limits and passing errors, product numbers, optional texts."""
    e, kind = table(spark, folder, "events"), F.col("event_type")
    said = F.when(kind == "view", "You hit the Usage Limit").when(kind == "click", "x: HTTP Error 503: y").otherwise(kind)
    asin = F.when(kind == "error", "B00ABC1234").when(kind == "view", "B00abc1234").otherwise("X00ABC1234")
    return e.select("event_id", text.rate_limited(said).alias("limited"), text.transient_error(said).alias("transient"), text.looks_like_asin(asin).alias("asin"), text.optional(F.when(kind == "view", " \t").otherwise(F.concat(F.lit(" "), kind, F.lit("\n")))).alias("given"))


# Dates


@query(f"""SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '{NOW[:10]}') AS days, date_diff('second', date_trunc('second', ts), TIMESTAMP '{NOW}') AS age, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) END AS iso, CAST(event_id + 978307200 AS BIGINT) AS unix, CAST(epoch(date_trunc('second', ts)) - 978307200 AS DOUBLE) AS core FROM events WHERE ts < TIMESTAMP '{NOW}'""")
def stamps(spark, folder):
    """Ages of ISO stamps, and seconds of another epoch."""
    e = table(spark, folder, "events").filter(F.col("ts") < _now())
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    now = F.lit(NOW).cast("timestamp")
    return e.select("event_id", dates.days_since(iso, now).cast("bigint").alias("days"), dates.age_seconds(iso, now).alias("age"), F.when(F.col("event_id") % 2 == 0, dates.iso_time(iso)).otherwise(dates.iso_time(F.lit("no time"))).cast("timestamp_ntz").alias("iso"), dates.core_data_to_unix(F.col("event_id")).cast("bigint").alias("unix"), dates.iso_to_core_data(iso).alias("core"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS read, CASE o_orderkey % 4 WHEN 0 THEN 3723.0 WHEN 1 THEN 62.0 WHEN 2 THEN 12.5 ELSE 0.0 END AS seconds, CASE WHEN o_orderkey % 3 = 0 THEN 4.25 END AS stars,
CASE WHEN o_orderkey % 150 + 1 <= 41 THEN 1 WHEN o_orderkey % 150 + 1 <= 72 THEN 2 WHEN o_orderkey % 150 + 1 <= 89 THEN 3 WHEN o_orderkey % 150 + 1 <= 106 THEN 4 ELSE 5 END AS book, round(date_diff('day', o_orderdate, TIMESTAMP '2003-01-01') * 86400.0, 1) AS since FROM orders""")
def parsed_values(spark, folder):
    """Dates, lengths, ratings and psalm numbers of exports."""
    o, k = table(spark, folder, "orders"), F.col("o_orderkey")
    length = F.when(k % 4 == 0, "1:02:03").when(k % 4 == 1, "1:02").when(k % 4 == 2, " 12.5 ").otherwise("1:x")
    since = dates.seconds_between(F.col("o_orderdate"), F.lit("2003-01-01").cast("timestamp_ntz"))
    return o.select("o_orderkey", dates.read_date(F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" | 2001/01/01"))).alias("read"), dates.duration(length).alias("seconds"), dates.rating(F.when(k % 3 == 0, "4.25").otherwise("none")).alias("stars"), dates.psalm_book(k % 150 + 1).cast("int").alias("book"), since.alias("since"))


# JSON and contracts


@query("""SELECT event_id, 'a|' || event_type AS topics, CASE WHEN event_id % 2 = 0 THEN '978' ELSE '10' END AS isbn, CAST(2024 AS INT) AS year, 'about ' || event_id AS description, event_type AS who, CASE WHEN event_type = 'a' THEN 1 ELSE 1 END AS kept, event_id % 3 = 0 AS known FROM events""")
def landed_json(spark, folder):
    """Fields of landed answers: topics, numbers, years, descriptions, people."""
    e, kind, i = table(spark, folder, "events"), F.col("event_type"), F.col("event_id").cast("string")
    ids = F.array(F.struct(F.lit("ISBN_10").alias("type"), F.lit("10").alias("identifier")), F.struct(F.when(F.col("event_id") % 2 == 0, "ISBN_13").otherwise("OTHER").alias("type"), F.lit("978").alias("identifier")))
    told = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"description":{"value":"about '), i, F.lit('"}}'))).otherwise(F.concat(F.lit('{"description":"about '), i, F.lit('"}')))
    crew = F.array(F.struct(F.lit("Writer").alias("job"), F.lit("x").alias("name")), F.struct(F.lit("Director").alias("job"), kind.alias("name")))
    topics = js.topics(F.array(F.lit(" a"), F.lit(" "), kind, F.concat(kind, F.lit(" "))))
    return e.select("event_id", F.array_join(F.array_distinct(topics), "|").alias("topics"), js.isbn(ids).alias("isbn"), js.year_of(F.col("ts").cast("string")).alias("year"), js.description(told).alias("description"), js.director(crew).alias("who"), F.size(js.only_keys(F.create_map(F.lit("a"), kind, F.lit("b"), kind), ["a", "c"])).alias("kept"), js.reject_reason_known(F.when(F.col("event_id") % 3 == 0, "Too similar to x").otherwise("because"), ["too similar", "off topic"]).alias("known"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'no front matter' END AS error, CASE WHEN turn % 3 <> 1 THEN role END AS title, CASE WHEN turn % 3 <> 1 THEN CAST(turn AS INT) END AS word_count, CASE WHEN turn % 3 <> 1 THEN turn % 3 = 2 END AS too_short, CASE WHEN turn % 3 = 0 THEN 'About.' END AS description FROM conversations""")
def parsed_summaries(spark, folder):
    """Summaries by contract: whole ones, short ones, and ones without front matter."""
    c, t = table(spark, folder, "conversations"), F.col("turn")
    head = F.concat(F.lit("---\nsummary_version: 1\nsource_kind: podcast\ntitle: "), "role", F.lit("\nword_count: "), t.cast("string"), F.lit("\n"))
    points, quotes = "".join(f"- p{i}\n" for i in range(contracts.BULLETS[0])), "".join(f"> q{i}\n" for i in range(contracts.QUOTES[0]))
    body = F.when(t % 3 == 1, "nothing").when(t % 3 == 2, F.concat(head, F.lit("too_short: true\n---\n"))).otherwise(F.concat(head, F.lit(f"---\n# Summary\nAbout.\n## Key points\n{points}## Quotes\n{quotes}")))
    s = contracts.parse_summary(body)
    return c.withColumn("s", s).select("conv_id", "turn", "s.error", "s.title", F.col("s.word_count").cast("int").alias("word_count"), "s.too_short", "s.description")


# Merges, matches and queues


@query("""SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT id, name FROM (SELECT p_partkey AS id, upper(p_name) AS name, row_number() OVER (PARTITION BY p_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 2 = 1) WHERE n = 1""")
def inserted_rows(spark, folder):
    """Stored rows, and of the new ones the first of each key that isn't stored."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    new = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at")).join(p.select("id", F.upper("name").alias("name")), "id")
    return dedupe.insert_ignore(p.filter("id % 2 = 0").withColumn("at", F.lit(0).cast("bigint")), new, ["id"], "at").select("id", "name")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 40 = 0)""")
def absent_rows(spark, folder):
    stored = table(spark, folder, "orders").filter("o_orderkey % 40 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return dedupe.absent(table(spark, folder, "customer").select("c_custkey"), stored, ["c_custkey"])


@query("""SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)""")
def orphan_vectors(spark, folder):
    return job_ops.orphans(table(spark, folder, "embeddings").select("vec_id"), table(spark, folder, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id")


@query(f"""WITH {JOBS_SQL} SELECT e.event_id AS job_id FROM events e WHERE event_id NOT IN (SELECT job_id FROM jobs WHERE status IN ('complete', 'failed', 'cancelled') AND completed_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY)""")
def kept_stages(spark, folder):
    stages = table(spark, folder, "events").select(F.col("event_id").alias("job_id"))
    return job_ops.kept_stages(stages, jobs(spark, folder), _now())


@query(f"""WITH {JOBS_SQL} SELECT kind, status, k FROM jobs WHERE strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') >= '2024-01-05' AND strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') <= '2024-01-09T23:59:59Z'""")
def between_days(spark, folder):
    iso = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return jobs(spark, folder).filter(search.between_dates(iso, "2024-01-05", "2024-01-09")).select("kind", "status", "k")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'changed' ELSE 'same' END AS state FROM part""")
def changed_rows(spark, folder):
    differs = dedupe.changed([(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.col("p_name"))), (F.lit(None), F.lit(None))])
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.when(differs, "changed").otherwise("same").alias("state"))


@query("""WITH w AS (SELECT o_orderkey AS wanted_id, o_custkey % 20 AS feed, o_orderkey % 3 AS k, p_name || ' episode' AS t, p_partkey FROM orders JOIN part ON p_partkey = o_orderkey % 50),
i AS (SELECT f.feed, p_partkey AS position, p_name || ' episode' AS t FROM part, (SELECT unnest(range(20)) AS feed) f WHERE p_partkey < 50),
m AS (SELECT w.wanted_id, i.position, CASE WHEN w.k = 0 THEN CASE WHEN i.t = w.t THEN 0 END WHEN w.k = 1 THEN CASE WHEN contains('part one ' || w.t || ' live', i.t) THEN 1 END END AS tier FROM w JOIN i USING (feed))
SELECT wanted_id, min(position) AS position, CAST(min(tier) AS INT) AS tier FROM m WHERE tier IS NOT NULL GROUP BY 1""")
def feed_matches(spark, folder):
    """Episodes in feeds: equal titles, titles within titles, and titles that no feed has."""
    p = table(spark, folder, "part").filter("p_partkey < 50")
    feeds = spark.range(20).select(F.col("id").alias("feed"))
    items = p.crossJoin(F.broadcast(feeds)).select("feed", F.col("p_partkey").alias("position"), F.concat(F.initcap("p_name"), F.lit(" Episode!")).alias("title"), F.lit("e").alias("enclosure"))
    k = F.col("o_orderkey") % 3
    o = table(spark, folder, "orders").withColumn("p_partkey", F.col("o_orderkey") % 50).join(p, "p_partkey")
    own = F.concat("p_name", F.lit(" episode"))
    title = F.when(k == 0, own).when(k == 1, F.concat(F.lit("Part one: "), own, F.lit(" (live)"))).otherwise("something else altogether now")
    wanted = o.select((F.col("o_custkey") % 20).alias("feed"), F.col("o_orderkey").alias("wanted_id"), title.alias("title"))
    return matching.feed_match(wanted, items).select("wanted_id", "position", F.col("tier").cast("int").alias("tier"))


@query("""WITH a AS (SELECT user_id AS case_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, event_type FROM events)
SELECT case_id, CAST(min(position) FILTER (event_type = 'error') AS BIGINT) AS position FROM a GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 0""")
def expected_hits(spark, folder):
    """The first accepted hit of each case that is of the expected kind and title."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = table(spark, folder, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("candidate_id"), place.cast("bigint").alias("position"), F.lit("liturgical_unit").alias("source_type"), F.when(F.col("event_type") == "error", "collect").otherwise("psalm").alias("genre"), F.concat(F.lit("Great error "), F.col("event_id").cast("string")).alias("source_title"))
    cases = e.select("case_id", F.lit("great_error_anglican").alias("source_id"), F.lit("collect").alias("kind")).distinct()
    return matching.expected_hits(cases, e).select("case_id", "position")


@query("""WITH c AS (SELECT user_id AS case_id, CASE user_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative_true' ELSE 'negative_spillover' END AS category, count(*) FILTER (event_type = 'error') AS matched, count(*) FILTER (event_type <> 'view') AS hits, count(*) FILTER (event_type = 'signup') AS liturgical FROM events GROUP BY 1, 2)
SELECT case_id, category, CASE category WHEN 'positive' THEN matched > 0 WHEN 'negative_true' THEN hits = 0 ELSE liturgical = 0 END AS passed FROM c""")
def replay_verdicts(spark, folder):
    e = table(spark, folder, "events").withColumnRenamed("user_id", "case_id")
    k = F.col("case_id") % 3
    cases = e.select("case_id", F.when(k == 0, "positive").when(k == 1, "negative_true").otherwise("negative_spillover").alias("category")).distinct()
    hits = e.filter("event_type <> 'view'").select("case_id", F.when(F.col("event_type") == "signup", "liturgical_unit").otherwise("prose").alias("source_type"))
    return matching.verdicts(cases, e.filter("event_type = 'error'").select("case_id"), hits).select("case_id", "category", "passed")


@query("""SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS position FROM (SELECT vec_id FROM embeddings WHERE vec_id < 20 UNION SELECT vec_id FROM embeddings WHERE vec_id < 40 AND vec_id % 2 = 0)""")
def appended_hits(spark, folder):
    """Hits of a search, those by titles behind them, each with its place."""
    v = table(spark, folder, "embeddings").select("vec_id")
    every = search.appended(v.filter("vec_id < 20"), v.filter("vec_id < 40 AND vec_id % 2 = 0"), "vec_id")
    return search.positions(every, ["vec_id"]).select("vec_id", F.col("position").cast("int").alias("position"))


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) AS n FROM events WHERE event_type IN ('view', 'error')) WHERE n <= 25""")
def recent_rows(spark, folder):
    return reports.recent(table(spark, folder, "events"), ["view", "error"], "event_type", "ts", "event_id", 25).select("user_id", "event_id")
