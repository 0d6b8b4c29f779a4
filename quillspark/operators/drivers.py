"""Drivers of articles, library files, audiobooks, posts, journals, commemorations and notebooks: what came in becomes documents, chunks, jobs and job results, which one
commit makes visible together or not at all.

Each driver reads the stored tables at one version, and appends to that version; if another writer was faster it starts again
from what that one has written. A job that can't be done has a result with an error, beside the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, html, text, tree
from ..session import checkpointed
from ..sources.commits import Commits, Snapshot
from .claims import Busy
from .dedupe import fuzzy_best, two_key_first_wins, upsert_actions
from .intake import embedded, payload

DOCUMENTS = "document_id string, content_type string, source_id string, source_uri string, title string, author string, narrator string, content_hash string, raw_path string, file_size bigint, file_mtime timestamp, entry_id string, status string"
CHUNKS = "document_id string, chunk_index int, text string, token_count int, embedding array<float>"
JOBS = "job_id string, kind string, payload string, status string, attempts int"
RESULTS = "job_id bigint, document_id string, action string, chunk_count bigint, error string"
OUTCOMES = "source_id string, document_id string, action string, error string"
#: The tables of a library and their columns.
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "jobs": JOBS, "results": RESULTS, "outcomes": OUTCOMES}

# The shortest body of an article, formats of books that are read, and those that are passed over.
SHORTEST_BODY = 200
FORMATS, SKIPPED = [".epub", ".pdf", ".mobi", ".azw3"], [".chm"]

Embed = Callable[[Column], Column]


def _committed(log: Commits, make: Callable[[Snapshot], dict[str, DataFrame]], told: str = "results", tries: int = 20) -> DataFrame:
    """Writes all tables of make(snapshot) and then commits them as the next version; returns the one that tells what was
    done."""
    for _ in range(tries):
        base = log.snapshot()
        made = make(base)
        # tables of which some rows go are written anew
        replace = {table: log.written(table, rows) for table, rows in made.pop("replace", {}).items()}
        paths = {table: log.written(table, rows) for table, rows in made.items()}
        if log.commit(base, paths, replace):
            return log.spark.read.schema(TABLES[told]).parquet(paths[told])
    raise Busy(f"not committed in {tries} tries")


def _in_form(rows: DataFrame, schema: str) -> DataFrame:
    """rows with the columns of the schema; those that it lacks are null."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    return rows.select(*(F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind).alias(name) for name, kind in fields))


def _id(content_type: str, key: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{content_type}|"), key), 256), 1, 16)


def _results(jobs: DataFrame, pieces: DataFrame) -> DataFrame:
    """The jobs (job_id, document_id, action, error) with the number of chunks their documents got."""
    counted = pieces.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    met = jobs.join(counted, "document_id", "left")
    return _in_form(met.withColumn("chunk_count", F.when(F.col("action") == "inserted", F.coalesce("chunk_count", F.lit(0)))), RESULTS)


def articles(log: Commits, landed: DataFrame, embed: Embed) -> DataFrame:
    """Fetched pages (job_id, url, html) as articles; returns results: job_id, document_id, action (inserted, existing, failed),
    chunk_count, error.

    An address is taken in its canonical form. An article is there already if its address is, or else its text; among the
    jobs of one call those with smaller ids come first. Not an address, an empty page, and a text of less than 200 characters
    are errors. Job ids are distinct; rows without one are left out.
    """
    url = text.canonical_url(F.trim("url"))
    read = landed.filter("job_id IS NOT NULL").select("job_id", url.alias("source_id"), "html", text.optional(html.unescape(html.raw_title(F.col("html")))).alias("title"), text.optional(html.unescape(html.meta_content(F.col("html"), "name", "author"))).alias("author"), html.article_text("html").alias("body"))
    error = F.when(F.col("source_id").isNull(), "no address of a page").when(F.coalesce("html", F.lit("")) == "", "empty page").when(F.length(F.trim(F.coalesce("body", F.lit("")))) < SHORTEST_BODY, "no text worth reading")
    judged = checkpointed(read.withColumn("error", error).withColumn("content_hash", F.when(F.col("error").isNull(), text.content_hash(F.col("body")))).drop("html"))

    def make(base: Snapshot) -> dict[str, DataFrame]:
        stored = log.frame("documents", DOCUMENTS, base)
        good = judged.filter("error IS NULL")
        by_url = stored.filter("content_type = 'article'").groupBy("source_id").agg(F.min("document_id").alias("of_url"))
        by_hash = stored.filter("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("document_id").alias("of_hash"))
        met = good.join(by_url, "source_id", "left").join(by_hash, "content_hash", "left").withColumn("known", F.coalesce("of_url", "of_hash"))
        fresh = met.filter("known IS NULL")
        first = two_key_first_wins(fresh, "job_id", "source_id", "content_hash").select("job_id").withColumn("new", F.lit(True))
        told = checkpointed(met.join(first, "job_id", "left").withColumn("document_id", F.when(F.col("new"), _id("article", F.col("source_id")))))
        made = told.filter("new")
        # a job that isn't the first stands for the document that has its address by then, or else its text
        own = lambda key, name: made.select(key, F.struct("job_id", "document_id").alias(name))
        by_then = lambda name: F.when(F.col(f"{name}.job_id") < F.col("job_id"), F.col(f"{name}.document_id"))
        later = told.filter("new IS NULL").join(own("source_id", "new_url"), "source_id", "left").join(own("content_hash", "new_hash"), "content_hash", "left")
        existing = later.select("job_id", F.coalesce("known", by_then("new_url"), by_then("new_hash")).alias("document_id"), F.lit("existing").alias("action"))
        header = text.labelled_header([("Title", F.col("title")), ("Author", F.col("author")), ("Source", text.hostname(F.col("source_id"))), ("URL", F.col("source_id"))])
        pieces = embedded(made.withColumn("text", F.concat(header, F.col("body"))), made.select("document_id").limit(0), embed)
        documents = made.select("document_id", F.lit("article").alias("content_type"), "source_id", F.col("source_id").alias("source_uri"), "title", "author", "content_hash", F.lit("embedded").alias("status"))
        failed = judged.filter("error IS NOT NULL").select("job_id", F.lit(None).cast("string").alias("document_id"), F.lit("failed").alias("action"), "error")
        jobs = made.select("job_id", "document_id", F.lit("inserted").alias("action")).unionByName(existing).withColumn("error", F.lit(None).cast("string")).unionByName(failed)
        pieces = checkpointed(pieces)
        return {"documents": _in_form(documents, DOCUMENTS), "chunks": _in_form(pieces, CHUNKS), "results": _results(jobs, pieces)}

    return _committed(log, make)


def library_files(log: Commits, landed: DataFrame, embed: Embed) -> DataFrame:
    """Book files (job_id, path, content_hash, file_size, file_mtime, title, author, text, error: why nothing could be
    extracted) as books; returns results: action inserted, existing, skipped (formats that are passed over) or failed.

    A book is there already if its content is, under whatever path; among the jobs of one call the smallest id comes first. A
    file that can't be read becomes a document with status failed, so that it isn't tried again. A title or author that says
    nothing is taken from the path. Other formats, and rows without a path, are errors.
    """
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    bad = F.when(F.coalesce("path", F.lit("")) == "", "no path").when(suffix.isin(SKIPPED), F.lit(None)).when(~suffix.isin(FORMATS), F.concat(F.lit("unsupported format "), suffix))
    label = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    judged = checkpointed(landed.filter("job_id IS NOT NULL").withColumn("broken", F.col("error")).withColumn("error", bad).withColumn("skips", F.coalesce(suffix.isin(SKIPPED), F.lit(False))).withColumn("named", text.book_metadata(label, F.col("title"), F.col("author"))))

    def make(base: Snapshot) -> dict[str, DataFrame]:
        stored = log.frame("documents", DOCUMENTS, base).filter("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("document_id").alias("known"))
        good = judged.filter("error IS NULL AND NOT skips").join(stored, "content_hash", "left")
        firsts = good.filter("known IS NULL AND content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("job_id").alias("first"))
        told = checkpointed(good.join(firsts, "content_hash", "left").withColumn("new", F.col("first") == F.col("job_id")).withColumn("document_id", F.coalesce("known", _id("book", F.col("content_hash")))))
        made = told.filter("new")
        read = made.filter("broken IS NULL")
        pieces = checkpointed(embedded(read, read.select("document_id").limit(0), embed))
        status = F.when(F.col("broken").isNull(), "embedded").otherwise("failed")
        title, author = (F.when(F.col("broken").isNull(), F.col(f"named.{c}")).alias(c) for c in ("title", "author"))
        documents = made.select("document_id", F.lit("book").alias("content_type"), F.col("path").alias("source_uri"), F.col("path").alias("raw_path"), title, author, "content_hash", "file_size", "file_mtime", status.alias("status"))
        action = F.when(F.col("new"), F.when(F.col("broken").isNull(), "inserted").otherwise("failed")).otherwise("existing")
        jobs = told.select("job_id", "document_id", action.alias("action"), F.when(F.col("new"), F.col("broken")).alias("error"))
        out = judged.filter("error IS NOT NULL OR skips").select("job_id", F.lit(None).cast("string").alias("document_id"), F.when(F.col("skips"), "skipped").otherwise("failed").alias("action"), "error")
        return {"documents": _in_form(documents, DOCUMENTS), "chunks": _in_form(pieces, CHUNKS), "results": _results(jobs.unionByName(out), pieces)}

    return _committed(log, make)


def audiobooks(log: Commits, landed: DataFrame) -> DataFrame:
    """Audiobooks (job_id, path, title, author, narrator, n_files; what tags don't tell is null) as documents; returns results:
    action matched (a reading-log entry has the title), inserted (a new entry is made) or skipped (the path is there already,
    or holds no audio file).

    The entry with the most similar title, and author, counts (see dedupe.fuzzy_best); new entries are distinct by title and
    author, and books of one call match only stored entries. Every new document gets a job of kind classify_book.
    """
    folder = F.regexp_extract("path", r"([^/]*?)(?:\.[A-Za-z0-9]{2,4})?$", 1)
    parts = text.author_title(folder)
    title = F.coalesce(text.optional(F.col("title")), text.optional(parts["title"]), text.audiobook_title(folder))
    judged = checkpointed(landed.filter("job_id IS NOT NULL").select("job_id", "path", title.alias("title"), F.coalesce(text.optional(F.col("author")), text.optional(parts["author"])).alias("author"), "narrator", (F.coalesce("path", F.lit("")) != "").alias("has_path"), (F.coalesce("n_files", F.lit(0)) > 0).alias("has_audio")))

    def make(base: Snapshot) -> dict[str, DataFrame]:
        stored = log.frame("documents", DOCUMENTS, base)
        known = stored.filter("source_uri IS NOT NULL").groupBy("source_uri").agg(F.min("document_id").alias("known")).withColumnRenamed("source_uri", "path")
        firsts = judged.filter("has_path AND has_audio").groupBy("path").agg(F.min("job_id").alias("first"))
        told = judged.join(known, "path", "left").join(firsts, "path", "left").withColumn("new", F.col("has_audio") & F.col("known").isNull() & (F.col("job_id") == F.col("first")))
        told = checkpointed(told.withColumn("new", F.coalesce("new", F.lit(False))).withColumn("document_id", F.coalesce("known", F.when(F.col("has_path") & F.col("has_audio"), _id("audiobook", F.col("path"))))))
        made = told.filter("new")
        entries = stored.filter("content_type = 'storygraph_entry'").groupBy("document_id").agg(F.max_by("title", "status").alias("title"), F.max_by("author", "status").alias("author")).withColumnRenamed("document_id", "id")
        best = fuzzy_best(made.select(F.col("job_id").alias("wanted_id"), "title", "author"), entries).select(F.col("wanted_id").alias("job_id"), F.col("id").alias("entry"))
        name_hash = text.content_hash(F.coalesce("title", F.lit("")), F.coalesce("author", F.lit("")))
        met = checkpointed(made.join(best, "job_id", "left").withColumn("name_hash", name_hash).withColumn("entry_id", F.coalesce("entry", _id("storygraph_entry", F.col("name_hash")))))
        new_entries = met.filter("entry IS NULL").groupBy("entry_id").agg(F.min_by(F.struct("title", "author", "narrator", "path", "name_hash"), "job_id").alias("e")).select(F.col("entry_id").alias("document_id"), F.lit("storygraph_entry").alias("content_type"), "e.title", "e.author", "e.narrator", F.col("e.path").alias("raw_path"), F.col("e.name_hash").alias("content_hash"), F.lit("unmatched").alias("status"))
        books = met.select("document_id", F.lit("audiobook").alias("content_type"), F.col("path").alias("source_uri"), F.col("path").alias("raw_path"), "title", "author", "narrator", F.sha2("path", 256).alias("content_hash"), "entry_id", F.lit("complete").alias("status"))
        asked = payload(document_id=F.col("document_id"), title=F.col("title"), author=F.col("author"), content_type=F.lit("audiobook"))
        jobs = met.select(F.concat(F.lit("classify-"), "document_id").alias("job_id"), F.lit("classify_book").alias("kind"), asked.alias("payload"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"))
        done = met.select("job_id", "document_id", F.when(F.col("entry").isNotNull(), "matched").otherwise("inserted").alias("action"), F.lit(None).cast("string").alias("error"))
        rest = told.filter("NOT new").select("job_id", "document_id", F.when(F.col("has_path"), "skipped").otherwise("failed").alias("action"), F.when(~F.col("has_path"), "no path").alias("error"))
        return {"documents": _in_form(books.unionByName(new_entries, allowMissingColumns=True), DOCUMENTS), "jobs": _in_form(jobs, JOBS), "results": _in_form(done.unionByName(rest), RESULTS)}

    return _committed(log, make)


def _live(documents: DataFrame, content_type: str) -> DataFrame:
    """The documents of a type."""
    return documents.filter(F.col("content_type") == content_type)


def posts(log: Commits, found: DataFrame, embed: Embed) -> DataFrame:
    """Posts of a feed (uri, author, text, at, repost) as documents; returns outcomes: source_id, document_id, action
    (inserted, existing, skipped: a repost, or without an address or text).

    A post is there already if its address is, or else its text; among those of one call the earlier come first. So a batch
    that is read again adds nothing. Of several rows with one address the earliest counts.
    """
    judged = found.withColumn("content_hash", F.sha2("text", 256)).withColumn("skips", F.coalesce("repost", F.lit(False)) | (F.coalesce("uri", F.lit("")) == "") | (F.trim(F.coalesce("text", F.lit(""))) == ""))
    one = judged.filter("NOT skips").groupBy("uri").agg(F.min(F.struct("at", "author", "text", "content_hash")).alias("p")).select("uri", "p.*")
    first = checkpointed(one.withColumn("order", F.struct("at", "uri")))
    skipped = checkpointed(judged.filter("skips").select(F.col("uri").alias("source_id"), F.lit("skipped").alias("action")).distinct())

    def make(base: Snapshot) -> dict[str, DataFrame]:
        stored = log.frame("documents", DOCUMENTS, base)
        known = _live(stored, "bluesky_post").select(F.col("source_id").alias("uri")).distinct()
        hashes = stored.filter("content_hash IS NOT NULL").select("content_hash").distinct()
        fresh = first.join(known, "uri", "left_anti").join(hashes, "content_hash", "left_anti")
        # addresses are distinct, so that only equal texts clash
        firsts = fresh.groupBy("content_hash").agg(F.min("order").alias("order"))
        made = checkpointed(fresh.join(firsts, ["content_hash", "order"]).withColumn("document_id", _id("bluesky_post", F.col("uri"))))
        pieces = checkpointed(embedded(made, made.select("document_id").limit(0), embed))
        documents = made.select("document_id", F.lit("bluesky_post").alias("content_type"), F.col("uri").alias("source_id"), F.col("uri").alias("source_uri"), F.substring("text", 1, 80).alias("title"), "author", "content_hash", F.lit("embedded").alias("status"))
        done = first.select(F.col("uri").alias("source_id")).join(documents.select("source_id", "document_id"), "source_id", "left").withColumn("action", F.when(F.col("document_id").isNotNull(), "inserted").otherwise("existing"))
        return {"documents": _in_form(documents, DOCUMENTS), "chunks": _in_form(pieces, CHUNKS), "outcomes": _in_form(done.unionByName(skipped, allowMissingColumns=True), OUTCOMES)}

    return _committed(log, make, "outcomes")


def follow_posts(log: Commits, stream: DataFrame, embed: Embed, checkpoint: str) -> None:
    """Takes in all that a stream of posts has, from where its checkpoint ends, and stops."""
    query = stream.writeStream.foreachBatch(lambda batch, _: posts(log, batch, embed)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def journal(log: Commits, entries: DataFrame, journals: DataFrame, embed: Embed, since: Column | None = None) -> DataFrame:
    """Entries of a journal (uuid, markdown, created, modified: seconds since 2001, starred, journal: a key of journals) and
    journals (key, name) as documents; returns outcomes: action inserted, updated or skipped (unchanged).

    Entries without text are left out, and with `since` (ISO text) those that were modified before. An entry whose journal
    isn't known has none. An entry that has changed takes its document's place, and its chunks theirs. Of several rows of one
    uuid the last modified counts.
    """
    wanted = entries.filter((F.coalesce("markdown", F.lit("")) != "") & F.col("uuid").isNotNull())
    wanted = wanted if since is None else wanted.filter(F.col("modified") >= dates.iso_to_core_data(since))
    last = wanted.groupBy("uuid").agg(F.max_by(F.struct("markdown", "created", "modified", "starred", "journal"), F.coalesce("modified", F.lit(0.0))).alias("e")).select("uuid", "e.*")
    named = last.join(journals.select(F.col("key").alias("journal"), "name"), "journal", "left")
    modified = F.coalesce(dates.core_data_to_unix(F.col("modified")), F.lit(0.0))
    judged = checkpointed(named.withColumn("content_hash", F.sha2(F.concat("markdown", F.lit("|"), F.format_string("%.6f", modified)), 256)).withColumn("document_id", _id("dayone_entry", F.col("uuid"))))
    title = text.derived_title(F.col("markdown"), F.lit("(untitled Day One entry)"))

    def make(base: Snapshot) -> dict[str, DataFrame]:
        every = log.frame("documents", DOCUMENTS, base)
        stored = _live(every, "dayone_entry").select(F.col("source_id").alias("uuid"), "content_hash")
        told = checkpointed(upsert_actions(stored, judged, "uuid", "content_hash"))
        new = told.filter("action <> 'skip'")
        pieces = checkpointed(embedded(new.select("document_id", F.col("markdown").alias("text")), new.select("document_id").limit(0), embed))
        documents = new.select("document_id", F.lit("dayone_entry").alias("content_type"), F.col("uuid").alias("source_id"), F.concat(F.lit("dayone://"), "uuid").alias("source_uri"), title.alias("title"), F.coalesce("name", F.lit("")).alias("raw_path"), "content_hash", F.lit("embedded").alias("status"))
        gone = told.filter("action = 'update'").select("document_id")
        kept = lambda table: log.frame(table, TABLES[table], base).join(gone, "document_id", "left_anti")
        outcomes = told.select(F.col("uuid").alias("source_id"), "document_id", F.when(F.col("action") == "insert", "inserted").when(F.col("action") == "update", "updated").otherwise("skipped").alias("action"))
        return {"documents": _in_form(documents, DOCUMENTS), "chunks": _in_form(pieces, CHUNKS), "outcomes": _in_form(outcomes, OUTCOMES), "replace": {t: kept(t) for t in ("documents", "chunks")} if not gone.isEmpty() else {}}

    return _committed(log, make, "outcomes")


def commemorations(log: Commits, landed: DataFrame, feasts: DataFrame, embed: Embed) -> DataFrame:
    """Commemorations (slug, name, bio, collects: array<struct<rite, text>>) as documents of a bio and collects, with the feast
    (slug, id) that they stand for as entry_id; returns outcomes by slug: action processed, failed, or no_feast (the bio is
    left out, collects have no feast).

    A commemoration goes in as a whole or, with its reason, not at all: one without a slug or a name, with a collect without a
    text or of no known rite, or with two collects of one rite fails, and the others go on. Documents that are there already
    stay as they are. Of several commemorations with one slug all fail.
    """
    rites = F.transform(F.coalesce("collects", F.expr("CAST(array() AS array<struct<rite: string, text: string>>)")), lambda c: c["rite"])
    texts = lambda test: F.coalesce(F.exists("collects", test), F.lit(False))
    error = F.when(F.coalesce("slug", F.lit("")) == "", "no slug").when(F.coalesce("name", F.lit("")) == "", "no name").when(F.col("twins") > 1, "slug given more than once").when(texts(lambda c: F.coalesce(F.trim(c["text"]), F.lit("")) == ""), "a collect without text").when(texts(lambda c: ~F.coalesce(c["rite"].isin("rite_i", "rite_ii"), F.lit(False))), "a collect of no known rite").when(F.size(rites) > F.size(F.array_distinct(rites)), "two collects of one rite")
    twins = landed.groupBy("slug").agg(F.count("*").alias("twins"))
    known = feasts.groupBy("slug").agg(F.max("id").cast("string").alias("feast"))
    told = landed.join(twins, landed["slug"].eqNullSafe(twins["slug"])).drop(twins["slug"]).join(known, "slug", "left").withColumn("error", error)
    judged = checkpointed(told.select("slug", "name", "bio", "collects", "feast", "error"))

    def make(base: Snapshot) -> dict[str, DataFrame]:
        good = judged.filter("error IS NULL")
        bios = good.filter("feast IS NOT NULL AND trim(coalesce(bio, '')) <> ''").select(F.col("slug").alias("source_id"), "name", F.col("bio").alias("text"), "feast", F.lit("liturgical_unit_bio").alias("content_type"), F.concat(F.lit("lff2024://commemoration/"), "slug").alias("source_uri"))
        prayers = good.select("slug", "name", "feast", F.explode("collects").alias("c")).select(F.concat_ws("_", "slug", F.translate("c.rite", "_", "-")).alias("source_id"), F.concat(F.lit("Collect for "), "name").alias("name"), F.col("c.text").alias("text"), "feast", F.lit("liturgical_unit").alias("content_type"), F.concat(F.lit("lff2024://collect/"), "slug").alias("source_uri"))
        units = bios.unionByName(prayers).withColumn("document_id", _id("lff", F.concat_ws("|", "content_type", "source_id")))
        new = checkpointed(units.join(log.frame("documents", DOCUMENTS, base).select("document_id"), "document_id", "left_anti"))
        pieces = checkpointed(embedded(new, new.select("document_id").limit(0), embed))
        documents = new.select("document_id", "content_type", "source_id", "source_uri", F.col("name").alias("title"), F.col("feast").alias("entry_id"), F.sha2("text", 256).alias("content_hash"), F.lit("embedded").alias("status"))
        action = F.when(F.col("error").isNotNull(), "failed").when(F.col("feast").isNull(), "no_feast").otherwise("processed")
        return {"documents": _in_form(documents, DOCUMENTS), "chunks": _in_form(pieces, CHUNKS), "outcomes": _in_form(judged.select(F.col("slug").alias("source_id"), action.alias("action"), "error"), OUTCOMES)}

    return _committed(log, make, "outcomes")


def notebooks(log: Commits, library: DataFrame, pages: DataFrame, embed: Embed, cap: int | None = None, after: tuple[str, int] | None = None) -> tuple[DataFrame, dict]:
    """A notebook's books (library: html, first pages) and pages of their highlights (asin, page, html) as documents; returns
    outcomes by source_id, and {status, after, pages}: status is partial where `cap` pages have been read and more are left,
    which the next call reads from `after` on; complete else.

    Books and pages are taken in the order of asin and page. A highlight is there already if its book and location are; among
    those of one call the first page counts. A page that can't be read is an outcome with an error, and the others go on.
    Pages of a book that the library doesn't name give the book a document without a title.
    """
    at = F.struct("asin", "page")
    left = pages.filter("asin IS NOT NULL AND page IS NOT NULL")
    left = left if after is None else left.filter((F.col("asin") > after[0]) | (F.col("asin") == after[0]) & (F.col("page") > after[1]))
    taken = checkpointed((left if cap is None else left.orderBy("asin", "page").limit(cap)).select("asin", "page", tree.notebook_highlights(F.col("html")).alias("f")))
    last = taken.agg(F.max(at).alias("at"), F.count("*").alias("n")).first()
    place = (last["at"]["asin"], last["at"]["page"]) if last["at"] else after
    more = cap is not None and last["n"] == cap and not left.filter((F.col("asin") > place[0]) | (F.col("asin") == place[0]) & (F.col("page") > place[1])).isEmpty()
    named = tree.rows_of_books(library, []).groupBy("asin").agg(F.min(F.struct("title", "authors")).alias("n")).select("asin", "n.title", "n.authors")
    found = taken.select("asin", "page", F.posexplode("f.highlights").alias("i", "h")).select("asin", "page", "i", "h.text", "h.note", "h.location")
    key = F.coalesce("location", F.substring(F.sha2("text", 256), 1, 12))
    marks = found.withColumn("source_id", F.concat_ws("#", "asin", key)).groupBy("source_id").agg(F.min_by(F.struct("asin", "text", "note"), F.struct("page", "i")).alias("h")).select("source_id", "h.*")
    broken = taken.filter("f.status = 'broken'").select(F.concat_ws("#", "asin", F.col("page").cast("string")).alias("source_id"), F.lit("failed").alias("action"), F.lit("page can't be read").alias("error"))

    def make(base: Snapshot) -> dict[str, DataFrame]:
        stored = log.frame("documents", DOCUMENTS, base).select("document_id")
        books = taken.select("asin").distinct().join(named, "asin", "left").select(_id("kindle_book", F.col("asin")).alias("document_id"), F.lit("kindle_book").alias("content_type"), F.col("asin").alias("source_id"), F.concat(F.lit("amazon-asin:"), "asin").alias("source_uri"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("authors", F.lit("")).alias("author"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("text"))
        short = F.when(F.length("text") > 60, F.concat(F.substring("text", 1, 60), F.lit("…"))).otherwise(F.col("text"))
        note = F.coalesce("note", F.lit(""))
        said = F.concat("text", F.when(note != "", F.concat(F.lit("\n\n"), note)).otherwise(""))
        lights = marks.join(named, "asin", "left").select(_id("kindle_highlight", F.col("source_id")).alias("document_id"), F.lit("kindle_highlight").alias("content_type"), "source_id", F.concat(F.lit("amazon-asin:"), "source_id").alias("source_uri"), short.alias("title"), F.coalesce("authors", F.lit("")).alias("author"), F.sha2(F.concat("text", note), 256).alias("content_hash"), said.alias("text"))
        every = checkpointed(books.unionByName(lights))
        new = checkpointed(every.join(stored, "document_id", "left_anti").withColumn("status", F.lit("embedded")))
        pieces = checkpointed(embedded(new.filter("text IS NOT NULL"), new.select("document_id").limit(0), embed))
        outcomes = every.join(new.select("document_id", F.lit(True).alias("new")), "document_id", "left").select("source_id", "document_id", F.when(F.col("new"), "inserted").otherwise("existing").alias("action"))
        return {"documents": _in_form(new, DOCUMENTS), "chunks": _in_form(pieces, CHUNKS), "outcomes": _in_form(outcomes.unionByName(broken, allowMissingColumns=True), OUTCOMES)}

    return _committed(log, make, "outcomes"), {"status": "partial" if more else "complete", "after": place, "pages": last["n"]}
