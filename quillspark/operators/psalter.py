"""Psalms from the rows of psalter pages: rows as data, sorted into starts, days, headings and verses by scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import liturgy
from ..functions.dates import psalm_book
from ..functions.tree import rows_of_tables
from ..session import checkpointed
from .scan import carried

# Pages without psalms, and headings that aren't a psalm's.
NO_PSALMS = ["psalter.html", "concerning_the_psalter.html", "psalter_30day.html"]
BOOKS = ["Book One", "Book Two", "Book Three", "Book Four", "Book Five"]


def psalms(pages: DataFrame) -> DataFrame:
    """Psalms of pages (page: its file name, html): page, number, slug, title, latin_incipit, book, verses (array of
    struct<number, text>), headings (verse number to the heading before it), days (verse number to the day's mark).

    A page may come in parts (part: their order), cut between rows of its tables; a part fits a task, and so does a psalm. A
    psalm without verses is left out.
    """
    parts = pages if "part" in pages.columns else pages.withColumn("part", F.lit(0))
    rows = rows_of_tables(parts.filter(~F.col("page").isin(NO_PSALMS)), ["page", "part"])
    cell = lambda name: F.get(F.filter("cells", lambda c: F.array_contains(c["classes"], name)), F.lit(0))["text"]
    content = F.get(F.filter("cells", lambda c: ~F.array_contains(c["classes"], "vsnum")), F.lit(0))
    mark = lambda name: F.get(F.filter(F.transform("cells", lambda c: F.element_at(c["marks"], name)), lambda t: t.isNotNull()), F.lit(0))
    strong = F.get(F.filter(F.transform("cells", lambda c: c["strong"]), lambda t: t.isNotNull()), F.lit(0))
    start, verse = liturgy.psalm_number(mark("psnum")), F.when(F.regexp_like(cell("vsnum"), F.lit("^[0-9]+$")), cell("vsnum").try_cast("int"))
    day = liturgy.given(cell("psday"))
    heading = F.when(verse.isNull() & mark("psnum").isNull() & ~strong.isin(BOOKS), liturgy.given(strong))
    kinds = F.when(start.isNotNull(), "start").when(day.isNotNull(), "day").when(heading.isNotNull(), "heading").when(verse.isNotNull() & (content["text"] != ""), "verse")
    told = rows.select("page", "part", "at", kinds.alias("kind"), start.alias("start"), verse.alias("verse"), day.alias("day"), heading.alias("heading"), content["text"].alias("text"), F.when(start.isNotNull(), liturgy.given(mark("pslatin"))).alias("latin")).filter("kind IS NOT NULL")
    told = checkpointed(told)  # met four times by what follows
    # a day's mark before the first psalm is that psalm's; a part is a chunk of its page
    of = carried(told, "page", "at", chunk=F.col("part"), total={"starts": (F.col("kind") == "start").cast("int")})
    back = of.withColumn("psalm", F.greatest(F.lit(1), F.col("starts"))).withColumn("back", -F.col("at"))
    of = carried(back, "page", "back", chunk=-F.col("part"), last={"next": F.when(F.col("kind") == "verse", F.col("verse"))})
    pick = lambda kind, *fields: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("part", "at", *fields)))), lambda x: x.dropFields("part", "at"))
    by = of.groupBy("page", "psalm").agg(F.max("start").alias("number"), F.max("latin").alias("latin_incipit"), pick("verse", F.col("verse").alias("number"), "text").alias("verses"), pick("heading", F.col("next").alias("key"), F.col("heading").alias("value")).alias("h"), pick("day", F.col("next").alias("key"), F.col("day").alias("value")).alias("d"))
    # of several marks before one verse the last counts
    last = lambda c: F.map_from_entries(F.filter(c, lambda x, i: x["key"].isNotNull() & ~F.exists(F.slice(c, i + 2, F.size(c)), lambda y: y["key"] == x["key"])))
    some = by.filter(F.col("number").isNotNull() & (F.size("verses") > 0))
    return some.select("page", "number", liturgy.psalm_slug(F.col("number")).alias("slug"), F.concat(F.lit("Psalm "), F.col("number").cast("string")).alias("title"), "latin_incipit", psalm_book(F.col("number")).alias("book"), "verses", last("h").alias("headings"), last("d").alias("days"))


def psalm_documents(found: DataFrame) -> DataFrame:
    """Psalms as documents: source_id, title, body and the text that is embedded."""
    body = liturgy.psalm_body(F.col("verses"), F.col("headings"))
    return found.withColumn("body", body).select(F.col("slug").alias("source_id"), "title", "body", liturgy.psalm_text(F.col("number"), F.col("title"), F.col("latin_incipit"), F.col("body")).alias("embed_text"))
