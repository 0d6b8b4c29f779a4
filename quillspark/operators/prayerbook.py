"""Units of a prayer book's pages: collects, offices, proper liturgies, prayers and psalms, and how they are taken in.

A page is read into elements, a row each; what an element means by itself is told in expressions, and what it means by those
before it by scans (operators/scan.py): the last page mark and heading, the number of the unit, the state of a machine. All
parsers give rows of one form; a page that can't be read is a row with an error, beside the units of all others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import liturgy
from ..functions.elements import page_elements, page_events
from ..functions.liturgy import given
from ..functions.text import ascii_slug, content_hash, let, strip
from ..session import checkpointed
from . import psalter
from .scan import carried, carried_within

TRADITION = "anglican"
# Folders of the parsers' pages, pages that aren't read, liturgies by their pages, marks of cells and headings.
FOLDERS = {"collects": ["Prayers/Collects", "collects"], "daily_office": ["DailyOffice", "daily_office"], "psalter": ["Psalter", "psalter"], "proper_liturgies": ["SpecialDays", "proper_liturgies"], "prayers_and_thanksgivings": ["Misc", "prayers_and_thanksgivings"]}
PRAYER_PAGES = {"Prayers.html": "prayer", "Thanksgivings.html": "thanksgiving"}
LITURGIES = {"ashwed.html": "Ash Wednesday", "palmsunday.html": "Palm Sunday", "thursday.html": "Maundy Thursday", "friday.html": "Good Friday", "saturday.html": "Holy Saturday", "EasterVigil.html": "The Great Vigil of Easter"}
SPEAKERS = ["rubric", "rubrictable", "vrpeople"]
TITLED_OFFICES = ["great_litany", "compline", "noonday", "evening_prayer"]
COLLECT_HEADING = r"(?i)^(A Collect\b|The Collect\b|The General Thanksgiving|A Prayer of\b|Prayer of\b)"
KNOWN_HEADING = r"^(Festivals of Saints|The Collect of the Day)\b"
LONGEST_HEADING, SHORTEST_BODY, LOOKED_AHEAD, SENTENCE_AHEAD = 80, 50, 7, 3

#: What a parser reads of elements.
READ = {"collects": ["tag", "id", "classes", "text", "raw", "apart", "strong"], "daily_office": ["tag", "id", "classes", "spaced", "raw", "apart", "strong"], "proper_liturgies": ["tag", "id", "classes", "style", "spaced", "raw", "apart", "strong", "psalm", "rows"]}

#: The columns of all units, in order. at and part: where a unit stands in its page.
UNIT = ["parser", "page", "at", "part", "source_id", "source_uri", "title", "body", "category", "genre", "language_register", "office", "office_position", "canonical_id", "raw_metadata", "embed_text", "error"]


def _has(*names: str) -> Column:
    return F.arrays_overlap("classes", F.array(*map(F.lit, names)))


def _is(*tags: str) -> Column:
    return F.col("tag").isin(*tags)


def _page_number(c: Column, digits: str = "2,4") -> Column:
    return F.regexp_extract(c, rf"(?U)\b(\d{{{digits}}})\b", 1).try_cast("int")


def _in_order(what: Column, when: Column, *order: str) -> Column:
    """The values where `when` holds, in the order of the rows."""
    return F.transform(F.sort_array(F.collect_list(F.when(when, F.struct(*order, what.alias("_x"))))), lambda x: x["_x"])


def _metadata(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _file(c: str) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def elements(pages: DataFrame, parser: str | None = None) -> DataFrame:
    """page, at, the element's fields (of a parser, those that it reads), error: a row for each element of pages (page, html),
    one with an error for each page that can't be read."""
    return page_elements(pages, ["page"], parser and READ[parser])


def collects(rows: DataFrame) -> DataFrame:
    """Collects of elements: page, at, feast_slug, feast_name, rite, section, body_text, rubrics, preface, source_anchor,
    page_number, canonical_id, raw_metadata.

    A paragraph with <strong> begins a collect. Its first paragraph is its body, and so is what follows, until one says Amen;
    a paragraph that begins with Preface is the preface then, or where it follows the body. Rubrics go along. A collect
    without a name or a body is left out.
    """
    p, text = _is("p"), F.col("text")
    mark = p & _has("rightfoot", "leftfoot")
    plain = p & (text != "")
    role = F.when(mark, "page").when(p & _has("topmenu"), None).when(p & _has("rubric"), F.when(text != "", "rubric")).when(p & _has("small", "x-small"), None).when(p & F.col("strong").isNotNull(), "heading").when(plain & F.contains("raw", F.lit("Amen")), "amen").when(plain & F.startswith("text", F.lit("Preface ")), "preface").when(plain, "text")
    told = rows.filter("at IS NOT NULL").withColumn("role", role).withColumn("number", F.when(F.col("role") == "page", _page_number(F.col("apart"))))
    is_role = lambda *names: F.coalesce(F.col("role").isin(*names), F.lit(False))
    first = is_role("heading")
    # a page's elements come from one row, so that a page is bounded
    seen = carried_within(told, "page", "at", last={"page_before": F.col("number")}, total={"unit": first.cast("int")})
    before = Window.partitionBy("page", "unit").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    spoken, preface = is_role("amen", "preface", "text"), is_role("preface")
    seen = seen.withColumn("begun", F.coalesce(F.max(spoken).over(before), F.lit(False)))
    # a body is whole after an Amen, or after a preface that isn't its first paragraph
    seen = seen.withColumn("whole", F.coalesce(F.max(is_role("amen") | preface & F.col("begun")).over(before), F.lit(False)))
    is_preface = spoken & F.startswith("text", F.lit("Preface ")) & (F.col("whole") | F.col("begun") & preface)
    is_body = spoken & ~is_preface
    units = seen.filter("unit > 0").groupBy("page", "unit").agg(
        F.min("at").alias("at"),
        F.max(F.when(first, F.regexp_replace("strong", r"(?U)^\d+\.\s+", ""))).alias("feast_name"),
        F.max(F.when(first, F.col("id"))).alias("source_anchor"),
        F.coalesce(F.max(F.when(first, F.col("page_before"))), F.min_by("number", F.when(F.col("number").isNotNull(), F.col("at")))).alias("page_number"),
        F.array_join(_in_order(text, is_body, "at"), " ").alias("body_text"),
        _in_order(text, is_role("rubric"), "at").alias("rubrics"),
        F.min_by("text", F.when(is_preface, F.col("at"))).alias("preface"),
    )
    where = liturgy.page_collects(F.col("page"))
    made = units.filter("feast_name <> '' AND body_text <> ''").withColumn("feast_slug", F.concat(ascii_slug(F.col("feast_name")), F.lit(f"_{TRADITION}"))).withColumn("w", where).select("*", "w.rite", "w.section")
    fields = ["section", "rite", "page_number", "source_anchor", _file("page").alias("source_file")]
    return made.select("page", "at", "feast_slug", "feast_name", "rite", "section", "body_text", "rubrics", "preface", "source_anchor", "page_number", F.concat_ws("_", "section", "feast_slug").alias("canonical_id"), _metadata(*fields).alias("raw_metadata"))


def _titled(c: Column) -> Column:
    """Each run of letters with a capital and small letters after it."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)")), lambda x: F.initcap(x)), "")


def offices(rows: DataFrame, marked: str | None = None) -> DataFrame:
    """Units of offices' elements: page, at, slug, name, rite, office, kind, body_text, rubrics, season, source_anchor,
    page_number, raw_metadata.

    Units begin at paragraphs with <strong> or an id, at tables with an id or a heading, at titles (of some offices), and at
    short lines that name a collect where a paragraph of some length comes within the next seven elements. An opening
    sentence is a unit of its own: a season's name with the sentence behind it, or with the next paragraph of the three
    elements after it, which then says nothing else. What follows such a unit belongs to none.

    marked: a class, for books that mark their opening sentences and names of collects; paragraphs without it are text then,
    whatever they begin with.
    """
    own_mark = F.lit(True) if marked is None else _has(marked)
    office = liturgy.page_office(F.col("page"))
    spaced = F.col("spaced")
    p, table = _is("p"), _is("table")
    mark, skipped = p & _has("rightfoot", "leftfoot"), _is("hr", "br") | p & _has("topmenu", "small", "x-small", "smaller")
    silent = skipped | mark | p & _has("rubric")
    named_id = F.coalesce(F.col("id") != "", F.lit(False))
    told = rows.filter("at IS NOT NULL").withColumn("o", office).select("*", "o.office", "o.rite").drop("o")
    kind = F.when(mark, "page").when(skipped, None).when(_is("h1"), F.when((spaced != "") & F.col("office").isin(TITLED_OFFICES), "title")).when(_is("h2", "h3", "h4"), F.when((spaced != "") & (F.col("office") == "great_litany"), "title"))
    kind = kind.when(p & _has("rubric"), F.when(spaced != "", "rubric")).when(table & named_id, "table").when(table & _has("gentable") & F.col("strong").isNotNull(), "headed").when(table, F.when(spaced != "", "text"))
    kind = kind.when(p & F.col("strong").isNotNull(), "strong").when(p & named_id, F.when(spaced != "", "anchor")).when(p & (spaced != ""), F.when(own_mark & liturgy.season_named(spaced).isNotNull(), "season").otherwise("text"))
    # a page's elements come from one row, so that a page is bounded
    ahead = lambda n: Window.partitionBy("page").orderBy("at").rowsBetween(1, n)
    sentence = F.when(~silent, F.struct(F.when(p, 1).otherwise(2).alias("code"), "at", "spaced"))
    passage = F.when(~silent & ~(p & (F.length("spaced") < SHORTEST_BODY)), F.when(p, 1).otherwise(2))
    told = told.withColumns({"kind": kind, "next": F.first(sentence, ignorenulls=True).over(ahead(SENTENCE_AHEAD)), "passage": F.first(passage, ignorenulls=True).over(ahead(LOOKED_AHEAD))})
    heading = own_mark & (F.length("spaced") <= LONGEST_HEADING) & (F.regexp_like("spaced", F.lit(COLLECT_HEADING)) | F.regexp_like("spaced", F.lit(KNOWN_HEADING))) & (F.col("passage") == 1)
    told = told.withColumn("kind", F.when((F.col("kind") == "text") & p & F.coalesce(heading, F.lit(False)), "collect").otherwise(F.col("kind")))
    season = liturgy.season_named(spaced)
    told = told.withColumn("season", F.when(F.col("kind") == "season", season)).withColumn("said", F.when(F.col("kind") == "season", strip(F.substring(spaced, F.length(season) + 1, F.length(spaced)))))
    # the place of the paragraph that a lone season's name takes; one that is taken itself takes none, so that of names which
    # take each other every second one does
    told = told.withColumn("takes", F.when((F.col("said") == "") & (F.col("next.code") == 1), F.col("next.at")))
    before = Window.partitionBy("page").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("linked", F.coalesce(F.last("takes", ignorenulls=True).over(before) == F.col("at"), F.lit(False)))
    told = carried_within(told, "page", "at", total={"taking": F.col("takes").isNotNull().cast("int")})
    told = carried_within(told, "page", "at", last={"chain": F.when(F.col("takes").isNotNull() & ~F.col("linked"), F.col("taking"))})
    told = told.withColumn("takes", F.when((F.col("taking") - F.col("chain")) % 2 == 0, F.col("takes")))
    told = told.withColumn("said_to", F.last("takes", ignorenulls=True).over(before)).filter(F.col("said_to").isNull() | (F.col("said_to") < F.col("at")))
    opens = F.coalesce(F.col("kind").isin("title", "table", "headed", "strong", "anchor", "season", "collect"), F.lit(False))
    number = F.when(F.col("kind") == "page", _page_number(F.col("apart")))
    seen = carried_within(told.withColumn("number", number), "page", "at", last={"page_before": F.col("number")}, total={"unit": opens.cast("int")}).filter("unit > 0")
    strong = F.coalesce(given(F.when(F.regexp_like("strong", F.lit(r"(?U)^\d+$")), liturgy.numbered_heading(F.col("raw"))).otherwise(F.col("strong"))), spaced)
    name = F.when(F.col("kind") == "strong", strong).when(F.col("kind") == "table", _titled(F.translate("id", "_-", "  "))).when(F.col("kind") == "headed", F.col("strong")).when(F.col("kind") == "season", F.concat(F.lit("Opening Sentence ("), F.col("season"), F.lit(")"))).otherwise(spaced)
    rest = F.when(F.contains(spaced, F.col("strong")), strip(F.substring(spaced, F.length("strong") + 1, F.length(spaced)))).otherwise(spaced)
    own = F.when(F.col("kind") == "table", spaced).when(F.col("kind") == "headed", rest).when(F.col("kind") == "season", F.when(F.col("said") != "", F.col("said")).otherwise(F.when(F.col("next.code") == 1, F.col("next.spaced")))).when(F.col("kind") == "text", spaced)
    single = F.max(F.col("kind") == "season")
    units = seen.withColumn("name", F.when(opens, name)).withColumn("own", given(own)).groupBy("page", "unit", "office", "rite").agg(
        F.min("at").alias("at"),
        F.max("name").alias("name"),
        F.max("season").alias("season"),
        F.max(F.when(opens & F.col("kind").isin("table", "strong", "anchor"), F.col("id"))).alias("source_anchor"),
        F.coalesce(F.max(F.when(opens, F.col("page_before"))), F.when(~single, F.min_by("number", F.when(F.col("number").isNotNull(), F.col("at"))))).alias("page_number"),
        F.coalesce(F.when(single, F.max(F.when(opens, F.col("own")))).otherwise(F.array_join(_in_order(F.col("own"), F.col("own").isNotNull(), "at"), " ")), F.lit("")).alias("body_text"),
        F.when(single, F.array().cast("array<string>")).otherwise(_in_order(spaced, F.col("kind") == "rubric", "at")).alias("rubrics"),
    )
    made = units.filter("name <> ''").withColumn("kind", liturgy.unit_kind(F.col("name"), F.col("body_text"))).withColumn("slug", F.concat(ascii_slug(F.col("name")), F.lit(f"_{TRADITION}")))
    fields = ["office", "rite", "page_number", "source_anchor", F.col("page").alias("source_file")]
    metadata = F.when(F.col("season").isNull(), _metadata(*fields)).otherwise(_metadata(*fields, "season"))
    return made.select("page", "at", "slug", "name", "rite", "office", "kind", "body_text", "rubrics", "season", "source_anchor", "page_number", metadata.alias("raw_metadata"))


def proper_liturgies(rows: DataFrame) -> DataFrame:
    """Units of the proper liturgies' elements: page, at, part, slug, name, liturgy_name, liturgy_slug, kind, body_text, section,
    speaker, psalm_number, verse_number, is_optional, source_anchor, page_number, raw_metadata.

    Headings and paragraphs with <strong> name the section that follows; tables are psalms (a unit for each verse), dialogues
    (one for each line that is spoken) or text; other paragraphs are text, rubrics or optional blocks. Pages of no known
    liturgy have no units.
    """
    spaced, p, table = F.col("spaced"), _is("p"), _is("table")
    heads = _is("h1", "h2", "h3", "h4")
    told = rows.filter("at IS NOT NULL").withColumn("liturgy_name", liturgy.looked_up(_file("page"), LITURGIES)).filter("liturgy_name IS NOT NULL")
    cells = F.flatten("rows")
    verses = F.exists(cells, lambda c: F.array_contains(c["classes"], "vsnum"))
    speaks = _has("vrtable") | F.exists(cells, lambda c: F.arrays_overlap(c["classes"], F.array(*map(F.lit, SPEAKERS))))
    kind = F.when(p & _has("rightfoot", "leftfoot"), "page").when(p & _has("small", "x-small", "smaller", "topmenu"), None).when(heads, F.when(spaced != "", "head")).when(p & _has("rubric"), "rubric").when(p & F.contains(F.coalesce("style", F.lit("")), F.lit("border-left")), "optional").when(p & F.col("strong").isNotNull(), F.when(F.col("strong") != "", "strong")).when(table & verses, "psalm").when(table & speaks, "dialogue").when(p | table, "text")
    heading = F.when(F.col("tag") == "h1", F.col("liturgy_name")).otherwise(strip(F.regexp_replace("raw", r"(?U)\s+", " ")))
    section = F.when(F.col("kind") == "head", heading).when(F.col("kind") == "strong", F.col("strong"))
    number = F.regexp_extract("psalm", r"(\d+)", 1).try_cast("int")
    last = {"named": section, "page_number": F.when(F.col("kind") == "page", _page_number(F.col("apart"))), "psalm_seen": F.when(F.col("kind") == "psalm", number)}
    seen = carried_within(told.withColumn("kind", kind), "page", "at", last=last).withColumn("section", F.coalesce("named", "liturgy_name"))
    under = lambda what: F.concat(what, F.lit(" ("), F.col("section"), F.lit(")"))
    none = F.lit(None).cast("string")

    def unit(name: Column, kind: str, body: Column, speaker: Column = none, verse: Column | None = None, optional: bool = False, anchor: Column = none) -> Column:
        return F.struct(name.alias("name"), F.lit(kind).alias("kind"), body.alias("body_text"), speaker.alias("speaker"), (F.lit(None).cast("int") if verse is None else verse).alias("verse_number"), F.lit(optional).alias("is_optional"), anchor.alias("source_anchor"))

    def verse_of(row: Column) -> Column:
        cell = lambda good: F.get(F.filter(row, good), F.lit(0))
        own = F.regexp_replace(cell(lambda c: F.array_contains(c["classes"], "vsnum"))["told"], " ", "")
        n = F.when(F.regexp_like(own, F.lit("^[0-9]+$")), own.try_cast("int"))
        number = F.coalesce(F.col("psalm_seen").cast("string"), F.lit("?"))
        return F.when(n.isNotNull(), unit(F.concat(F.lit("Psalm "), number, F.lit(" verse "), n.cast("string")), "psalm-verse", cell(lambda c: ~F.array_contains(c["classes"], "vsnum"))["lines"], verse=n))

    def line_of(row: Column) -> Column:
        who = F.coalesce(given(F.get(row, F.lit(0))["told"]), F.lit("All"))
        return F.when(F.size(row) >= 2, unit(under(who), "speaker-line", F.get(row, F.lit(1))["text"], speaker=who))

    one = lambda *args, **more: F.array(unit(*args, **more))
    is_kind = lambda name: F.col("kind") == name
    made = F.when(is_kind("head") & (F.col("tag") != "h1") & (F.coalesce("id", F.lit("")) != ""), one(F.col("section"), "rubric", F.col("section"), anchor=F.col("id")))
    made = made.when(is_kind("strong"), one(F.col("strong"), "rubric", F.col("strong"))).when(is_kind("rubric"), one(under(F.lit("Rubric")), "rubric", spaced)).when(is_kind("optional"), one(under(F.lit("Optional Block")), "prayer-body", spaced, optional=True))
    made = made.when(is_kind("psalm"), F.transform("rows", verse_of)).when(is_kind("dialogue"), F.transform("rows", line_of)).when(is_kind("text"), one(under(F.lit("Text")), "prayer-body", spaced))
    units = seen.select("page", "at", "liturgy_name", "section", "page_number", "psalm_seen", F.posexplode(made).alias("part", "u")).select("*", "u.*").drop("u").filter("trim(body_text) <> ''")
    slug = lambda c: F.concat(ascii_slug(c), F.lit(f"_{TRADITION}"))
    units = units.withColumn("slug", slug(F.col("name"))).withColumn("liturgy_slug", slug(F.col("liturgy_name"))).withColumn("psalm_number", F.when(is_kind("psalm-verse"), F.col("psalm_seen")))
    fields = ["liturgy_name", "liturgy_slug", "section", "kind", _file("page").alias("source_file"), "page_number", "speaker", "psalm_number", "verse_number", "is_optional"]
    metadata = F.when(F.col("source_anchor").isNull(), _metadata(*fields)).otherwise(_metadata(*fields, "source_anchor"))
    return units.select("page", "at", "part", "slug", "name", "liturgy_name", "liturgy_slug", "kind", "body_text", "section", "speaker", "psalm_number", "verse_number", "is_optional", "source_anchor", "page_number", metadata.alias("raw_metadata"))


def text_events(pages: DataFrame) -> DataFrame:
    """book, page, seq, at, the event's kind, text and number, error: a row for each event of pages (book, seq: the page's place
    in the book, page, html), and one with an error for each page that can't be read. Kept in the shared folder, so that pages
    are read once."""
    return checkpointed(page_events(pages, ["book", "seq", "page"]))


def prayers(events: DataFrame, genre: Column) -> DataFrame:
    """Numbered texts of books' events: book, page, at, slug, title, prayer_number, section_header, body_text, rubrics, genre,
    source_anchor, page_number, raw_metadata.

    A text goes on over the pages of its book until the next one begins, and so do a section's heading and a page's number;
    the page and place are those of its start. A text without a title or a body is left out, and so are references to other
    texts. genre: prayer or thanksgiving, of the book.
    """
    heading = lambda i: F.regexp_extract("text", r"(?s)^(\d+)\. (.*)$", i)
    starts = F.coalesce((F.col("kind") == "start") & (heading(1) != ""), F.lit(False))
    number = F.when(F.col("kind") == "page", _page_number(F.col("text"), "3,4"))
    told = events.filter("at IS NOT NULL").withColumn("starts", starts).withColumn("marked", number).withColumn("place", F.struct("seq", "at")).withColumn("kept", ~liturgy.is_cross_reference(F.col("text")))
    # a page is a chunk of its book
    seen = carried(told, "book", "at", chunk=F.col("seq"), last={"page_before": F.col("marked"), "section": F.when(F.col("kind") == "section", F.col("text"))}, total={"unit": F.col("starts").cast("int")}).filter("unit > 0")
    first = F.col("starts")
    kept = F.col("kept")
    units = seen.groupBy("book", "unit").agg(
        F.max(F.when(first, F.col("page"))).alias("page"),
        F.max(F.when(first, F.col("at"))).alias("at"),
        F.max(F.when(first, heading(1).try_cast("int"))).alias("prayer_number"),
        F.max(F.when(first, strip(heading(2)))).alias("title"),
        F.max(F.when(first, F.col("number").cast("string"))).alias("source_anchor"),
        F.coalesce(F.max(F.when(first, F.col("section"))), F.lit("")).alias("section_header"),
        F.coalesce(F.max(F.when(first, F.col("page_before"))), F.min_by("marked", F.when(F.col("marked").isNotNull(), F.col("place")))).alias("page_number"),
        F.array_join(_in_order(F.col("text"), (F.col("kind") == "text") & kept, "place"), " ").alias("body_text"),
        _in_order(F.col("text"), (F.col("text") != "") & ((F.col("kind") == "rubric") | (F.col("kind") == "note") & kept), "place").alias("rubrics"),
    )
    made = units.withColumn("genre", genre).filter("title <> '' AND body_text <> ''")
    made = made.withColumn("body_text", F.when((F.col("genre") == "thanksgiving") & (F.col("prayer_number") == 1), F.regexp_replace("body_text", r"^\(1979 Version\)\s*", "")).otherwise(F.col("body_text")))
    made = made.withColumn("slug", liturgy.prayer_slug(F.col("title"), F.col("genre"), F.col("prayer_number")))
    fields = ["prayer_number", "section_header", "source_anchor", F.col("book").alias("source_file"), "page_number", "genre", F.lit("devotional_manual").alias("category"), F.lit(TRADITION).alias("tradition"), F.lit("bcp_1979").alias("source")]
    metadata = F.when(F.col("genre") == "thanksgiving", _metadata(*fields, F.col("prayer_number").alias("thanksgiving_number"))).otherwise(_metadata(*fields))
    return made.select("book", "page", "at", "slug", "title", "prayer_number", "section_header", "body_text", "rubrics", "genre", "source_anchor", "page_number", metadata.alias("raw_metadata"))


# The driver


def _numbered(units: DataFrame, key: str) -> Column:
    """How many units with the key come before, by page and place: counted in each page, and over pages."""
    held = units.groupBy(key, "page").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.row_number().over(Window.partitionBy(key, "page").orderBy("at", "part")) - 1
    met = units.join(held.select(key, "page", F.coalesce(before, F.lit(0)).alias("_before")), [key, "page"])
    return met.withColumn("earlier", F.col("_before") + inside).drop("_before")


def _unit(made: DataFrame, parser: str, **columns) -> DataFrame:
    """made in the form of all units; a column that isn't given is null."""
    kinds = {"at": "int", "part": "int"}
    given_ = {"parser": F.lit(parser), "page": F.col("page"), "at": F.col("at"), "part": F.lit(0), **{k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}}
    return made.select(*(given_.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in UNIT))


def units(pages: DataFrame, parsers: list[str] | None = None) -> DataFrame:
    """Units of landed pages (path, html), in one form (UNIT), by the parser that the path's folder names; and a row with an
    error for each page that couldn't be read. Pages of other folders, and pages of contents, have none."""
    wanted = parsers or list(FOLDERS)
    if unknown := [x for x in wanted if x not in FOLDERS]:
        raise ValueError(f"unknown parsers: {unknown}")
    named = pages.select(F.col("path").alias("page"), "html")
    text = lambda c: F.lit(c)
    out = []
    for parser in wanted:
        folder = F.regexp_extract("page", r"^(.*)/[^/]*$", 1)
        own = named.filter(reduce(lambda a, b: a | b, ((folder == f) | F.endswith(folder, F.lit(f"/{f}")) for f in FOLDERS[parser])))
        own = own.filter(~liturgy.is_contents_page(F.col("page"), F.coalesce("html", F.lit("")))) if parser in ("collects", "daily_office") else own
        if parser == "prayers_and_thanksgivings":
            books = own.filter(_file("page").isin(*PRAYER_PAGES)).select(F.col("page").alias("book"), F.lit(0).alias("seq"), "page", "html")
            rows = text_events(books)
            made = prayers(rows, liturgy.looked_up(_file("book"), PRAYER_PAGES))
            out.append(_unit(made, parser, source_id="slug", source_uri=F.concat(text("bcp1979://prayers_and_thanksgivings/"), "slug"), title="title", body="body_text", category=text("devotional_manual"), genre="genre", canonical_id="slug", raw_metadata="raw_metadata", embed_text=liturgy.prayer_text(F.col("title"), F.col("genre"), F.col("section_header"), F.col("body_text"))))
        else:
            rows = checkpointed(elements(own, parser if parser in READ else None))
            if parser == "collects":
                made = collects(rows)
                out.append(_unit(made, parser, source_id=F.concat_ws("__", "feast_slug", "rite"), source_uri=F.concat(text("bcp1979://collects/"), "section", text("/"), "feast_slug"), title="feast_name", body="body_text", category=text("liturgical_proper"), genre=text("collect"), language_register=liturgy.register(F.col("rite")), canonical_id="canonical_id", raw_metadata="raw_metadata", embed_text=liturgy.collect_text(F.col("feast_name"), F.col("rite"), F.col("section"), F.col("body_text"))))
            elif parser == "daily_office":
                made = offices(rows)
                rite = F.when(~F.col("rite").isin("none", "both"), F.col("rite"))
                out.append(_unit(made, parser, source_id=F.concat_ws("__", "slug", rite), source_uri=F.concat(text("bcp1979://daily_office/"), "office", text("/"), "slug"), title="name", body="body_text", category=text("liturgical_proper"), genre="kind", language_register=liturgy.register(F.col("rite")), office=liturgy.stored_office(F.col("office")), canonical_id="slug", raw_metadata="raw_metadata", embed_text=liturgy.daily_office_text(F.col("name"), F.col("kind"), F.col("office"), F.col("rite"), F.col("body_text"))))
            elif parser == "proper_liturgies":
                made = _numbered(proper_liturgies(rows).withColumn("key", F.concat_ws("__", "liturgy_slug", "slug")), "key")
                genre = F.translate("kind", "-", "_")
                own_id = F.when(F.col("earlier") > 0, F.concat_ws("__", "key", F.col("earlier").cast("string"))).otherwise(F.col("key"))
                out.append(_unit(made, parser, part="part", source_id=own_id, source_uri=F.concat(text("bcp1979://proper_liturgies/"), "liturgy_slug", text("/"), "slug"), title="name", body="body_text", category=text("liturgical_proper"), genre=genre, office_position=given(F.col("section")), canonical_id="slug", raw_metadata="raw_metadata", embed_text=liturgy.proper_liturgy_text(F.col("name"), genre, F.col("liturgy_name"), F.col("section"), F.col("body_text"))))
            else:
                found = psalter.psalms(own)
                docs = found.withColumn("body", liturgy.psalm_body(F.col("verses"), F.col("headings"))).filter(strip(F.col("body")) != "")
                metadata = F.to_json(F.struct("book", "number", _file("page").alias("source_file"), "latin_incipit"))
                out.append(_unit(docs, parser, at=F.col("number"), source_id="slug", source_uri=F.concat(text("bcp1979://psalter/"), "slug"), title="title", body="body", category=text("psalter"), genre=text("psalm"), canonical_id="slug", raw_metadata=metadata, embed_text=liturgy.psalm_text(F.col("number"), F.col("title"), F.col("latin_incipit"), F.col("body"))))
        out.append(_unit(rows.filter("error IS NOT NULL"), parser, error="error"))
    return reduce(DataFrame.unionByName, out)


def ingested(stored: DataFrame, pages: DataFrame, parsers: list[str] | None = None) -> tuple[DataFrame, dict]:
    """The units of pages with action (insert, skip, error) and content_hash, and the counts of actions.

    stored: source_id, content_hash of the documents that there are. Of units with one source_id the first is inserted, by
    parser, page and place, unless it is stored; the others are skipped. A content hash that a stored document or an earlier
    unit has is null. The rows are in the shared folder, and counted while they are written.
    """
    # every unit is met with the stored ones and with all others: written once, parsing is no part of those plans
    every = checkpointed(units(pages, parsers))
    stored = checkpointed(stored.select("source_id", "content_hash"))
    rank = F.array_position(F.array(*map(F.lit, parsers or list(FOLDERS))), F.col("parser"))
    order = F.struct(rank.alias("parser"), "page", "at", "part")
    told = every.withColumn("order", order).withColumn("content_hash", F.when(F.col("error").isNull(), content_hash(F.col("body"))))
    firsts = told.filter("error IS NULL").groupBy("source_id").agg(F.min("order").alias("first")).join(stored.select("source_id").distinct(), "source_id", "left_anti")
    met = told.join(firsts, "source_id", "left")
    met = met.withColumn("action", F.when(F.col("error").isNotNull(), "error").when(F.col("order") == F.col("first"), "insert").otherwise("skip"))
    new = met.filter("action = 'insert'").groupBy("content_hash").agg(F.min("order").alias("holder")).join(stored.select("content_hash").filter("content_hash IS NOT NULL").distinct(), "content_hash", "left_anti")
    met = met.join(new, "content_hash", "left").withColumn("content_hash", F.when(F.col("order") == F.col("holder"), F.col("content_hash")))
    seen = Observation()
    counts = [F.count(F.when(F.col("action") == a, 1)).alias(a) for a in ("insert", "skip", "error")]
    done = checkpointed(met.select(*UNIT, "action", "content_hash").observe(seen, *counts))
    return done, seen.get
