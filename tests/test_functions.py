"""Scalar functions on hand-made values."""

import datetime as dt
import html as entities
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates, html, text
from quillspark.functions import json as js


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column.alias("out")).first()["out"]


TEXT_CASES = [
    (text.strip, "  a b  \n", "a b"),
    (text.words, " a b\tc ", ["a", "b", "c"]),
    (text.words, "  ", []),
    (text.paragraphs, "a\n\n\n b\nc \n\n \n\nd", ["a", "b\nc", "d"]),
    (text.optional, "  ", None),
    (text.url_slug, "  Hello, World! --", "hello-world"),
    (text.url_slug, "!!!", "capture"),
    (text.ascii_slug, "Saint Étienne's Day", "saint_etienne_s_day"),
    (text.yaml_scalar, 'a "b" \\c', '"a \\"b\\" \\\\c"'),
    (text.match_phrases, "Collect for Peace", ["Collect for Peace"]),
    (text.match_phrases, "An Order for Compline", ["An Order for Compline", "Compline"]),
    (text.match_phrases, "Optional Block (Ash Wednesday)", ["Optional Block (Ash Wednesday)", "Ash Wednesday"]),
    (text.match_phrases, "abc", []),
    (text.canonical_url, "https://a.org#x", "https://a.org/"),
    (text.canonical_url, "https://a.org/p/?q=1#x", "https://a.org/p/?q=1"),
    (text.canonical_url, "ftp://a.org/", None),
    (text.canonical_url_untracked, "https://a.org/p?utm_source=x&b=2&REF=y", "https://a.org/p?b=2"),
    (text.canonical_url_untracked, "https://a.org/p?fbclid=1", "https://a.org/p"),
    (text.hostname, "https://User@WWW.A.org:80/p", "www.a.org"),
    (text.video_id, "https://youtu.be/abcdefghijk?t=1", "abcdefghijk"),
    (text.video_id, "https://www.youtube.com/watch?list=x&v=abcdefghijk", "abcdefghijk"),
    (text.video_id, "https://example.org", None),
    (text.podcast_id, "https://podcasts.apple.com/us/podcast/x/id123?i=4", "123"),
    (text.cache_path, "https://A.org/", "a.org/index.html"),
    (text.cache_path, "https://a.org/x/../y z", "a.org/x/__dot__/y_z.html"),
    (text.episode_title, "  The  Show: #3! ", "the show 3"),
    (text.match_key, "The_Show: É!", "the_show é"),
    (text.cue_text, "WEBVTT\nKind: captions\n\n1\n00:00:01.000 --> 00:00:02.000\n<b>Hi</b> there\n\n00:00:02.000 --> 00:00:03.000\nHi there\nBye", "Hi there Bye"),
    (text.cue_text, "1\n00:00:01,000 --> 00:00:02,000\nHi\n\n2\n00:00:03,000 --> 00:00:04,000\nBye", "Hi Bye"),
    (text.audiobook_title, "A Book꞉ Part_1-LC_64_22050_stereo", "A Book: Part 1"),
    (text.audiobook_title, "A Book [2001 MP3]", "A Book"),
    (text.file_label, "A_Book – X (ocr) (scan)", "A Book - X"),
    (text.metadata_value, " [Unknown  Author] ", None),
    (text.metadata_value, " A  B ", "A B"),
    (text.looks_like_author, "Jane Q. Doe", True),
    (text.looks_like_author, "Volume 3", False),
    (text.looks_like_author, "Jane", False),
    (text.name_case, "JANE VAN DOE", "Jane van Doe"),
    (text.video_title, "Some Film 1999 1080p", "Some Film"),
    (text.matcher_tokens, "The Sentences of psalm_023", ["sentences", "sentence", "psalm", "23"]),
    (text.slug_tokens, "ash_wednesday_rite-ii", ["ash", "wednesday"]),
    (text.without_code_fence, "```json\n{}\n```", "{}"),
    (text.approximate_tokens, "one two three", 4),
    (text.looks_like_asin, "B00ABC1234", True),
    (text.rate_limited, "You hit the Rate Limit", True),
    (text.transient_error, "HTTP Error 503", True),
    (text.directives, "x\n[directive, 2024-01-02] do this\n[directive] no", ["[directive, 2024-01-02] do this"]),
    (js.text_array, '["a",1,null,true,"","a"]', ["a", "a"]),
    (js.text_array, "{bad", []),
    (js.text_array, '{"k":1}', []),
    (js.payload_summary, '{"title":"","url":"u"}', "u"),
    (js.payload_summary, "{bad", ""),
    (js.year_of, "1999-01", 1999),
    (js.year_of, "x", None),
    (js.description, '{"description":{"type":"t","value":"v"}}', "v"),
    (js.description, '{"description":"d"}', "d"),
    (dates.read_date, "2024/01/02|2025/01/01", "2024-01-02"),
    (dates.duration, "1:02:03", 3723.0),
    (dates.duration, "2:03", 123.0),
    (dates.duration, "45", 45.0),
    (dates.duration, "x", 0.0),
    (dates.rating, "4.25", 4.25),
    (dates.rating, "x", None),
    (html.raw_title, "<title>\n A &amp; B</title>", "A &amp; B"),
    (html.feed_link, '<link href="/f" type="application/rss+xml">', "/f"),
]


@pytest.mark.parametrize("start", range(0, len(TEXT_CASES), 12))
def test_text(spark, start):
    """A dozen cases in one job."""
    cases = TEXT_CASES[start : start + 12]
    found = spark.range(1).select(*[function(F.lit(given)).alias(f"c{i}") for i, (function, given, _) in enumerate(cases)]).first()
    assert [(f.__name__, given, found[i]) for i, (f, given, _) in enumerate(cases)] == [(f.__name__, given, want) for f, given, want in cases]


def test_null_in_null_out(spark):
    null = F.lit(None).cast("string")
    functions = (text.strip, text.words, text.canonical_url, text.hostname, text.video_id, text.optional, dates.rating)
    assert set(spark.range(1).select(*[f(null).alias(f"c{i}") for i, f in enumerate(functions)]).first()) == {None}


def test_structs(spark):
    assert tuple(one(spark, text.author_title(F.col("x")), x="Jane Doe  - The Book [Sam West]")) == ("Jane Doe", "The Book")
    assert tuple(one(spark, text.author_title(F.col("x")), x="the book")) == (None, "the book")
    assert tuple(one(spark, text.book_label(F.col("x")), x="The Book -- JANE DOE -- 1999")) == ("The Book", "Jane Doe")
    assert tuple(one(spark, text.book_label(F.col("x")), x="Jane Doe - The Book")) == ("The Book", "Jane Doe")
    assert one(spark, text.book_label(F.col("x")), x="Nothing here") is None
    assert tuple(one(spark, text.book_metadata(F.col("f"), F.col("t"), F.col("a")), f="Jane Doe - The Book", t="Unknown", a="n/a")) == ("The Book", "Jane Doe")
    got = one(spark, text.video_name(F.col("x")), x="[Group] Some.Show.S02E05.1080p.mkv")
    assert (got.title, got.season, got.episode) == ("Some Show", 2, 5)
    got = one(spark, text.session_title(F.col("x")), x="May 18, 2026 -- Couples session")
    assert (got.date, got.suffix, got.couples) == (dt.date(2026, 5, 18), "Couples session", True)
    assert tuple(one(spark, text.post_parts(F.col("x")), x="https://b.app/profile/me.org/post/3k?x")) == ("me.org", "3k")


def test_header_goes_and_comes(spark):
    head = text.labelled_header([("Title", F.col("t")), ("Author", F.col("a"))])
    assert one(spark, head, t="T", a=" ") == "Title: T\n\n"
    assert one(spark, text.without_header(F.concat(head, F.lit("body")), ["Title", "Author"]), t="T", a="A") == "body"
    assert one(spark, text.without_header(F.col("x"), ["Title"]), x="Other: x\n\nbody") == "Other: x\n\nbody"


@pytest.mark.parametrize("kind, genre, title, want, ok", [("prose", None, "x", "bio", True), ("liturgical_unit", "prayer_body", "x", "prayer-body", True), ("liturgical_unit", "prayer", "A Collect for Peace", "collect", True), ("liturgical_unit", "collect", "x", "prayer", False), ("book", "collect", "x", "collect", False)])
def test_kind_matches(spark, kind, genre, title, want, ok):
    assert one(spark, text.kind_matches(F.col("k"), F.col("g").cast("string"), F.col("t"), F.col("w")), k=kind, g=genre, t=title, w=want) is ok


def test_easter_against_dateutil(spark):
    from dateutil.easter import easter

    years = spark.range(1700, 2200).select(F.col("id").cast("int").alias("y"))
    for r in years.select("y", dates.western_easter(F.col("y")).alias("w"), dates.orthodox_easter(F.col("y")).alias("o")).collect():
        assert (r.w, r.o) == (easter(r.y, 3), easter(r.y, 2))


def test_short_grammar(spark):
    rule = lambda r, t="anglican": one(spark, dates.fixed_or_easter_rule(F.col("r"), F.lit(2025), F.col("t")), r=r, t=t)
    assert rule("12-25") == dt.date(2025, 12, 25)
    assert rule("02-29") is None and rule("advent_1+0") is None
    assert rule("easter-46") == dt.date(2025, 3, 5)
    assert rule("easter+0", "byzantine") == dt.date(2025, 4, 20)


def test_ages(spark):
    now = F.lit("2024-01-02 00:00:10").cast("timestamp")
    assert one(spark, dates.days_since(F.col("x"), now), x="2024-01-01T23:00:00Z") == 1
    assert one(spark, dates.days_since(F.col("x"), now), x="later") is None
    assert one(spark, dates.age_seconds(F.col("x"), now), x="2024-01-02T00:00:00Z") == 10
    assert one(spark, dates.age_seconds(F.col("x"), now), x="2024-01-02 00:00:00") is None
    assert one(spark, dates.iso_to_core_data(F.col("x")), x="2001-01-01T00:00:00Z") == 0.0
    assert one(spark, dates.psalm_book(F.col("x")), x=90) == 4


def test_sunday_of_seasons(spark):
    easter = F.lit("2025-04-20").cast("date")
    yes = lambda d: one(spark, dates.sunday_of_seasons(F.col("d"), easter), d=d)
    assert [yes(dt.date(2025, *d)) for d in ((3, 9), (4, 27), (12, 7), (12, 28), (3, 10), (7, 6))] == [True, True, True, False, False, False]


def test_html(spark):
    page = '<html><head><title>x</title><script>var a="</p>"</script></head><body><nav><a href="/n">nav</a></nav><p>One &amp; two<br>three</p><iframe src="http://b.org/f#z"></iframe><a href="mailto:x">m</a></body></html>'
    df = spark.createDataFrame([(page, "http://a.org/d/")], "h string, u string")
    r = df.select(html.links("h", "u").alias("l"), html.article_text("h").alias("t"), html.unescape("h").alias("e")).first()
    assert r.l == ["http://a.org/n", "http://b.org/f"]
    assert r.t.splitlines()[-3:] == ["One & two", "three", "m"] and "nav" not in r.t
    assert r.e == entities.unescape(page)


def test_slug_matches_plain_python(spark):
    def plain(x):
        x = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower()
        return re.sub("[^a-z0-9]+", "_", x).strip("_")

    for x in ("Ünïcödé Näme", "O'Brien, Flann", "--a--", "Ñandú 3"):
        assert one(spark, text.ascii_slug(F.col("x")), x=x) == plain(x)


def test_references_to_characters_are_whole(spark):
    """What a cut has left of a reference is text, in titles and in articles."""
    page = "<title>A &amp; B &lt;i&gt; &#65;&#x27; C &amp;lt; D &amp</title><body><p>A &amp; B &nosuch; &AMP C&copy D &amp</p></body>"
    r = spark.createDataFrame([(page,)], "h string").select(html.unescape(html.raw_title(F.col("h"))).alias("t"), html.article_text("h").alias("a")).first()
    assert r.t == "A & B <i> A' C &lt; D &amp"
    assert r.a.splitlines()[-1] == "A & B &nosuch; &AMP C&copy D &amp"
