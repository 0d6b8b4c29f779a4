"""Operators of the engine on hand-made frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import blocks, dates
from quillspark.operators import calendar, chunks, contracts, corrections, dedupe, jobs, matching, search, threads
from quillspark.sources import adapters, readers, sinks
from quillspark.streaming import events as streams

from .feasts import feasts


def test_filter_before_ranking(spark):
    """Many near vectors of one type don't hide the few far ones that the filter asks for."""
    near = [(i, "book", [1.0, 0.01 * i]) for i in range(20)]
    far = [(100 + i, "unit", [-1.0, 0.5 + i]) for i in range(2)]
    v = spark.createDataFrame(near + far, "chunk_id int, kind string, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    found = search.nearest(search.restricted(v, v.filter("kind = 'unit'"), "chunk_id"), q, 3, "chunk_id").collect()
    assert [r.chunk_id for r in found] == [101, 100] or sorted(r.chunk_id for r in found) == [100, 101]


def test_zero_and_opposite_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [-1.0, 0.0]), (3, [2.0, 0.0]), (4, [2.0, 0.0])], "id int, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    found = search.nearest(v, q, 10, "id")
    assert [r.id for r in found.collect()] == [3, 4, 2]
    assert [(r.id, r.similarity) for r in search.over_floor(found, 0.0).orderBy("id").collect()] == [(2, 0.0), (3, 1.0), (4, 1.0)]
    assert search.clamp(0) == 1 and search.clamp(99) == 50


def test_dates_and_like(spark):
    df = spark.createDataFrame([("2024-01-31T10:00:00Z", "The Book"), ("2024-02-01T00:00:00Z", "x")], "c string, s string")
    assert df.filter(search.between_dates(F.col("c"), None, "2024-01-31")).count() == 1
    assert df.filter(search.like_pattern(F.col("s"), "b__k")).count() == 1


def test_title_matches(spark):
    docs = spark.createDataFrame([(1, "An Order for Compline"), (2, "Collect for Peace"), (3, "Psalm 23"), (4, "abc")], "id int, title string")
    seeds = spark.createDataFrame([(1, "we said compline, in peace, and PSALM 23 too"), (2, "psalm 234")], "seed_id int, seed string")
    assert [(r.seed_id, r.id, r["rank"]) for r in search.title_matches(docs, seeds).orderBy("seed_id", "rank").collect()] == [(1, 1, 1), (1, 3, 2)]
    odd = spark.createDataFrame([(1, "????"), (2, "Peace Peace"), (3, "No such words"), (4, None), (5, "In Peace, and")], "id int, title string")
    more = spark.createDataFrame([(1, "so????what"), (2, "peace peace in peace, and such words"), (3, None), (4, "")], "seed_id int, seed string")
    assert [(r.seed_id, r.id) for r in search.title_matches(odd, more).orderBy("seed_id", "rank").collect()] == [(1, 1), (2, 5), (2, 2)]
    assert search.title_matches(odd.limit(0), more).count() == 0 and search.title_matches(odd, more.limit(0)).count() == 0


def test_two_key_first_wins(spark):
    rows = spark.createDataFrame([(1, "h1", "s1"), (2, "h1", "s2"), (3, "h2", "s2"), (4, None, "s9"), (5, None, None), (6, "h2", "s7"), (7, None, "s9")], "id int, h string, s string")
    assert sorted(r.id for r in dedupe.two_key_first_wins(rows, "id", "h", "s").collect()) == [1, 3, 4, 5]


def test_upserts(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, h string")
    rows = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k int, h string")
    assert {r.k: r.action for r in dedupe.upsert_actions(stored, rows, "k", "h").collect()} == {1: "skip", 2: "update", 3: "insert"}
    assert sorted(r.k for r in dedupe.insert_ignore(stored, rows.withColumn("k", F.col("k") + 1), ["k"], "h").collect()) == [1, 2, 3, 4]


def test_fuzzy_best(spark):
    wanted = spark.createDataFrame([(1, "The Great Big Book", "Jane Doe"), (2, "Nothing like it", None)], "wanted_id int, title string, author string")
    stored = spark.createDataFrame([(10, "Great Big Book, The", "J. Smith"), (11, "the great big book!", "jane doe"), (12, "a big book", None)], "id int, title string, author string")
    assert [(r.wanted_id, r.id, r.score) for r in dedupe.fuzzy_best(wanted, stored).collect()] == [(1, 11, 1.0)]


def test_greedy_distinct(spark):
    rows = spark.createDataFrame([(1, 1, "a b c d"), (1, 2, "A B C D"), (1, 3, " "), (1, 4, "x y"), (2, 1, "a b c d")], "g int, o int, t string")
    assert sorted((r.g, r.o) for r in dedupe.greedy_distinct(rows, "g", "o", "t").collect()) == [(1, 1), (1, 4), (2, 1)]


def test_chunker(spark):
    p = lambda n, w="w": " ".join(f"{w}{i}" for i in range(n))
    cases = [None, "  ", p(399) + "\n\n" + p(10), p(400) + "\n\n" + p(10), p(300) + "\n\n" + p(1201), p(1500), p(1501), p(1501) + "\n\n" + p(5)]
    native = spark.createDataFrame(list(enumerate(cases)), "id int, t string")
    got = {r.id: [(c.token_count, c.text) for c in r.c] for r in native.select("id", chunks.chunks(F.col("t")).alias("c")).collect()}
    assert [[n for n, _ in got[i]] for i in range(8)] == [[], [], [409], [400, 10], [300, 1201], [1500], [512, 512, 512, 157], [512, 512, 512, 162]]
    udf = chunks.chunks_by(str.split, " ".join)
    by = {r.id: [(c.token_count, c.text) for c in r.c] for r in native.select("id", udf("t").alias("c")).collect()}
    assert got == by


def test_transfers(spark):
    years = spark.createDataFrame([(2025,), (2026,)], "year int")
    found = {(r.year, r.primary_name): (r.day, r.transferred) for r in calendar.year_calendar(feasts(spark), years).collect() if r.tradition == "anglican"}
    assert found[2025, "Saint Mark"] == (dt.date(2025, 4, 28), True)
    assert found[2026, "Easter Day"] == (dt.date(2026, 4, 5), False)
    assert found[2026, "Ash Wednesday"] == (dt.date(2026, 2, 18), False)
    assert found[2026, "Twin"] == (dt.date(2026, 3, 16), True)  # the 15th is a Sunday
    assert (2026, "Vincent") not in found and (2025, "Leap Day") not in found


def test_easters_and_rules(spark):
    """Both Easters of two centuries, and every form of rule in a century, counted out day by day."""

    def easters(y):
        b, c = divmod(y, 100)
        h = (19 * (y % 19) + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
        el = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
        m = h + el - 7 * ((y % 19 + 11 * h + 22 * el) // 451) + 114
        d = (19 * (y % 19) + 15) % 30
        j = d + (2 * (y % 4) + 4 * (y % 7) - d + 34) % 7 + 114
        return dt.date(y, m // 31, m % 31 + 1), dt.date(y, j // 31, j % 31 + 1) + dt.timedelta(13)

    found = spark.range(1900, 2100).selectExpr("CAST(id AS INT) AS y").select("y", dates.western_easter(F.col("y")).alias("w"), dates.orthodox_easter(F.col("y")).alias("o"))
    assert all((r.w, r.o) == easters(r.y) for r in found.collect())

    def first(y, month, day, weekday, after=0):
        d = dt.date(y, month, day) + dt.timedelta(after)
        return d + dt.timedelta((weekday - d.weekday()) % 7)

    want = {
        "easter-46": lambda y: easters(y)[0] - dt.timedelta(46), "easter+39": lambda y: easters(y)[0] + dt.timedelta(39), "advent_1+7": lambda y: first(y, 11, 27, 6) + dt.timedelta(7), "sunday_on_or_after_11-27": lambda y: first(y, 11, 27, 6),
        "first_sunday_after_01-06": lambda y: first(y, 1, 6, 6, 1), "wednesday_after_09-14": lambda y: first(y, 9, 14, 2, 1), "friday_on_or_after_12-13": lambda y: first(y, 12, 13, 4), "fourth_thursday_of_november": lambda y: first(y, 11, 1, 3) + dt.timedelta(21),
        "fifth_sunday_of_february": lambda y: first(y, 2, 1, 6) + dt.timedelta(28), "last_monday_of_may": lambda y: None, "sunday_on_or_after_02-30": lambda y: None, "02-29": lambda y: None, "someday_after_01-01": lambda y: None, "": lambda y: None,
    }
    rules = spark.createDataFrame([(r, "anglican") for r in want], "rule string, tradition string").crossJoin(spark.range(2000, 2101).selectExpr("CAST(id AS INT) AS year"))
    rows = calendar.resolved(rules).collect()
    assert len(rows) == len(want) * 101 and all(r.day == want[r.rule](r.year) for r in rows)
    by_column = rules.select("rule", "year", dates.movable_rule(F.col("rule"), F.col("year"), dates.western_easter(F.col("year"))).alias("day")).filter("year < 2003").collect()
    assert all(r.day == want[r.rule](r.year) for r in by_column)


def test_days_and_ranges(spark):
    f = feasts(spark)
    days = spark.createDataFrame([(dt.date(2024, 11, 1),), (dt.date(2024, 4, 25),), (dt.date(2024, 3, 31),), (dt.date(2024, 2, 14),), (dt.date(2024, 2, 14),), (None,)], "day date")
    assert sorted((r.id, r.day.isoformat()) for r in calendar.on_days(f, days, "anglican").collect()) == [(2, "2024-03-31"), (3, "2024-02-14"), (4, "2024-04-25"), (9, "2024-11-01")]
    day = F.lit("2025-04-20").cast("date")
    assert [r.primary_name for r in calendar.on_day(f, day, "anglican").collect()] == ["Easter Day"]
    found = calendar.in_range(f, F.lit(2025), F.lit("2025-04-01").cast("date"), F.lit("2025-04-30").cast("date"))
    assert sorted(r.id for r in found.collect()) == [2, 4, 13, 14]


def test_zombies_and_states(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    rows = spark.createDataFrame([(1, "ingest_library", "running", "2024-01-01 10:00:00"), (2, "ingest_library", "running", "2024-01-01 11:00:00"), (3, "other", "running", "2024-01-01 11:00:00"), (4, "other", "running", None), (5, "other", "queued", None)], "job_id int, kind string, status string, started_at string")
    dead = jobs.zombies(rows.withColumn("started_at", F.col("started_at").cast("timestamp_ntz")), now)
    assert sorted(r.job_id for r in dead.collect()) == [1, 3, 4]
    log = spark.createDataFrame([(1, 1, "queued", None), (1, 2, "failed", "x"), (1, 3, "running", None), (2, 1, "running", None)], "job_id int, t int, status string, error string")
    assert {r.job_id: (r.status, r.error) for r in jobs.current_state(log, "job_id", "t", "t").collect()} == {1: ("failed", "x"), 2: ("running", None)}


def test_matching(spark):
    expected = spark.createDataFrame([(1, "ash_wednesday_the_imposition_of_ashes", "optional-block"), (1, "psalm_023", "psalm")], "case_id int, source_id string, kind string")
    hits = spark.createDataFrame([(1, "c1", 0, "liturgical_unit", "psalm", "Psalm 24"), (1, "c2", 1, "liturgical_unit", "optional_block", "Optional Block (Ash Wednesday)"), (1, "c3", 2, "liturgical_unit", "psalm", "Psalm 23")], "case_id int, candidate_id string, position int, source_type string, genre string, source_title string")
    found = matching.expected_hits(expected, hits)
    assert {(r.source_id[:5], r.candidate_id) for r in found.collect()} == {("ash_w", "c2"), ("psalm", "c3")}
    cases = spark.createDataFrame([(1, "positive"), (2, "negative_true"), (3, "negative_spillover")], "case_id int, category string")
    assert all(r.passed for r in matching.verdicts(cases, found, hits).collect())
    wanted = spark.createDataFrame([("f", 1, "The Show!"), ("f", 2, "Long title")], "feed string, wanted_id int, title string")
    items = spark.createDataFrame([("f", 0, "1. The Show", "u0"), ("f", 1, "the show", "u1"), ("f", 2, "A long title here", "u2")], "feed string, position int, title string, enclosure string")
    assert {r.wanted_id: (r.enclosure, r.tier) for r in matching.feed_match(wanted, items).collect()} == {1: ("u1", 0), 2: ("u2", 1)}


def test_thread_order(spark):
    posts = spark.createDataFrame([("r", None, 0), ("a", "r", 0), ("b", "r", 1), ("a1", "a", 0), ("x", "gone", 0)], "uri string, parent string, position int")
    assert [r.uri for r in threads.flattened(posts).orderBy("path").collect()] == ["r", "a", "a1", "b"]


def test_crawl(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "out"), ("c", "d")], "url string, target string")
    start = spark.createDataFrame([("a",)], "url string")
    assert {r.url: r["round"] for r in threads.reached(start, links, F.col("target") != "out").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_contracts(spark):
    good = '{"accepted":[{"id":"1","reason":"r"}],"rejected":[{"id":"2","reason":"r"}],"triangulation_groups":[]}'
    rows = [(good, ["1", "2"]), (good, ["1"]), ("x" + good, None), (good.replace('"2"', '"1"'), None), (None, None), (good.replace('"r"', '"' + "w " * 31 + '"', 1), None)]
    df = spark.createDataFrame(rows, "t string, e array<string>")
    assert [r.error is None for r in df.select(contracts.parse_judgment("t", "e").alias("j")).select("j.*").collect()] == [True, False, False, False, False, False]
    text = "---\nsummary_version: 1\nsource_kind: article\ntitle: T\nword_count: 12\n---\n\n# Summary\nD\n\n## Key points\n" + "- p\n" * 5 + "\n## Quotes\n> q\n> r\n"
    bad = [text.replace("- p\n", "", 2), text.replace("## Quotes", "## Other"), text.replace("title: T\n", ""), "x"]
    out = [r.s for r in spark.createDataFrame([(t,) for t in [text, *bad]], "t string").select(contracts.parse_summary("t").alias("s")).collect()]
    assert out[0].error is None and (out[0].description, out[0].word_count, len(out[0].key_points), out[0].quotes) == ("D", 12, 5, ["q", "r"])
    assert all(r.error for r in out[1:])
    parse = contracts.profile_parser(["A", "B"])
    out = spark.createDataFrame([("# P\n## A\n- x [seen]\n## B\n",), ("# P\n## B\n## A\n",), ("# P\n## A\n- x\n",)], "t string").select(parse("t").alias("p")).collect()
    assert [r.p.error is None for r in out] == [True, False, False]


def test_reading_log_and_files(spark, tmp_path):
    (tmp_path / "log.csv").write_text("﻿Title,Authors,Read Status,Star Rating,Last Date Read,ID\nA,X|Y,read,4.5,2024/01/02,7\nB,,to-read,,,\n,Z,read,,,\nC,,Finished,bad,not-a-date, 9\n", encoding="utf-8")
    rows = {r.title: r for r in readers.reading_log(spark, f"file://{tmp_path}/log.csv").collect()}
    assert set(rows) == {"A", "C"} and rows["A"].rating == 4.5 and rows["A"].read_date == "2024-01-02" and rows["C"].source_id == "9" and rows["C"].rating is None
    books = tmp_path / "books" / "sub"
    books.mkdir(parents=True)
    for name in ("a.epub", "._b.epub", "c.txt", "d.PDF"):
        (books / name).write_bytes(name.encode())
    found = readers.files(spark, f"file://{tmp_path}/books", readers.BOOK_SUFFIXES)
    assert sorted(r.name for r in found.select("name").collect()) == ["a.epub", "d.PDF"]
    stored = found.filter("name = 'a.epub'").select("path", "length", "modified", F.sha2("content", 256).alias("content_hash"))
    assert [r.name for r in readers.new_files(found, stored).select("name").collect()] == ["d.PDF"]


def test_sinks_and_adapters(spark, tmp_path):
    df = spark.createDataFrame([("T", None, "body")], "t string, a string, b string")
    assert df.select(sinks.markdown([("title", F.col("t")), ("author", F.col("a"))], F.col("b")).alias("m")).first().m == '---\ntitle: "T"\n---\n\nbody\n'
    embed = adapters.embedder(adapters.hash_embedding(8))
    assert len(df.select(embed("b").alias("v")).first().v) == 8
    sinks.append(df, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 1


def test_idempotent_appends(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "h string, n int")
    for _ in range(2):
        streams.append_new(rows, f"file://{tmp_path}/kept", "h")
    assert sorted(r.h for r in spark.read.parquet(f"file://{tmp_path}/kept").collect()) == ["a", "b"]


def test_stream_over_several_batches(spark, tmp_path, sf_dir):
    """State carries over batches: the same states as the batch fold."""
    from quillspark.plans.views import as_jobs

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    found = streams.available(streams.states(as_jobs(streams.stream(spark, f"file://{tmp_path}/in", events, "ts"))), f"file://{tmp_path}/out", "update", ["user_id"])
    want = jobs.current_state(as_jobs(events).withColumn("error", F.lit(None).cast("string")), "user_id", "created_at", "job_id")
    assert sorted((r.user_id, r.status, r.events) for r in found.collect()) == sorted((r.user_id, r.status, r.events) for r in want.collect())


def test_year_calendar_transfers(spark):
    """Known days of two years, with those that move off a Sunday or out of Easter Week."""
    rows = [
        (1, "Epiphany", "anglican", "fixed", "01-06", "principal_feast"),
        (2, "Easter", "anglican", "movable", "easter+0", "principal_feast"),
        (3, "Ascension", "anglican", "movable", "easter+39", "principal_feast"),
        (4, "Pentecost", "anglican", "movable", "easter+49", "principal_feast"),
        (5, "Ash Wednesday", "anglican", "movable", "easter-46", "holy_day"),
        (6, "Saint Mark", "anglican", "fixed", "04-25", "holy_day"),
        (7, "Annunciation", "anglican", "fixed", "03-25", "holy_day"),
        (8, "Vincent de Paul", "anglican", "commemoration", "03-15", "lesser_commemoration"),
        (9, "Holy Name", "anglican", "fixed", "01-01", "holy_day"),
    ]
    feasts = spark.createDataFrame(rows, "id bigint, primary_name string, tradition string, calendar_type string, date_rule string, precedence string")
    found = {(str(r.day), r.primary_name): r.transferred for r in calendar.year_calendar(feasts, spark.createDataFrame([(2025,), (2026,)], "year int")).collect()}
    still = [("2026-01-06", "Epiphany"), ("2026-04-05", "Easter"), ("2026-05-14", "Ascension"), ("2026-05-24", "Pentecost"), ("2026-02-18", "Ash Wednesday"), ("2026-03-25", "Annunciation"), ("2026-01-01", "Holy Name"), ("2025-04-20", "Easter"), ("2025-05-29", "Ascension"), ("2025-06-08", "Pentecost")]
    assert all(found[key] is False for key in still)
    assert found["2026-03-16", "Vincent de Paul"] and found["2025-04-28", "Saint Mark"]


def test_corrections(spark):
    day = F.lit("2024-01-30").cast("date")
    asked = [("profile", "p", None, " be brief "), ("book", "b", "dune", "not so"), ("book", "none", "gone", "x"), ("judge", "j", None, "more"), ("judge", "j2", None, " "), ("else", "e", None, "x")]
    texts = [("p", "# P\n## Corrections\nold\n## Next\nx"), ("b", None), ("j", "a line")]
    found = {r.path: r for r in corrections.corrected(spark.createDataFrame(asked, "target_type string, path string, target_id string, correction string"), spark.createDataFrame(texts, "path string, content string"), day).collect()}
    assert found["p"].content == "# P\n## Corrections\nold\n[directive, 2024-01-30] be brief\n## Next\nx"
    assert found["b"].content == "# Corrections\n\n[directive, 2024-01-30] not so\n" and found["j"].content == "a line\n[directive, 2024-01-30] more\n"
    assert [found[p].status for p in ("none", "j2", "e")] == ["error"] * 3 and found["none"].error == "book not found"
    new = corrections.corrected(spark.createDataFrame([("profile", "q", None, "x")], "target_type string, path string, target_id string, correction string"), spark.createDataFrame([], "path string, content string"), day).first()
    assert new.content.endswith("## How I think\n\n## Corrections\n\n[directive, 2024-01-30] x\n")


def test_block_trees(spark):
    rich = lambda t, **told: [{"plain_text": t, "annotations": told}]
    tree = [
        {"type": "heading_2", "heading_2": {"rich_text": rich("Head")}},
        {"type": "numbered_list_item", "numbered_list_item": {"rich_text": rich("one", bold=True)}},
        {"type": "paragraph", "paragraph": {"rich_text": rich("a`b")}},
        {"type": "numbered_list_item", "numbered_list_item": {"rich_text": [{"plain_text": "two", "href": "u"}]}},
        {"type": "divider", "divider": {}},
        {"type": "numbered_list_item", "numbered_list_item": {"rich_text": rich("anew", code=True, italic=True)}, "children": [{"type": "to_do", "to_do": {"rich_text": rich("below")}}]},
        {"type": "quote", "quote": {"rich_text": rich("said")}, "children": [{"type": "paragraph", "paragraph": {"rich_text": rich("more")}}]},
        {"type": "child_page", "child_page": {"title": " Sub "}},
        {"type": "image", "image": {}},
    ]
    want = "## Head\n\n1. **one**\n\na\\`b\n\n2. [two](u)\n\n---\n\n1. *`anew`*\n  below\n\n> said\n\n> more\n>\n## Sub\n"
    rows = spark.createDataFrame([(json.dumps(tree),), ("no json",), (None,), ("[]",)], "t string").select(blocks.markdown("t").alias("m")).collect()
    assert [r.m for r in rows] == [want, None, None, "\n"]


def test_search_takes_one_query(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id int, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    assert [r.id for r in search.nearest(search.with_norm(v), q, 5, "id").collect()] == [1, 3]
    assert search.nearest(v, q.limit(0), 5, "id").count() == 0
    with pytest.raises(ValueError):
        search.distances(v, q.union(q))


def test_greedy_distinct_against_a_plain_loop(spark):
    import random

    rnd = random.Random(3)
    names, rows, want = [f"w{i}" for i in range(40)], [], []
    for g in range(3):
        base, kept = rnd.sample(names, 14), []
        for o in range(40):
            own = [*base[: rnd.randrange(10, 15)], *rnd.sample(names, rnd.randrange(0, 3))]
            rnd.shuffle(own)
            rows.append((g, o, " ".join(own).upper() if o % 3 else " ".join(own)))
            if not any(len(set(own) & k) / len(set(own) | k) >= 0.85 for k in kept):
                kept.append(set(own))
                want.append((g, o))
    found = dedupe.greedy_distinct(spark.createDataFrame(rows, "g int, o int, t string"), "g", "o", "t").collect()
    assert sorted((r.g, r.o) for r in found) == want and 10 < len(want) < 100
