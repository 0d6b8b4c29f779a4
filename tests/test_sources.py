"""Foreign tables, feeds, and the drivers that read them: posts, journals, commemorations, notebooks."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillspark.operators import drivers
from quillspark.sources import commits, feeds, foreign

DAY = 24 * 3600 * 1_000_000


def embed(c):
    return F.array(F.length(c).cast("float"))


@pytest.fixture
def log(spark, tmp_path):
    return commits.Commits(spark, f"file://{tmp_path}/store")


# A journal in another program's file


@pytest.fixture
def diary(tmp_path):
    path = f"{tmp_path}/Diary.sqlite"
    with sqlite3.connect(path) as file:
        file.execute('CREATE TABLE ZJOURNAL (Z_PK INTEGER PRIMARY KEY, ZNAME VARCHAR)')
        file.execute('CREATE TABLE ZENTRY (Z_PK INTEGER PRIMARY KEY, ZUUID VARCHAR, ZMARKDOWNTEXT VARCHAR, ZCREATIONDATE TIMESTAMP, ZMODIFIEDDATE TIMESTAMP, ZSTARRED INTEGER, ZJOURNAL INTEGER, "odd ""name" BLOB)')
        file.executemany("INSERT INTO ZJOURNAL VALUES (?, ?)", [(1, "Home"), (2, None)])
        rows = [(i * 10, f"u{i}", None if i % 7 == 0 else "" if i % 7 == 1 else f"## Title {i}\nbody", 100.0 + i, None if i == 9 else 1000.0 + i, i % 2, [1, 2, 5, None][i % 4], b"x") for i in range(60)]
        file.executemany("INSERT INTO ZENTRY VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    return path


@pytest.mark.parametrize("parts", [1, 7])
def test_foreign_table(spark, diary, parts):
    entries = foreign.sqlite_table(spark, diary, "ZENTRY", "Z_PK", parts)
    assert dict(entries.dtypes)["ZMODIFIEDDATE"] == "double" and dict(entries.dtypes)['odd "name'] == "binary"
    assert entries.count() == 60 and entries.rdd.getNumPartitions() == parts
    some = entries.filter("ZMODIFIEDDATE >= 1030.0 AND ZUUID IS NOT NULL AND ZSTARRED IN (1, 3) AND upper(ZUUID) <> 'U31'")
    assert sorted(r.ZUUID for r in some.collect()) == sorted(f"u{i}" for i in range(33, 60, 2))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "upper(ZUUID" in plan and "1030" not in plan  # what the file answers, Spark doesn't ask again
    assert foreign.sqlite_table(spark, diary, "ZENTRY").filter("ZUUID = 'none'").count() == 0
    with pytest.raises(Exception, match="no table"):
        foreign.sqlite_table(spark, diary, "NONE").count()


def test_filters_go_to_the_file(diary):
    reader = foreign._Reader({"path": diary, "table": "ZENTRY", "key": "Z_PK", "parts": "3"}, foreign.SqliteTable({"path": diary, "table": "ZENTRY"}).schema())
    ds = foreign.ds
    left = list(reader.pushFilters([ds.GreaterThanOrEqual(("ZMODIFIEDDATE",), 1050.0), ds.StringContains(("ZUUID",), "u"), ds.IsNull(("ZJOURNAL",)), ds.Not(ds.IsNull(("ZUUID",)))]))
    assert [type(f) for f in left] == [ds.StringContains, ds.Not]
    ranges = reader.partitions()
    assert [p.value for p in ranges] == [(510, 536), (537, 563), (564, 590)]  # of the rows that pass
    assert sorted(r[1] for p in ranges for r in reader.read(p)) == ["u51", "u55", "u59"]


def test_journal(spark, log, diary):
    read = lambda table: foreign.sqlite_table(spark, diary, table, "Z_PK", 3)
    entries = lambda: read("ZENTRY").selectExpr("ZUUID AS uuid", "ZMARKDOWNTEXT AS markdown", "ZCREATIONDATE AS created", "ZMODIFIEDDATE AS modified", "ZSTARRED AS starred", "ZJOURNAL AS journal")
    journals = read("ZJOURNAL").selectExpr("Z_PK AS key", "ZNAME AS name")
    told = lambda found: {r.source_id: r.action for r in found.collect()}
    want = {f"u{i}" for i in range(60) if i % 7 > 1}
    assert told(drivers.journal(log, entries(), journals, embed)) == {u: "inserted" for u in want}
    held = {r.source_id: (r.title, r.raw_path) for r in log.frame("documents", drivers.DOCUMENTS).collect()}
    assert held["u4"] == ("Title 4", "Home") and held["u5"] == ("Title 5", "") and held["u6"] == ("Title 6", "")
    with sqlite3.connect(diary) as file:
        file.execute("UPDATE ZENTRY SET ZMARKDOWNTEXT = 'new text', ZMODIFIEDDATE = 5000 WHERE ZUUID = 'u4'")
        file.execute("UPDATE ZENTRY SET ZMODIFIEDDATE = 10 WHERE ZUUID = 'u5'")
    since = F.lit("2001-01-01T00:16:45Z")  # 1005 seconds after the epoch
    got = told(drivers.journal(log, entries(), journals, embed, since))
    assert got == {u: "updated" if u == "u4" else "skipped" for u in want if (int(u[1:]) > 4 or u == "u4") and u not in ("u5", "u9")}
    documents = log.frame("documents", drivers.DOCUMENTS).collect()
    assert len(documents) == len(want) and [r.title for r in documents if r.source_id == "u4"] == ["new text"]
    chunks = log.frame("chunks", drivers.CHUNKS).collect()
    assert len(chunks) == len(want) and sum(r.text == "new text" for r in chunks) == 1


# A feed of posts


class FileFeed:
    """Posts in a file of JSON, a few a page."""

    def __init__(self, path):
        self.path = path

    def _posts(self):
        with open(self.path) as f:
            return sorted(json.load(f), key=lambda p: -p["at"])

    def newest(self):
        return max((p["at"] for p in self._posts()), default=None)

    def page(self, before):
        return [p for p in self._posts() if p["at"] < before][:7]


def feed_of(tmp_path, posts):
    path = f"{tmp_path}/feed.json"
    with open(path, "w") as f:
        json.dump(posts, f)
    return FileFeed(path)


def some_posts(first, last):
    return [{"uri": f"at://{i}", "author": "me", "text": f"text {i % 40}" if i % 9 else " ", "at": i * DAY, "repost": i % 10 == 3} for i in range(first, last)]


def test_feed_in_ranges(spark, tmp_path):
    feed = feed_of(tmp_path, some_posts(1, 100))
    every = feeds.feed_table(spark, feed)
    assert every.rdd.getNumPartitions() == 4 and sorted(r.at // DAY for r in every.collect()) == list(range(1, 100))
    assert sorted(r.at // DAY for r in feeds.feed_table(spark, feed, after=97 * DAY).collect()) == [98, 99]
    assert feeds.feed_table(spark, feed, after=99 * DAY).count() == 0
    assert feeds.feed_table(spark, feed_of(tmp_path, [])).count() == 0


def test_posts_once_however_often_the_stream_stops(spark, log, tmp_path):
    seen = {}
    for last in (20, 20, 55, 100):
        feed = feed_of(tmp_path, some_posts(1, last))
        drivers.follow_posts(log, feeds.feed_stream(spark, feed, name=f"feed_{last}"), embed, f"file://{tmp_path}/checkpoint-of-posts")
        seen[last] = {r.source_id for r in log.frame("documents", drivers.DOCUMENTS).collect()}
    good = [i for i in range(1, 100) if i % 9 and i % 10 != 3]
    want, texts = set(), set()
    for i in good:
        if i % 40 not in texts:
            texts.add(i % 40)
            want.add(f"at://{i}")
    assert seen[100] == want and seen[20] == {f"at://{i}" for i in good if i < 20}
    again = drivers.posts(log, feeds.feed_table(spark, feed), embed)  # a batch that is read again
    assert {r.action for r in again.collect()} == {"existing", "skipped"} and log.frame("documents", drivers.DOCUMENTS).count() == len(want)
    assert log.frame("chunks", drivers.CHUNKS).count() == len(want)


# Commemorations and notebooks


def test_commemorations(spark, log):
    schema = "slug string, name string, bio string, collects array<struct<rite: string, text: string>>"
    two = [("rite_i", "O God"), ("rite_ii", "God")]
    rows = [("ann_anglican", "Ann", "Her life", two), ("bob_anglican", "Bob", "His life", two), ("bad_anglican", "Bad", "x", [("rite_i", " ")]), ("odd_anglican", "Odd", "x", [("rite_x", "t")]), ("dup_anglican", "Dup", "x", [("rite_i", "a"), ("rite_i", "b")]), ("twin", "A", None, []), ("twin", "B", None, []), (None, "N", "x", []), ("plain_anglican", "Plain", " ", None)]
    feasts = spark.createDataFrame([("ann_anglican", 7), ("plain_anglican", 8)], "slug string, id long")
    landed = spark.createDataFrame(rows, schema)
    got = [(r.source_id, r.action, r.error) for r in drivers.commemorations(log, landed, feasts, embed).collect()]
    assert sorted(got, key=str) == sorted([("ann_anglican", "processed", None), ("bob_anglican", "no_feast", None), ("bad_anglican", "failed", "a collect without text"), ("odd_anglican", "failed", "a collect of no known rite"), ("dup_anglican", "failed", "two collects of one rite"), ("twin", "failed", "slug given more than once"), ("twin", "failed", "slug given more than once"), (None, "failed", "no slug"), ("plain_anglican", "processed", None)], key=str)
    held = {(r.source_id, r.content_type, r.entry_id) for r in log.frame("documents", drivers.DOCUMENTS).collect()}
    assert held == {("ann_anglican", "liturgical_unit_bio", "7"), ("ann_anglican_rite-i", "liturgical_unit", "7"), ("ann_anglican_rite-ii", "liturgical_unit", "7"), ("bob_anglican_rite-i", "liturgical_unit", None), ("bob_anglican_rite-ii", "liturgical_unit", None)}
    drivers.commemorations(log, landed, feasts, embed)
    assert log.frame("documents", drivers.DOCUMENTS).count() == 5 and log.frame("chunks", drivers.CHUNKS).count() == 5


BOOK = '<div class="kp-notebook-library-each-book" id="{0}"><h2 class="kp-notebook-searchable">{1}</h2><p class="kp-notebook-searchable">By {1}</p></div>'
MARK = '<div class="kp-notebook-row-separator"><input id="kp-annotation-location" value="{0}"><span id="highlight">{1}</span><span id="note">{2}</span></div>'


def notebook(spark):
    library = spark.createDataFrame([("".join(BOOK.format(f"B00000000{i}", f"Book {i}") for i in range(4)),)], "html string")
    page = lambda i, n: '<div id="kp-notebook-annotations">' + "".join(MARK.format(f"Location {k}", f"text {i} {k} " + "long " * 20, "note" if k % 2 else "") for k in range(n * 3, n * 3 + 4)) + "</div>"
    rows = [(f"B00000000{i}", n, page(i, n)) for i in range(5) for n in range(3)]
    rows[7] = (*rows[7][:2], "<div>" * 2000)
    return library, spark.createDataFrame([*rows, (None, 1, "x")], "asin string, page int, html string").repartition(3)


def test_notebooks_in_capped_runs(spark, tmp_path):
    library, pages = notebook(spark)
    stores = [commits.Commits(spark, f"file://{tmp_path}/{i}") for i in range(2)]
    whole, told = drivers.notebooks(stores[0], library, pages, embed)
    assert told == {"status": "complete", "after": ("B000000004", 2), "pages": 15}
    assert [(r.source_id, r.error) for r in whole.collect() if r.action == "failed"] == [("B000000002#1", "page can't be read")]
    after, runs = None, []
    while not runs or runs[-1]["status"] == "partial":
        _, told = drivers.notebooks(stores[1], library, pages, embed, cap=4, after=after)
        after = told["after"]
        runs.append(told)
    assert [r["pages"] for r in runs] == [4, 4, 4, 3]
    rows = lambda log: sorted((r.content_type, r.source_id, r.title, r.author, r.content_hash or "") for r in log.frame("documents", drivers.DOCUMENTS).collect())
    assert rows(stores[0]) == rows(stores[1]) and len(rows(stores[0])) == 5 + 5 * 10 - 2  # locations at page ends stand on both pages
    assert ("kindle_book", "B000000004", "", "", "") in rows(stores[0])
    texts = lambda log: sorted(r.text for r in log.frame("chunks", drivers.CHUNKS).collect())
    assert texts(stores[0]) == texts(stores[1]) and any(t.endswith("\n\nnote") for t in texts(stores[0]))
    _, told = drivers.notebooks(stores[1], library, pages, embed, cap=4, after=after)
    assert told == {"status": "complete", "after": after, "pages": 0}
