"""What grows with the tables: sizes of pages, batches and pairs, and whole ranges."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import lazy, tree
from quillspark.operators import dedupe, prayerbook, psalter, scan
from quillspark.plans import catalog, days, library  # noqa: F401  the others add their queries to the catalog


def test_easter_of_every_year(spark, sf_dir):
    found = {r.year: r for r in catalog.QUERIES["easter_dates"](spark, sf_dir).collect()}
    assert set(range(1900, 2101)) <= set(found)
    assert (str(found[2100].western), str(found[2100].orthodox)) == ("2100-03-28", "2100-05-02")


def test_copies_of_titles_meet_once(spark):
    stored = spark.range(6000).select("id", F.concat(F.lit("red ring "), (F.col("id") % 3).cast("string")).alias("title"), F.lit("Brand 7").alias("author"))
    wanted = stored.select(F.col("title").alias("wanted_id"), "title", "author").distinct()
    found = dedupe.fuzzy_best(wanted, stored)
    assert {(r.wanted_id, r.id, r.score) for r in found.collect()} == {(f"red ring {i}", i, 1.0) for i in range(3)}
    assert "Aggregate [s_title" in found._jdf.queryExecution().optimizedPlan().toString()


def test_pages_stay_small(spark, sf_dir, monkeypatch):
    """More books are more pages, and more verses more parts of a page."""
    seen = []
    monkeypatch.setattr(library, "BOOKS_OF_PAGE", 8, raising=False)
    monkeypatch.setattr(library, "VERSES_OF_PART", 3, raising=False)
    for module, name in ((tree, "rows_of_books"), (psalter, "rows_of_tables")):
        read = getattr(module, name)
        monkeypatch.setattr(module, name, lambda pages, keep, read=read: seen.append(pages.agg(F.max(F.length("html"))).first()[0]) or read(pages, keep))
    assert catalog.QUERIES["notebook_books"](spark, sf_dir).count() > 8
    assert catalog.QUERIES["psalter_pages"](spark, sf_dir).count() == 150
    assert len(seen) == 2 and seen[0] < 8 * 400 and seen[1] < 4 * 500


def test_a_page_in_parts_is_one_page(spark):
    row = lambda n, t: f'<tr><td class="vsnum">{n}</td><td>{t}</td></tr>'
    start = lambda n: f'<tr><td><span class="psnum">{n}</span></td></tr>'
    rows = [start(2), row(1, "a"), "<tr><td><strong>Part II</strong></td></tr>", row(2, "b"), start(3), row(1, "c"), row(2, "d")]
    whole = spark.createDataFrame([("p.html", "<table>" + "".join(rows) + "</table>")], "page string, html string")
    parts = spark.createDataFrame([("p.html", i, f"<table>{r}</table>") for i, r in enumerate(rows)], "page string, part long, html string").repartition(3)
    one, many = ([(r.number, [tuple(v) for v in r.verses], r.headings) for r in psalter.psalms(f).orderBy("number").collect()] for f in (whole, parts))
    assert one == many == [(2, [(1, "a"), (2, "b")], {2: "Part II"}), (3, [(1, "c"), (2, "d")], {})]


@pytest.mark.parametrize("n", [1, 5])
def test_batches_are_read_in_slices(n):
    batch = pa.RecordBatch.from_pydict({"t": ["x" * (lazy.SLICE_BYTES // n)] * 12 + [None]})
    sizes = [b.num_rows for b in lazy.slices(iter([batch]), "t")]
    assert sum(sizes) == 13 and max(sizes) <= n + 1


def test_plain_pages_are_read_without_the_standard_parser(monkeypatch):
    plain = ['<html><body>\n<p id="l0" class="a b">1 &amp; 2<br/>x</p><table><tr><td>c</td></table></body></html><!--  -->', "", "no tag", "</p><p>a<p>b", "a &notit; b &"]
    other = ["a < b", "<P>a</P>", "<p class='q'>a", "<title>a<b></title>c", "<script>1<2</script>x", "<!DOCTYPE html><p>a", "<p class='a&amp;b'>", "<p"]
    read = tree._Builder.feed

    def standard(page):
        builder = tree._Builder()
        read(builder, page)
        builder.close()
        return builder.open[0]

    assert [tree.tree(p) for p in other] == [standard(p) for p in other]
    monkeypatch.setattr(tree._Builder, "feed", lambda *_: pytest.fail("left to the standard parser"))
    assert [tree.tree(p) for p in plain] == [standard(p) for p in plain]
    with pytest.raises(tree.Malformed):
        tree.tree("<div>" * 600)


def test_a_parser_makes_only_what_it_reads(spark):
    page = spark.createDataFrame([("a/collects/xt.html", '<p><strong>1.  A</strong></p><p>B <i>c</i><br/>d Amen.</p><p class="rubric">E</p><p class="leftfoot">Page <b>21</b></p>')], "page string, html string")
    some = prayerbook.elements(page, "collects")
    assert "rows" not in some.columns and "spaced" not in some.columns
    one, every = (prayerbook.collects(rows).collect() for rows in (some, prayerbook.elements(page)))
    assert one == every and [(r.feast_name, r.body_text, r.rubrics, r.page_number) for r in one] == [("A", "B c d Amen.", ["E"], 21)]


def test_a_scan_moves_its_rows_once(spark):
    """A chunk's rows are put in order where they meet what came before: two shuffles for the chunks' sums, one each for rows and
    chunks."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(k, i, i % 3 or None) for k in ("a", None) for i in range(9)], "k string, i int, v int")
        found = scan.carried(rows, "k", "i", last={"last": F.col("v")}, total={"sum": F.col("v")}, chunk=2)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
        assert [(r["last"], r["sum"]) for r in found.filter("k IS NULL").orderBy("i").collect()] == [(None, 0), (1, 1), (2, 3), (2, 3), (1, 4), (2, 6), (2, 6), (1, 7), (2, 9)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_liturgies_read_no_more_than_they_need(spark):
    html = '<h2 id="x">S</h2><p><strong>T</strong></p><table><tr><td><span class="psnum">Psalm 3</span></td></tr><tr><td class="vsnum">1</td><td>v</td></tr></table><p style="border-left: 1px">o</p><p>a <i>b</i></p>'
    page = spark.createDataFrame([("x/friday.html", html)], "page string, html string")
    some = prayerbook.elements(page, "proper_liturgies")
    assert "text" not in some.columns
    one, every = (sorted(map(str, prayerbook.proper_liturgies(rows).collect())) for rows in (some, prayerbook.elements(page)))
    assert one == every and len(one) == 5
