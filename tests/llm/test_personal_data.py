"""Base spans against plain patterns; what the labelers and the classifier make of the others; EM against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import personal_data, queries

from . import brute

DOCS = "doc_id long, text string, row int, kind string, spans string, start int"
ODD = [
    "a@b.c%d@e.f x@y@z.com a@b..c .x@y.z. a@b.c. é@ü.com ünï.x@a-b.c-d",
    "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 0001.002.3.255 1.2.3x4.5.6.7 999.1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1234567890123456789012 378282246310005",
    "+1 (743) 555-3824 +12345678 +123456789 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +1) +49 30 901820.",
    "😀 a@b.cd 😀😀 +1 743 555 3824\n10.0.0.1",
    "+1.2.3.4 5@6.7 4111111111111111@8.9.10.11",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "own", "own", 2) for i, t in enumerate(texts)], DOCS)


def base_of(found):
    return {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.spans if s["base"]] for r in found.collect()}


def test_base_spans(spark):
    rnd = random.Random(4)
    pieces = ["a@b.co", "@", ".", "12.3.4.5", "+", "1", "4111111111111111", " ", "-", "(", "é", "x", "%", "255", "+1 743 555 3824", "\n", "😀", "00"]
    texts = [*ODD, None, "", "plain words", *("".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 40))) for _ in range(400))]
    assert base_of(personal_data.find_personal_data(frame(spark, texts))) == {i: brute.personal(t) for i, t in enumerate(texts)}


def test_long_texts_take_time_in_proportion(spark):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "1.2." * 300_000, "+1 " + " " * 1_000_000, "a@b." * 200_000, "1 " * 500_000 + "a@b.com", "me@a.org " * 20_000]
    found = base_of(personal_data.find_personal_data(frame(spark, texts)))
    assert found[0] == found[1] == [] and len(found[2]) == 150_000 and len(found[6]) == 20_000 and found[5] == [("email", 1_000_000, 1_000_007)]
    assert found[4] == brute.personal(texts[4])


def test_wider_spans(spark):
    """Disguised addresses and numbers in national form are found; numbers of other things and clean texts are left alone."""
    rnd = random.Random(6)
    texts = [f"word {rnd.choice(['mail', 'so', 'the'])} me{i}@mail{i % 9}.example.com and +1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)} on" for i in range(150)]
    good = {"please write to jane.doe [at] example [dot] com today": ("email", "jane.doe [at] example [dot] com"), "call me, phone (743) 555-3824, at noon": ("phone", "(743) 555-3824"), "Telefon: 030 901820 oder": ("phone", "030 901820"), "mail john (at) example.org": ("email", "john (at) example.org")}
    bad = ["order 4785380592391139 of the list", "isbn 9781234567890123", "we met at noon and at night", "version 1.2.3.4.5", "he was at home dot", "4785380592391138 words", "section 123 456 7890 of the code"]
    found = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.spans if not s["base"]] for r in personal_data.find_personal_data(frame(spark, [*texts, *good, *bad])).collect()}
    assert [found[150 + i] for i in range(len(good))] == [[(kind, t.index(span), t.index(span) + len(span))] for t, (kind, span) in good.items()]
    assert all(not found[i] for i in found if i < 150 or i >= 150 + len(good))


def test_reliabilities(spark):
    """Expectation maximisation as a plain loop gives the same."""
    rnd = random.Random(8)
    names = list(personal_data.LABELERS)
    counts = {tuple(rnd.randrange(3) for _ in names): rnd.randrange(1, 50) for _ in range(60)}
    rows = [("email", list(v), n) for v, n in counts.items()]
    model = personal_data.reliabilities(spark.createDataFrame(rows, "kind string, votes array<int>, n long")).first()["model"]
    total, share = sum(counts.values()), 0.5
    yes, no = ([list(personal_data.LABELERS[x][y]) for x in names] for y in (0, 1))
    for _ in range(personal_data.ROUNDS):
        p = {}
        for v in counts:
            a, b = share, 1 - share
            for j, x in enumerate(v):
                a, b = a * yes[j][x], b * no[j][x]
            p[v] = a / (a + b)
        prior = personal_data.PRIOR * total
        share = (sum(n * p[v] for v, n in counts.items()) + prior / 2) / (total + prior)
        for told, y in ((yes, 0), (no, 1)):
            w = {v: n * (p[v] if y == 0 else 1 - p[v]) for v, n in counts.items()}
            for j, x in enumerate(names):
                told[j] = [(sum(m for v, m in w.items() if v[j] == k) + prior * personal_data.LABELERS[x][y][k]) / (sum(w.values()) + prior) for k in range(3)]
    assert model["share"] == pytest.approx(share) and [list(x) for x in model["yes"]] == [pytest.approx(x) for x in yes] and [list(x) for x in model["no"]] == [pytest.approx(x) for x in no]


def test_repeated_and_null_ids_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a@b.com"), (1, "a@b.com"), (None, "1.2.3.4"), (None, None)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, [(s["kind"], s["start"], s["end"]) for s in r.spans]) for r in personal_data.find_personal_data(docs).collect())
    assert found == [(0, []), (0, [("ip", 0, 7)]), (1, [("email", 0, 7)]), (1, [("email", 0, 7)])]
    assert personal_data.find_personal_data(docs.limit(0)).count() == 0
    assert personal_data.find_personal_data(docs.filter("text IS NULL")).first().spans == []


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op13_personal_data(spark, sf_dir).collect():
        base = brute.personal(texts[r.doc_id])
        listed = [":".join(map(str, s)) for s in base]
        assert r.base_sha256 == brute.sha(",".join(listed)) and set(listed) <= set(filter(None, r.spans.split(",")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in brute.PERSONAL]


def test_main_path_is_native(spark, sf_dir):
    plan = queries.op13_personal_data(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
