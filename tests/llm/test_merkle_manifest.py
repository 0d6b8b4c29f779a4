"""Manifests and proofs against a plain tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle_manifest as merkle
from quillspark.llm import queries

from . import brute

DOCS = "doc_id long, source string, lang string, n_chars long, text string, grp string, digest string, id int"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def some_rows(n=400, seed=1):
    """A source with a third of the rows, many of one or two, null and empty ones, repeated rows and ids, null ids."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = rnd.choice(["hot", "hot", "hot", None, "", "é", "Z", "z", f"s{rnd.randrange(60)}"])
        rows.append((i, source, rnd.choice(["en", None]), rnd.choice([0, 12, None]), rnd.choice(["", None, "Some Text", "kein Text é", f"t{i}"])))
    rows += rows[:5] + rows[:2] + [(7, "hot", "en", 1, "another of this id"), (None, "hot", None, None, None), (None, "hot", "en", 3, "abc"), (5000, "long", "en", 1, "word " * 200_000)]
    rows += [(9000, "copies", "en", 1, "copy")] * 100
    return [(*r, "own", "own", 1) for r in rows]


def checked(found, want):
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted(want, key=str)


def plain(rows, arity):
    return [(d, x, top, root, brute.sha("".join(a + b for a, b in path))) for d, x, top, root, path in brute.merkle([(r[0], r[1], brute.leaf(*r[:5])) for r in rows], arity)]


@pytest.mark.parametrize("arity, partial, levels, n", [(16, 100_000, 3, 400), (2, 100_000, 3, 150), (3, 4, 1, 150)])
def test_proofs(spark, monkeypatch, arity, partial, levels, n):
    monkeypatch.setattr(merkle, "PARTIAL", partial)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = some_rows(n)
    found = merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(5), "doc_id", "source", COLUMNS, arity=arity)
    proofs = merkle.proofs(found)
    told = proofs.select("id", merkle.told(F.col("digest")), merkle.told(F.col("subroot")), F.lit(found.root.hex()), merkle.proof_digest(F.col("path")))
    checked(told, plain(rows, arity))
    assert proofs.filter(merkle.folded(F.col("digest"), F.col("path")) != found.root.hex()).count() == 0


def test_the_frontier_is_small_and_events_come_in_any_order():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(1000)]
    want, _ = brute.tree([d.hex() for d in digests], 16)
    whole = merkle.Climb(16)
    for i in random.Random(2).sample(range(1000), 1000):
        whole.add("g", 1000, 0, i, digests[i])
    assert whole.out[-1][0] == merkle.TOP and whole.out[-1][5].hex() == want and not whole.partial
    part = merkle.Climb(16)
    for i in range(100, 700):
        part.add("g", 1000, 0, i, digests[i])
    part.leave()
    left = [x for x in part.out if x[0] == merkle.OPEN]
    assert len(left) <= 2 * 15 * 3 and not part.partial


def test_tampered_rows_fail(spark, tmp_path):
    rows = [(i, f"s{i % 3}", "en", 4, "Text" if i % 2 else "text") for i in range(60)] + [(None, "s1", None, None, "Text"), (61, None, "en", None, None)]
    spark.createDataFrame(rows, ", ".join(DOCS.split(", ")[:5])).write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect():
        harmed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id % 2 and r.doc_id < 60
        assert r.verified == (r.folded_root == r.root) == (not harmed)


def test_manifest_of_nothing_and_of_one_row(spark):
    none = merkle.manifest(spark.createDataFrame([], DOCS), "doc_id", "source", COLUMNS)
    assert none.root is None and merkle.proofs(none).count() == 0
    rows = some_rows()[:1]
    one = merkle.manifest(spark.createDataFrame(rows, DOCS), "doc_id", "source", COLUMNS)
    [row] = merkle.proofs(one).collect()
    assert one.root.hex() == brute.leaf(*rows[0][:5]) and row["path"] == [] and bytes(row["subroot"]) == one.root
