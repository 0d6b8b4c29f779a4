"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, decontaminate, language_id, license_scan, line_dedup, merkle_manifest, near_dedup, personal_data, ranked_search, sentencepiece_codec, substring_dedup, token_counts, toxicity
from .common import held_out

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann_forest.search(vectors, F.col("vec_id") % 20 == 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(documents(spark, sf_dir), shingle=3, threshold=0.85)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, columns = documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [merkle_manifest.ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in columns]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle_manifest.leaf_digest(*changed))
    found = merkle_manifest.manifest(docs, "doc_id", "source", columns, also={"tampered": tampered})
    root = F.lit(found.root and found.root.hex()).cast("string")
    proofs = merkle_manifest.proofs(found).withColumn("folded_root", merkle_manifest.folded(F.coalesce("tampered", "digest"), F.col("path")))
    told = [merkle_manifest.told(F.col("digest")).alias("leaf"), merkle_manifest.told(F.col("subroot")).alias("subroot"), root.alias("root"), merkle_manifest.proof_digest(F.col("path")).alias("proof_sha256")]
    return proofs.select(F.col("id").alias("doc_id"), *told, "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = map(of, personal_data.KINDS)
    return found.select("doc_id", *counts, F.sha2(personal_data.joined(base), 256).alias("base_sha256"), personal_data.joined(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_ann_forest, op2_token_counts, op3_substring_dedup, op4_sentencepiece, op5_license_scan, op6_line_dedup, op7_toxicity, op8_decontamination, op9_near_dedup, op10_language_id, op11_ranked_search, op12_merkle_manifest, op13_personal_data)}

_WORDS = "'[^\\x20\\x09-\\x0D]+'"
_TERMS = "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _fields(text: str) -> str:
    """A row's columns as they are digested."""
    return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))


#: DuckDB SQL for the rows of the queries that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM s JOIN f USING (g) WHERE first < doc_id),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w),
r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1),
k AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.j) AS kept FROM t ANTI JOIN c ON t.doc_id = c.doc_id AND t.j = c.j GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op6_line_dedup": f"""WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key FROM l),
g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last IS NOT NULL AND doc_id <> last) AS n_dropped,
sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR doc_id = last), '')) AS kept_sha256 FROM k LEFT JOIN g USING (key) GROUP BY doc_id""",
    "op9_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END)) AS s FROM w),
c AS (SELECT min(doc_id) AS class_id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT class_id, n, unnest(s) AS g FROM c),
p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS n, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.class_id < b.class_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p WHERE 100 * n >= 85 * (na + nb - n)), u AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
r AS (SELECT class_id AS id, class_id AS root FROM c UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id WHERE r.root < u.b),
m AS (SELECT id, min(root) AS component FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, coalesce(m.component, s.doc_id) = s.doc_id AS kept, coalesce(c.class_id, s.doc_id) AS class_id
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m ON m.id = c.class_id""",
    "op11_ranked_search": f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, {_LOWER}), {_TERMS}) AS w FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, {_LOWER}), {_TERMS})) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM b WHERE item_id IS NOT NULL GROUP BY ALL),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
t AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM (SELECT row_number() OVER () AS row, * FROM d)) SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
g AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM f, s),
r AS (SELECT item_id, row, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM t JOIN q USING (term) JOIN g USING (term), s GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 20""",
    "op12_merkle_manifest": f"""WITH RECURSIVE d AS (SELECT *, translate(text, {_LOWER}) AS lowered, CAST(doc_id AS VARCHAR) AS id FROM documents),
c AS (SELECT *, list_reduce([4294967295] || list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(id[i]) AS BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc FROM d),
h AS (SELECT doc_id, source, sha256({_fields("text")}) AS leaf, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256({_fields("lowered")}) ELSE sha256({_fields("text")}) END AS now FROM c),
l AS (SELECT row_number() OVER () AS row, doc_id, coalesce('1' || source, '0') AS grp, leaf, now, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM h WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
u AS (SELECT grp, 0 AS level, place, leaf AS digest, n FROM l UNION ALL SELECT grp, level + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY grp, level, place // 16, n),
s AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM u WHERE n = 1),
v AS (SELECT 0 AS level, place, subroot AS digest, n FROM s UNION ALL SELECT level + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place)), (n + 15) // 16 FROM v WHERE n > 1 GROUP BY level, place // 16, n),
ur AS (SELECT grp, level, place // 16 AS run, list(digest ORDER BY place) AS ds FROM u WHERE n > 1 GROUP BY ALL),
vr AS (SELECT level, place // 16 AS run, list(digest ORDER BY place) AS ds FROM v WHERE n > 1 GROUP BY ALL),
p AS (SELECT row, grp, 0 AS level, place, n, now, '' AS proof FROM l UNION ALL
SELECT row, grp, level + 1, place // 16, (n + 15) // 16, sha256(array_to_string(ds[1:place % 16], '') || now || array_to_string(ds[place % 16 + 2:], '')), proof || array_to_string(ds[1:place % 16], '') || array_to_string(ds[place % 16 + 2:], '') FROM p JOIN ur USING (grp, level) WHERE n > 1 AND run = place // 16),
q AS (SELECT row, 0 AS level, s.place, s.n, now, proof FROM p JOIN s USING (grp) WHERE p.n = 1 UNION ALL
SELECT row, level + 1, place // 16, (n + 15) // 16, sha256(array_to_string(ds[1:place % 16], '') || now || array_to_string(ds[place % 16 + 2:], '')), proof || array_to_string(ds[1:place % 16], '') || array_to_string(ds[place % 16 + 2:], '') FROM q JOIN vr USING (level) WHERE n > 1 AND run = place // 16),
r AS (SELECT digest AS root FROM v WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, q.now AS folded_root, q.now = root AS verified FROM q JOIN l USING (row) JOIN s ON s.grp = l.grp, r WHERE q.n = 1""",
}
