"""Registered queries of this package, one per operator, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import (decontaminate, licenses, line_dedup, merkle, ngram_join, packing, pii, quality, simhash_variants, spelling, topk, toxicity,
                          url_filter)
from factloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ngram_join.classes(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "class_id", "class_key", "n_links", "n_copies")


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


# The rules of the query.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@query
def op3_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).drop("url")


ORACLE["op3_url_digests"] = """
WITH u AS (SELECT row_number() OVER () AS rid, page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT any_value(page_id) AS page_id, any_value(host) AS host, any_value(path) AS path, arg_max(h || p, length(h || p)) AS rule,
  coalesce(arg_max(v, length(h || p)), 'allow') AS verdict
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid"""


@query
def op4_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(toxicity.fold("doc_id", quality.FOLDS) == quality.HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(toxicity.fold("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
                         F.size("restored").alias("n_restored"))


@query
def op6_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % topk.EVERY == 0)


ORACLE["op6_norm_bucket_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The query's key; a user brings a secret one.
SURROGATE_KEY = b"surrogates of the registered query"


@query
def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    of = F.transform("entities", lambda e: e["kind"])
    counts = [(F.size(of) - F.size(F.array_remove(of, k))).alias(f"n_{k}") for k in pii.KINDS]
    return pii.replace(docs, SURROGATE_KEY).select("doc_id", "text", F.size("entities").alias("n_entities"), *counts, F.sha2("text", 256).alias("text_sha256"))


@query
def op9_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
                      F.array_join("licenses", ",").alias("licenses"), F.array_join("license_classes", ",").alias("classes"))


def _license_sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in licenses.SENTENCES.items())
    rows = []
    for name, kind, wanted in licenses.RULES:
        rest, fits = "ids", []
        for w in wanted:
            fits.append(f"list_contains({rest}, '{w}')")
            rest = f"{rest}[list_position({rest}, '{w}') + 1:]"
        rows.append(f"CASE WHEN {' AND '.join(fits)} THEN {{'name': '{name}', 'kind': '{kind}'}} END")
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS ls FROM documents),
l AS (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
n AS (SELECT rid, pos, rtrim(ltrim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9.+-]+', ' ', 'g'), '[.] ', ' ', 'g'), ' '), '. ') AS sentence FROM l),
f AS (SELECT rid, list(id ORDER BY pos) AS ids FROM n JOIN known USING (sentence) GROUP BY rid),
h AS (SELECT rid, ids, list_filter([{', '.join(rows)}], lambda x: x IS NOT NULL) AS hits FROM f)
SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.name))), ','), '') AS licenses,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.kind))), ','), '') AS classes
FROM d LEFT JOIN h USING (rid)"""


ORACLE["op9_license_sentences"] = _license_sql()


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op10_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid"""


@query
def op11_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_variants.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = merkle.manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    fold = merkle.folded(F.col("claimed"), F.col("path"))
    return got.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
                      fold.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: Unsigned CRC-32 of an ASCII text in SQL: the table of bytes, then one step a byte.
CRC_TABLE = """list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)))"""
CRC_STEPS = """xor(list_reduce([4294967295] || list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(c >> 8, {1}[(xor(c, b) & 255) + 1])), 4294967295)"""

_FIELDS = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in merkle.LEAF_COLUMNS[:4])
ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS bytes),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({_FIELDS} || coalesce(strlen(text) || ':' || text, '-')) AS h,
    sha256({_FIELDS} || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS other,
    {CRC_STEPS.format("CAST(doc_id AS VARCHAR)", "bytes")} % 3 = 0 AS tampered FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM d),
low AS (SELECT 0 AS lvl, g, idx, h, n FROM leaves UNION ALL
  SELECT lvl + 1, g, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY lvl, g, idx // 8, n),
tops AS (SELECT g, h, max(lvl) OVER () AS deep, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 100 AS lvl, idx, h, n FROM tops UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM high WHERE n > 1 GROUP BY lvl, idx // 8, n),
step AS (
  SELECT a.g, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
  FROM low a JOIN low b ON a.g = b.g AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.g, a.lvl, a.idx
  UNION ALL
  SELECT NULL, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), ''),
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '')
  FROM high a JOIN high b ON a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.lvl, a.idx),
walk AS (
  SELECT v.g, v.idx AS leaf_idx, 0 AS lvl, v.idx, v.n, t.idx AS top_idx, t.n AS top_n, '' AS sib,
    CASE WHEN tampered THEN other ELSE v.h END AS acc FROM leaves v JOIN tops t ON v.g = t.g
  UNION ALL
  SELECT w.g, w.leaf_idx, CASE WHEN w.n = 1 AND w.lvl < 100 THEN 100 ELSE w.lvl + 1 END,
    CASE WHEN w.n = 1 AND w.lvl < 100 THEN w.top_idx ELSE w.idx // 8 END,
    CASE WHEN w.n = 1 AND w.lvl < 100 THEN w.top_n ELSE (w.n + 7) // 8 END, w.top_idx, w.top_n,
    w.sib || coalesce(s.l || s.r, ''), CASE WHEN s.l IS NULL THEN w.acc ELSE sha256(s.l || w.acc || s.r) END
  FROM walk w LEFT JOIN step s ON s.lvl = w.lvl AND s.idx = w.idx AND (s.g = w.g OR s.lvl >= 100) WHERE w.n > 1 OR w.lvl < 100)
SELECT v.doc_id, v.h AS leaf, t.h AS subroot, r.h AS root, sha256(w.sib) AS proof_sha256, w.acc AS folded_root, w.acc = r.h AS verified
FROM leaves v JOIN tops t ON v.g = t.g JOIN walk w ON w.g = v.g AND w.leaf_idx = v.idx AND w.lvl >= 100 AND w.n = 1
  JOIN high r ON r.n = 1"""


@query
def op13_spelling_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE["op13_spelling_pivots"] = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {CRC_TABLE} AS bytes),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
seen AS (SELECT run, doc_id, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, k, xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(doc_id || ':' || run))),
    lambda i: CAST(('0x' || hex(encode(doc_id || ':' || run))[2 * i + 1 : 2 * i + 2]) AS BIGINT)), lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM seen, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM hashed),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
gone AS (SELECT word, n, 0 AS i, word AS key FROM w UNION ALL SELECT word, n, i, left(word, CAST(i - 1 AS INTEGER)) || substr(word, CAST(i + 1 AS INTEGER)) FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (SELECT DISTINCT a.word, b.word AS near, b.n AS m FROM gone a JOIN gone b ON a.key = b.key AND a.word <> b.word WHERE a.i = b.i OR a.i = 0 OR b.i = 0),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n,
    CASE WHEN b.m >= 10 * w.n THEN (SELECT min(near) FROM pairs p WHERE p.word = w.word AND p.m = b.m) END AS form FROM w LEFT JOIN best b ON w.word = b.word),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f AS e ON e.word = walk.at AND e.form IS NULL"""
