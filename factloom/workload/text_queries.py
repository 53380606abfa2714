"""Text, splitting and normalisation operators over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import rules as R
from factloom.functions import text as T
from factloom.sources.tables import annotated_sentences, facts, sentences, spread, table
from factloom.workload.base import (LOWER_COLLAPSED, SENTENCES_SQL, TRIGRAMS_SQL, annotated_sql, facts_sql,
                                    predicate_key_sql, register, sql_cue, with_sql)


@register("p2_sentence_split", with_sql(SENTENCES_SQL, """
SELECT doc_id, pos, char_start, char_end, sha1(body) AS body_sha FROM sents"""))
def p2(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", "char_start", "char_end", F.sha1("body").alias("body_sha"))


@register("p1_paragraph_split", r"""
WITH parts AS (SELECT conv_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (
  SELECT conv_id, string_split(regexp_replace(text, '(\n\s*\n+)', '\1' || chr(1), 'g'), chr(1)) AS ps FROM (
    SELECT conv_id, string_agg(text, E'\n\n' ORDER BY turn) AS text FROM conversations GROUP BY conv_id))),
placed AS (SELECT *, trim(piece, E' \t\n\r\f') AS body, coalesce(sum(length(piece)) OVER (
  PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM parts)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS pos,
  CAST(base + length(piece) - length(ltrim(piece, E' \t\n\r\f')) AS BIGINT) AS char_start,
  length(body) AS n, sha1(body) AS body_sha
FROM placed WHERE body <> ''""")
def p1(spark, sf):
    turns = table(spark, sf, "conversations")
    docs = turns.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n\n").alias("text"))
    return T.explode_sections(docs, "text", "paragraph").select(
        "conv_id", "pos", "char_start", F.length("body").alias("n"), F.sha1("body").alias("body_sha"))


@register("p4_parsed_document", with_sql(SENTENCES_SQL, r"""
SELECT 'user-' || substr(sha1(source || chr(0) || text), 1, 10) AS celex, source AS title,
  coalesce(n, 0) AS n_recitals, last_number, length(text) AS preamble_chars
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, '(' || count(*) || ')' AS last_number FROM sents GROUP BY doc_id)
USING (doc_id)"""))
def p4(spark, sf):
    from factloom.operators.parsing import parsed_document_of_text
    docs = spread(table(spark, sf, "documents")).select("source", "text")
    parsed = docs.select(parsed_document_of_text("source", "text", "sentence").alias("d"))
    return parsed.select(
        "d.celex", "d.title", F.size("d.recitals").alias("n_recitals"),
        F.try_element_at("d.recitals", F.lit(-1))["number"].alias("last_number"),
        F.length("d.preamble_text").alias("preamble_chars"))


@register("s9_pasted_text_id", """
SELECT doc_id, 'user-' || substr(sha1(source || chr(0) || text), 1, 10) AS user_doc_id FROM documents""")
def s9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.pasted_text_id("source", "text").alias("user_doc_id"))


@register("x1_collapse_whitespace", r"""
SELECT doc_id, sha1(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed_sha FROM documents""")
def x1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1(T.collapse("text")).alias("collapsed_sha"))


@register("x9_word_count", r"""
SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n_words FROM documents""")
def x9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count("text").alias("n_words"))


ENTITY_SQL = r"""
ents AS (SELECT DISTINCT surface AS raw FROM (
  SELECT subject AS surface FROM annotated UNION ALL
  SELECT object || CASE WHEN pos % 3 = 0 THEN ' of 12 March 2004' WHEN pos % 3 = 1 THEN ' in 2005, the rest' ELSE '' END
  FROM annotated) WHERE surface <> ''),
dated AS (SELECT raw,
    list_filter(list_transform(regexp_extract_all(raw,
      '(?i)\s*(?:of \d{1,2} \w+ \d{4}|in (?:19|20)\d{2}|on \d{1,2} \w+ \d{4}|\((?:19|20)\d{2}\))'),
      lambda q: trim(q)), lambda q: q <> '') AS dates,
    string_split_regex(trim(regexp_replace(regexp_replace(raw,
      '(?i)\s*(?:of \d{1,2} \w+ \d{4}|in (?:19|20)\d{2}|on \d{1,2} \w+ \d{4}|\((?:19|20)\d{2}\))', '', 'g'),
      '(?i)^(?:the|a|an|this|that|these|those|its|their)\s+', '')), '\s+') AS toks FROM ents),
cuts AS (SELECT *, list_position(list_transform(toks[3:len(toks)], lambda t: lower(t) IN
  ('of','in','on','to','for','by','with','under','at','from','concerning','regarding')), true) AS found FROM dated),
cores AS (SELECT raw, dates, CASE
    WHEN len(toks) <= 6 THEN toks
    WHEN found IS NOT NULL AND found > 0 THEN toks[1:least(found + 1, 8)] ELSE toks[1:8] END AS kept,
  CASE WHEN len(toks) > 6 AND found > 0 THEN trim(array_to_string(toks[found + 2:len(toks)], ' '), ' ,;:.') ELSE '' END AS tail
  FROM cuts)"""


@register("x2_split_entity", with_sql(annotated_sql() + "," + ENTITY_SQL, """
SELECT sha1(raw) AS surface_sha,
  coalesce(nullif(trim(array_to_string(kept, ' '), ' ,;:.'), ''), trim(raw)) AS core,
  array_to_string(CASE WHEN tail <> '' THEN list_append(dates, tail) ELSE dates END, '|') AS qualifiers FROM cores"""))
def x2(spark, sf):
    a = annotated_sentences(spark, sf)
    tail = (F.when(F.col("pos") % 3 == 0, F.lit(" of 12 March 2004"))
            .when(F.col("pos") % 3 == 1, F.lit(" in 2005, the rest")).otherwise(F.lit("")))
    surfaces = a.select(F.explode(F.array("subject", F.concat("object", tail))).alias("raw"))
    e = surfaces.where("raw <> ''").distinct().withColumn("e", T.split_entity("raw"))
    return e.select(F.sha1("raw").alias("surface_sha"), "e.core",
                    F.array_join("e.qualifiers", "|").alias("qualifiers"))


@register("x4_predicate_key", with_sql(facts_sql(), f"""
SELECT fact_id, {predicate_key_sql("'shall be ' || predicate")} AS led_key,
  {predicate_key_sql('predicate')} AS predicate_key, {LOWER_COLLAPSED.format(x='predicate')} AS predicate_norm FROM facts"""))
def x4(spark, sf):
    return facts(spark, sf).select(
        "fact_id", T.predicate_key(F.concat(F.lit("shall be "), "predicate")).alias("led_key"),
        T.predicate_key("predicate").alias("predicate_key"), T.predicate_norm("predicate").alias("predicate_norm"))


@register("x6_display_label", with_sql(facts_sql(), """
SELECT fact_id, CASE WHEN length(object) <= 34 THEN object ELSE rtrim(substring(object, 1, 33)) || '…' END AS label FROM facts"""))
def x6(spark, sf):
    return facts(spark, sf).select("fact_id", T.display_label("object").alias("label"))


@register("x7_fact_and_group_ids", with_sql(facts_sql(), "SELECT fact_id, group_id, annotator, doc_id FROM facts"))
def x7(spark, sf):
    return facts(spark, sf).select("fact_id", "group_id", "annotator", "doc_id")


@register("x10_model_directory", """
SELECT DISTINCT source, translate(source || ':4.5b/x', ':/', '__') AS writer_dir,
  translate(source || ':4.5b/x', ':/.', '___') AS serving_dir FROM documents""")
def x10(spark, sf):
    tag = F.concat("source", F.lit(":4.5b/x"))
    return table(spark, sf, "documents").select(
        "source", T.model_directory(tag).alias("writer_dir"),
        T.model_directory(tag, keep_dots=False).alias("serving_dir")).distinct()


@register("x13_capitalised_statement", with_sql(facts_sql(), """
SELECT fact_id, upper(substring(s, 1, 1)) || substring(s, 2) AS statement FROM (
  SELECT fact_id, subject || ' ' || predicate || CASE WHEN object IN ('', 'null') THEN '' ELSE ' ' || object END || '.' AS s FROM facts)"""))
def x13(spark, sf):
    return facts(spark, sf).select("fact_id", T.capitalised_statement("subject", "predicate", "object").alias("statement"))


@register("p13_fact_text", with_sql(facts_sql(), """
SELECT fact_id, natural_language AS text, trim(subject || ' ' || predicate || ' ' || object) AS triple_text FROM facts"""))
def p13(spark, sf):
    f = facts(spark, sf)
    return f.select("fact_id", T.fact_text("natural_language", "subject", "predicate", "object").alias("text"),
                    T.fact_text(F.lit("  "), "subject", "predicate", "object").alias("triple_text"))


@register("p9_container_and_label", with_sql(facts_sql(), """
SELECT fact_id, 'preamble' AS container, 'Recital ' || (CAST(regexp_extract(section_path, '(\\d+)', 1) AS BIGINT) + 1) AS label
FROM facts""".replace("\\\\", "\\")))
def p9(spark, sf):
    path = F.col("source_locator.section_path")
    return facts(spark, sf).select("fact_id", T.container_of(path).alias("container"), T.section_label(path).alias("label"))


@register("f10_text_flags", with_sql(facts_sql(), f"""
SELECT fact_id, (condition <> '' OR {sql_cue("t", R.CONDITION_CUE)}) AS conditional, {sql_cue("t", R.NEGATION_CUE)} AS negated,
  {sql_cue("t", R.COMPLEXITY_CUE)} AS is_complex,
  CASE WHEN {sql_cue("t", R.MODALITY_CUE)} THEN 'alleged' ELSE 'asserted' END AS modality
FROM (SELECT *, quote || ' ' || natural_language AS t FROM facts)"""))
def f10(spark, sf):
    f = facts(spark, sf).withColumn("t", T.provenance_text(
        "source_locator.quote", "source_locator.linearized_sentence", "natural_language"))
    return f.select("fact_id", R.is_conditional("condition", "t").alias("conditional"), R.is_negated("t").alias("negated"),
                    R.is_complex("t").alias("is_complex"), R.modality("t").alias("modality"))


@register("l1a_numbers", with_sql(facts_sql(), r"""
SELECT fact_id, array_to_string(regexp_extract_all(trim(subject || ' ' || object), '\d+[,.]?\d*'), '|') AS numbers FROM facts"""))
def l1a(spark, sf):
    return facts(spark, sf).select("fact_id", F.array_join(R.numbers(T.subject_object_text("subject", "object")), "|").alias("numbers"))


@register("l1b_polarity_tokens", with_sql(facts_sql(), r"""
SELECT fact_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(
  regexp_extract_all(regexp_replace(natural_language, '(?i)\bno\.?\s*\d', ' ', 'g'), '[A-Za-z]+'), lambda x: lower(x)),
  lambda x: x IN ('not','no','never','without','fails','failed','unable')))), '|') AS polarity FROM facts"""))
def l1b(spark, sf):
    return facts(spark, sf).select("fact_id", F.array_join(R.polarity_tokens("natural_language"), "|").alias("polarity"))


JACCARD_SQL = """CASE WHEN len(ta) = 0 AND len(tb) = 0 THEN 1.0 WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0
  ELSE CAST(len(list_intersect(ta, tb)) AS DOUBLE) / (len(ta) + len(tb) - len(list_intersect(ta, tb))) END"""


@register("c6_trigram_jaccard", with_sql(annotated_sql(), f"""
SELECT doc_id, pos, round({JACCARD_SQL}, 6) AS overlap FROM (SELECT doc_id, pos,
  {TRIGRAMS_SQL.format(x='x')} AS ta, {TRIGRAMS_SQL.format(x='y')} AS tb FROM (
  SELECT doc_id, pos, {LOWER_COLLAPSED.format(x="subject || ' ' || object")} AS x,
    {LOWER_COLLAPSED.format(x="subject || ' ' || half")} AS y FROM annotated))"""))
def c6(spark, sf):
    a = annotated_sentences(spark, sf)
    return a.select("doc_id", "pos", F.round(R.trigram_jaccard(
        F.concat("subject", F.lit(" "), "object"), F.concat("subject", F.lit(" "), "half")), 6).alias("overlap"))


@register("x8_fact_hue", None)
def x8(spark, sf):
    return facts(spark, sf).select("fact_id", T.fnv1a_hue("fact_id").alias("hue"))
