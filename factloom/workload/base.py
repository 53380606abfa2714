"""Query registry and the SQL that repeats the derived fact tables in a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.sources.tables import MATCHED_FROM

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query; ``sql`` is its equivalent over the same tables, where one exists."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


SENTENCES_SQL = r"""
pieces AS (
  SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (
    SELECT doc_id, string_split(regexp_replace(text,
      '([.!?])(\s+)([A-Z"''(“])', '\1\2' || chr(1) || '\3', 'g'), chr(1)) AS ps
    FROM documents)),
placed AS (
  SELECT doc_id, i, piece, trim(piece, E' \t\n\r\f\x0b') AS body,
    coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM pieces),
sents AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos,
    CAST(base + length(piece) - length(ltrim(piece, E' \t\n\r\f\x0b')) AS BIGINT) AS char_start,
    CAST(base + length(piece) - length(ltrim(piece, E' \t\n\r\f\x0b')) + length(body) AS BIGINT) AS char_end,
    body
  FROM placed WHERE body <> '')"""

TRIGRAMS_SQL = """CASE WHEN length({x}) >= 3 THEN list_distinct(list_transform(
  range(1, length({x}) - 1), lambda i: substring({x}, i, 3))) ELSE [] END"""

LOWER_COLLAPSED = r"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"

KEY_WORDS = ("shall|must|may|should|will|would|can|could|is|are|be|been|being|was|were|am|"
             "has|have|had|does|do|did|hereby|to|the|a|an")


def predicate_key_sql(x: str) -> str:
    return f"regexp_replace({LOWER_COLLAPSED.format(x=x)}, '^(({KEY_WORDS}) )+', '')"


def sql_cue(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '(?i){pattern}')"


def annotated_sql(versions=("v1",)) -> str:
    edits = {"v1": "(doc_id * 31 + pos) % 10", "v2": "(doc_id * 17 + pos * 7 + 3) % 10"}
    rows = "\n UNION ALL ".join(
        f"SELECT '{v}' AS guideline_version, {edits[v]} AS edit, * FROM triples" for v in versions)
    return SENTENCES_SQL + r""",
tokens AS (
  SELECT *, list_filter(string_split_regex(body, '\s+'), lambda x: x <> '') AS w FROM sents),
triples AS (
  SELECT doc_id, pos, char_start, char_end, body,
    array_to_string(w[1:2], ' ') AS subject, coalesce(w[3], '') AS predicate,
    trim(array_to_string(w[4:len(w)], ' '), ' ,;:.') AS object
  FROM tokens),
annotated AS (
  SELECT *, array_to_string(o[1:(len(o) + 1) // 2], ' ') AS half,
    array_to_string(o[(len(o) + 1) // 2 + 1:len(o)], ' ') AS rest,
    'preamble.recitals[' || (pos // 4) || ']' AS section_path
  FROM (SELECT *, string_split(object, ' ') AS o FROM (""" + rows + ")))"


def _fact_sql(annotator: str, part: int, s: str, p: str, o: str, cond: str, start: str, end: str,
              where: str) -> str:
    return f"""
  SELECT guideline_version, CAST(doc_id AS VARCHAR) AS doc_id,
    substr(sha1(concat_ws('|', '{annotator}', doc_id, section_path, pos, {part})), 1, 16) AS fact_id,
    '{annotator}' AS annotator, {s} AS subject, {p} AS predicate, {o} AS object, {cond} AS condition,
    CASE WHEN pos % 11 = 0 THEN 'within two days' ELSE '' END AS temporal_context,
    substr(sha1(concat_ws('|', 'grp', '{annotator}', doc_id, section_path, pos)), 1, 16) AS group_id,
    CASE WHEN pos % 6 < 2 THEN 'lg' || (pos // 6) ELSE '' END AS logic_group,
    CASE WHEN pos % 6 < 2 THEN CASE WHEN pos % 12 < 6 THEN 'OR' ELSE 'AND' END ELSE '' END AS logic_op,
    {s} || CASE WHEN {p} = '' THEN '' ELSE ' ' || {p} END || CASE WHEN {o} = '' THEN '' ELSE ' ' || {o} END || '.' AS natural_language,
    section_path, CAST({start} AS BIGINT) AS char_start, CAST({end} AS BIGINT) AS char_end, body AS quote,
    'unlabeled' AS conflict_label, pos * 2 + {part} AS fact_pos, edit AS synth_op
  FROM annotated WHERE {where}"""


def facts_sql(versions=("v1",)) -> str:
    """CTE list ending in ``facts``."""
    mid = "(char_start + (char_end - char_start) // 2)"
    a = _fact_sql("ann_a", 0, "subject", "predicate",
                  "(CASE WHEN edit = 4 THEN trim(object || ' 2,3 %') ELSE object END)", "''",
                  "char_start", "char_end", "true")
    b0 = _fact_sql("ann_b", 0, "(CASE WHEN edit = 5 THEN 'the ' || subject ELSE subject END)",
                   "(CASE WHEN edit = 8 THEN trim('not ' || predicate) ELSE predicate END)",
                   "(CASE WHEN edit = 4 THEN trim(object || ' 2,8 %') WHEN edit IN (6, 7) THEN half ELSE object END)",
                   "(CASE WHEN edit = 9 THEN 'if ' || subject ELSE '' END)",
                   "char_start", f"(CASE WHEN edit IN (6, 7) THEN {mid} ELSE char_end END)", "edit <> 3")
    b1 = _fact_sql("ann_b", 1, "subject", "('also ' || predicate)", "rest", "''", mid, "char_end",
                   "edit = 7 AND rest <> ''")
    return annotated_sql(versions) + f",\nfacts AS MATERIALIZED ({a}\n  UNION ALL{b0}\n  UNION ALL{b1})"


def pairs_sql(versions=("v1",)) -> str:
    """CTE list ending in ``facts`` and ``pairs``."""
    words = "list_distinct(string_split(rtrim({x}, '.'), ' '))"
    shared = "round(len(list_intersect({a}, {b})) / sqrt(CAST(len({a}) * len({b}) AS DOUBLE)), 3)"
    return facts_sql(versions) + f""",
keyed AS MATERIALIZED (SELECT guideline_version, doc_id, fact_pos // 2 AS p, annotator, fact_pos % 2 AS part, fact_id,
  {words.format(x="natural_language")} AS w, {words.format(x="concat_ws(' ', subject, predicate)")} AS core
  FROM facts),
sides AS MATERIALIZED (SELECT a.guideline_version, a.doc_id, a.fact_id AS fa, b.fact_id AS fb, b.part,
  CASE WHEN b.fact_id IS NULL THEN {shared.format(a="a.w", b="a.core")} ELSE {shared.format(a="a.w", b="b.w")} END AS cosine
  FROM (SELECT * FROM keyed WHERE annotator = 'ann_a') a
  LEFT JOIN (SELECT * FROM keyed WHERE annotator = 'ann_b') b USING (guideline_version, doc_id, p)),
pairs AS MATERIALIZED (
  SELECT guideline_version, doc_id, 'ann_a' AS annotator_a, 'ann_b' AS annotator_b, fa AS fact_a_id, fb AS fact_b_id, cosine, 'matched' AS status
  FROM sides WHERE part = 0 AND cosine >= {MATCHED_FROM}
  UNION ALL SELECT guideline_version, doc_id, 'ann_a', 'ann_b', fa, NULL, cosine, 'unmatched_a' FROM sides
    WHERE fb IS NULL OR part = 0 AND cosine < {MATCHED_FROM}
  UNION ALL SELECT guideline_version, doc_id, 'ann_a', 'ann_b', NULL, fb, cosine, 'unmatched_b' FROM sides
    WHERE part = 1 OR part = 0 AND cosine < {MATCHED_FROM})"""


def with_sql(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"
