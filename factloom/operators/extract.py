"""From annotator responses to facts: parsing, validation, quote anchoring, ids."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions import rules as R
from factloom.functions import text as T
from factloom.operators.anchors import fuzzy_anchor

ANCHOR_MIN_SCORE = 70.0  # fixed value: weaker anchors are dropped
GROUP_STRIDE = 1000  # places from one group to the next, unless a group is larger


def response_problem(raw: str = "response") -> Column:
    """Why a response is unusable, empty when it is fine. One fault rejects all of it.

    The response is parsed once, and arrays are told by a cast: the schema of a whole array costs more than the rest.
    """
    def text_field(obj, name):
        return f"coalesce(schema_of_variant(variant_get({obj}, '$.{name}')) = 'STRING' and " \
               f"variant_get({obj}, '$.{name}', 'string') rlike '\\\\S', false)"

    def let(name, value, use):
        return f"get(transform(array({value}), {name} -> {use}), 0)"

    spo = lambda o: " and ".join(text_field(o, n) for n in ("subject", "predicate", "object"))
    parts = f"case when coalesce(size(triples), 0) > 0 then forall(triples, t -> {spo('t')}) else {spo('f')} end"
    good_fact = (f"{text_field('f', 'natural_language')} and {text_field('f', 'source_quote')} and "
                 + let("triples", "try_variant_get(f, '$.triples', 'array<variant>')", parts))
    judged = ("case when v is null then 'not valid JSON' "
              "when variant_get(v, '$.facts') is null then 'no facts key' "
              "when facts is null then 'facts is not an array' "
              f"when not forall(facts, f -> {good_fact}) then 'missing or blank required field' else '' end")
    return F.expr(let("v", f"try_parse_json({raw})", let("facts", "try_variant_get(v, '$.facts', 'array<variant>')", judged)))


RESPONSE = ("struct<facts:array<struct<natural_language:string,source_quote:string,condition:string,temporal_context:string,"
            "logic_group:string,logic_op:string,subject:string,predicate:string,object:string,"
            "triples:array<struct<subject:string,predicate:string,object:string,condition:string,temporal_context:string>>>>>")


def parse_responses(responses: DataFrame, raw: str = "response") -> DataFrame:
    """One row per triple of every usable response, group fields inherited, ordinals kept.

    The outer explode keeps Spark from inferring a size filter, which would read the response a second time below.
    """
    keep = [c for c in responses.columns if c != raw]
    parsed = responses.where(response_problem(raw) == "").select(*keep, F.from_json(raw, RESPONSE).alias("_r"))
    groups = parsed.select(*keep, F.posexplode_outer("_r.facts").alias("group_index", "_f")).where("group_index is not null")
    own = F.array(F.struct(*[F.col(f"_f.{c}").alias(c) for c in ("subject", "predicate", "object", "condition", "temporal_context")]))
    triples = F.when(F.size(F.coalesce("_f.triples", F.array())) > 0, F.col("_f.triples")).otherwise(own)
    rows = groups.select(*keep, "group_index", "_f", F.posexplode(triples).alias("triple_index", "_t"))
    op = F.upper(T.strip(T.text_or_empty("_f.logic_op")))

    def inherited(name):
        return F.coalesce(T.strip(f"_t.{name}"), T.strip(f"_f.{name}"), F.lit(""))

    return rows.select(
        *keep, "group_index", "triple_index",
        *[T.strip(f"_t.{c}").alias(c) for c in ("subject", "predicate", "object")],
        inherited("condition").alias("condition"), inherited("temporal_context").alias("temporal_context"),
        T.strip("_f.natural_language").alias("natural_language"), T.strip("_f.source_quote").alias("source_quote"),
        T.strip(T.text_or_empty("_f.logic_group")).alias("logic_group"),
        F.when(op.isin(R.LOGIC_OPERATORS), op).otherwise(F.lit("")).alias("logic_op"))


def anchor_quotes(rows: DataFrame, quote: str = "source_quote", text: str = "section_text", base: str = "base_offset") -> DataFrame:
    """Locate quotes in their sections; what is found neither exactly nor closely is dropped.

    Exact search is native. All rows stay in one branch, so that what they come from runs once; of those found exactly,
    Python sees a null and no text.
    """
    exact = F.coalesce(F.col("_at") > 0, F.lit(False))
    placed = rows.withColumn("_at", F.instr(F.col(text), F.col(quote)))
    placed = placed.withColumn("_w", fuzzy_anchor(F.when(~exact, F.col(quote)), F.when(~exact, F.col(text)), ANCHOR_MIN_SCORE))
    start = F.when(exact, F.col("_at") - 1).otherwise(F.col("_w.start"))
    end = F.when(exact, F.col("_at") - 1 + F.length(quote)).otherwise(F.col("_w.end"))
    return placed.where(exact | (F.col("_w.score") >= ANCHOR_MIN_SCORE)).select(
        *rows.columns, (F.col(base) + start).cast("int").alias("char_start"), (F.col(base) + end).cast("int").alias("char_end"),
        F.when(exact, F.lit(100.0)).otherwise(F.col("_w.score")).alias("anchor_score"),
        F.when(exact, F.col(quote)).otherwise(F.col(text).substr(F.col("_w.start") + 1, F.col("_w.end") - F.col("_w.start"))).alias("matched_quote"))


def build_facts(anchored: DataFrame) -> DataFrame:
    """Facts with ids and prose locators. Needs doc_id, annotator, guideline_version, section_path.

    ``fact_pos`` orders an annotator's facts of a document by section, group and triple. Groups are ``GROUP_STRIDE``
    apart, or as far as the document's largest group needs, so no two triples share a place; a document of more groups
    than an int can hold places for raises an overflow instead.
    """
    whole = W.partitionBy("guideline_version", "doc_id", "annotator")
    group = F.dense_rank().over(whole.orderBy(T.section_order("section_path"), "section_path", "group_index")) - 1
    stride = F.greatest(F.lit(GROUP_STRIDE), F.max("triple_index").over(whole) + 1)
    return anchored.withColumn("_place", (group * stride + F.col("triple_index")).cast("int")).select(
        T.fact_id("annotator", "doc_id", "section_path", "group_index", "triple_index").alias("fact_id"),
        "doc_id", "annotator", "guideline_version", "subject", "predicate", "object", "condition", "temporal_context",
        T.group_id("annotator", "doc_id", "section_path", "group_index").alias("group_id"), "logic_group", "logic_op", "natural_language",
        F.struct(F.lit("prose").alias("source_type"), F.col("section_path").alias("section_path"), F.col("char_start").alias("char_start"),
                 F.col("char_end").alias("char_end"), F.col("matched_quote").alias("quote"), F.lit(None).cast("string").alias("annex_id"),
                 F.lit(None).cast("int").alias("table_id"), F.lit(None).cast("int").alias("row_idx"),
                 F.lit(None).cast("array<int>").alias("col_indices"), F.lit(None).cast("string").alias("linearized_sentence")).alias("source_locator"),
        F.lit("unlabeled").alias("conflict_label"),
        F.struct(F.col("anchor_score").alias("anchor_score"), F.col("source_quote").alias("model_quote"), F.col("triple_index").alias("triple_index")).alias("extra"),
        F.col("_place").alias("fact_pos"))


def ask_sections(sections: DataFrame, ask: Callable[[str], str], prompt: Column | None = None, attempts: int = 2) -> DataFrame:
    """``sections`` with ``response``, ``error`` and ``attempts``: a callable answers each section's prompt.

    A failing call leaves an empty response and the error of its last attempt; it never fails the job.
    """
    @F.pandas_udf("struct<response:string,error:string,attempts:int>")
    def call(questions: pd.Series) -> pd.DataFrame:
        out = []
        for q in questions:
            answer, error, turn = None, None, 0
            for turn in range(1, attempts + 1):
                try:
                    answer, error = ask(q), None
                    break
                except Exception as exc:  # noqa: BLE001
                    error = f"{type(exc).__name__}: {exc}"
            out.append((answer, error, turn))
        return pd.DataFrame(out, columns=["response", "error", "attempts"])

    asked = sections.withColumn("_a", call(F.col("text") if prompt is None else prompt))
    return asked.select(*sections.columns, "_a.response", "_a.error", "_a.attempts")


def annotate(sections: DataFrame, ask: Callable[[str], str], annotator: str, guideline_version: str = "v1", prompt: Column | None = None,
             attempts: int = 2) -> DataFrame:
    """Facts of one annotator in one go; ``ledger`` keeps the answers and errors of a run that is to be resumed."""
    rows = ask_sections(sections, ask, prompt, attempts).select(
        "doc_id", "section_path", "base_offset", F.col("text").alias("section_text"), F.lit(annotator).alias("annotator"),
        F.lit(guideline_version).alias("guideline_version"), "response")
    return build_facts(anchor_quotes(parse_responses(rows)))


def replace_span(existing: DataFrame, fresh: DataFrame, doc_id: str, annotator: str, start: int, end: int) -> DataFrame:
    """Facts after re-annotating a preamble span: old facts starting inside it give way to new ones."""
    loc = F.col("source_locator")
    inside = ((F.col("doc_id") == doc_id) & (F.col("annotator") == annotator) & F.coalesce(loc["section_path"].startswith("preamble"), F.lit(False))
              & F.coalesce((loc["char_start"] >= start) & (loc["char_start"] < end), F.lit(False)))
    return existing.where(~inside).unionByName(fresh)
