"""Drop lines that many documents share, with DataFrame functions only.

Every document's distinct line keys are exploded as 128-bit digests and counted
(a map-side sum first, so a line of a third of all documents costs one row per
task). Keys that reach the threshold are joined back to the documents that hold
them, gathered per document text, and the text is put together again from the
lines that stay, in their old order.

Defined cases: a null text is one empty line; empty lines and lines of white
space never count and stay; a repeated document row counts as a document of its
own; documents that lose every line keep an empty text; an empty table gives an
empty table; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import digest, fresh

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def common_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(t1, t2, h1, h2): for each text digest the digests of its lines found in at least ``min_docs`` documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = F.array_distinct(F.transform(_lines(text), line_key))
    t1, t2 = digest(text)
    held = docs.select(
        t1.alias("t1"), t2.alias("t2"),
        F.explode(F.filter(keys, lambda k: F.length(k) >= min_chars)).alias("k"),
    ).select("t1", "t2", *[h.alias(n) for h, n in zip(digest(F.col("k")), ("h1", "h2"))])
    often = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    return held.join(often, ["h1", "h2"], "left_semi")


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``kept`` (the text of the lines that stay), ``n_lines`` and ``n_dropped`` added.

    Added names that ``docs`` already has get underscores in front. Documents
    of equal text lose equal lines, so the marks are joined by text digest.
    """
    kept, n_lines, n_dropped, t1, t2, hot = fresh(docs, "kept", "n_lines", "n_dropped", "line_t1", "line_t2", "line_hot")
    marks = common_lines(docs, text_col, min_docs, min_chars).groupBy(
        F.col("t1").alias(t1), F.col("t2").alias(t2)).agg(F.collect_set("h1").alias(hot))
    text = F.coalesce(F.col(text_col), F.lit(""))
    d1, d2 = digest(text)
    joined = docs.withColumns({t1: d1, t2: d2}).join(marks, [t1, t2], "left")
    gone = lambda line: F.array_contains(F.col(hot), F.xxhash64(line_key(line)))
    stay = F.filter(_lines(text), lambda line: (F.length(line_key(line)) < min_chars) | ~gone(line))
    stay = F.when(F.col(hot).isNull(), _lines(text)).otherwise(stay)
    out = joined.withColumns({hot: stay, n_lines: F.size(_lines(text)).cast("long")})
    return out.select(*docs.columns, F.array_join(F.col(hot), "\n").alias(kept), n_lines,
                      (F.col(n_lines) - F.size(hot)).cast("long").alias(n_dropped))


def stage(docs: DataFrame) -> DataFrame:
    """``docs`` with texts cut to the lines that stay; ``n_chars`` follows the text."""
    out = dedup_lines(docs)
    kept = out.columns[len(docs.columns)]
    changed = {"text": F.col(kept)} | ({"n_chars": F.length(kept).cast("long")} if "n_chars" in docs.columns else {})
    return out.withColumns(changed).select(*docs.columns)
