"""HTML pages as documents.

A small tokenizer turns a page into its leaf blocks; every decision about the
blocks (regions, recitals, articles, annexes, table headers) is a Spark expression.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.schema import DOCUMENT_STRUCT

BLOCK = ("struct<tag:string,cls:string,text:string,"
         "rows:array<struct<head:boolean,cells:array<struct<th:boolean,text:string>>>>>")

# Challenge pages, document renderings and the size that passes as a document.
CHALLENGE_MARKS = ["awswaf", "AwsWafIntegration", "challenge-container"]
DOCUMENT_MARKS = ["oj-doc-ti", "FORMEX", "celex/"]
DOCUMENT_CHARS = 20_000
# Landmarks inside block texts.
ENACTING = r"(?i)HAS\s+ADOPTED\s+THIS\s+(?:REGULATION|DECISION|DIRECTIVE|RECOMMENDATION)"
ANNEX_HEAD = r"(?i)^ANNEX(?:\s+([IVX0-9]+))?\b"
ARTICLE_HEAD = r"(?i)^Article\s+([0-9]+[a-zA-Z]?)\b"
RECITAL_NUMBER = r"^\(\s*([0-9]+|[ivxIVX]+|[a-zA-Z])\s*\)\s*$"


def looks_like_challenge(html) -> Column:
    c = T._col(html)
    return F.exists(F.array(*[F.lit(m) for m in CHALLENGE_MARKS]), lambda m: F.contains(c, m))


def looks_like_document(html) -> Column:
    c = T._col(html)
    return F.exists(F.array(*[F.lit(m) for m in DOCUMENT_MARKS]), lambda m: F.contains(c, m)) | (F.length(c) > DOCUMENT_CHARS)


class _Blocks(HTMLParser):
    """Collects p, h1-h6, li and title texts, bare div texts, and tables as rows of cells."""

    LEAF = {"p", "li", "title", "h1", "h2", "h3", "h4", "h5", "h6"}
    SILENT = {"script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.stack, self.silent, self.table, self.depth, self.in_head = [], [], 0, None, 0, False

    def handle_starttag(self, tag, attrs):
        classes = dict(attrs).get("class") or ""
        if tag in self.SILENT:
            self.silent += 1
        elif tag == "table":
            self.depth += 1
            if self.depth == 1:
                self._flush_div()
                self.table = {"tag": "table", "cls": classes, "text": [], "rows": []}
                self.blocks.append(self.table)
        elif self.table is not None:
            if tag == "thead":
                self.in_head = True
            elif tag == "tr":
                self.table["rows"].append({"head": self.in_head, "cells": []})
            elif tag in ("td", "th") and self.table["rows"]:
                self.table["rows"][-1]["cells"].append({"th": tag == "th", "text": []})
        elif tag in self.LEAF or tag == "div":
            self._flush_div()
            self.stack.append({"tag": tag, "cls": classes, "text": [], "rows": []})
            self.blocks.append(self.stack[-1])

    def _flush_div(self):
        # text that follows inside the same div starts a new block after its children
        if self.stack and self.stack[-1]["tag"] == "div" and any(t.strip() for t in self.stack[-1]["text"]):
            top = self.stack[-1]
            self.stack[-1] = {"tag": "div", "cls": top["cls"], "text": [], "rows": []}

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self.table = None
        elif self.table is not None:
            self.in_head = self.in_head and tag != "thead"
        elif tag in self.LEAF or tag == "div":
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at]["tag"] == tag:
                    del self.stack[at:]
                    break
            if self.stack and self.stack[-1]["tag"] == "div":
                again = {"tag": "div", "cls": self.stack[-1]["cls"], "text": [], "rows": []}
                self.stack[-1] = again
                self.blocks.append(again)

    def handle_data(self, data):
        if self.silent:
            return
        if self.table is not None:
            self.table["text"].append(data)
            if self.table["rows"] and self.table["rows"][-1]["cells"]:
                self.table["rows"][-1]["cells"][-1]["text"].append(data)
        elif self.stack:
            self.stack[-1]["text"].append(data)


def _tidy(parts) -> str:
    return " ".join(" ".join(parts).split())


def _blocks_of(page: str | None) -> list[dict]:
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    out = []
    for b in parser.blocks:
        rows = [{"head": r["head"], "cells": [{"th": c["th"], "text": _tidy(c["text"])} for c in r["cells"]]} for r in b["rows"]]
        text = _tidy(b["text"])
        if text or rows:
            out.append({"tag": b["tag"], "cls": b["cls"], "text": text, "rows": rows})
    return out


def html_blocks(page) -> Column:
    """Leaf blocks of a page in document order."""
    @F.pandas_udf(f"array<{BLOCK}>")
    def tokenize(pages: pd.Series) -> pd.Series:
        return pages.map(_blocks_of)

    return tokenize(page)


def page_title(blocks: str) -> Column:
    titled = F.filter(blocks, lambda b: F.array_contains(F.split(b["cls"], " "), "oj-doc-ti"))
    plain = F.filter(blocks, lambda b: b["tag"] == "title")
    return F.coalesce(F.get(titled, F.lit(0))["text"], F.get(plain, F.lit(0))["text"], F.lit(""))


def _first(blocks: str, test) -> Column:
    at = F.array_position(F.transform(blocks, test), True)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.lit(1 << 30))


def _is_layout_table(b) -> Column:
    sample = F.slice(b["rows"], 1, 5)
    return ((b["tag"] == "table") & (F.size(b["rows"]) > 0)
            & ~F.exists(b["rows"], lambda r: F.exists(r["cells"], lambda c: c["th"]))
            & F.forall(sample, lambda r: F.size(r["cells"]) == 2)
            & F.exists(sample, lambda r: F.get(r["cells"], F.lit(0))["text"].rlike(RECITAL_NUMBER)))


def table_parts(block: Column) -> Column:
    """struct(headers, rows): header row by thead, by all-th, or by short digit-free cells; rows padded or cut."""

    def shape(b):
        rows = F.filter(b["rows"], lambda r: (F.size(r["cells"]) > 0) | r["head"])
        return F.struct(rows.alias("rows"), F.array_position(F.transform(rows, lambda r: r["head"]), True).cast("int").alias("thead"))

    def header(s):
        first = F.get(s["rows"], F.lit(0))["cells"]
        obvious = (F.size(first) > 0) & (
            F.forall(first, lambda c: c["th"])
            | (F.forall(first, lambda c: F.length(c["text"]) <= 40) & F.forall(first, lambda c: ~c["text"].rlike(r"\d{2,}"))))
        at = F.when(s["thead"] > 0, s["thead"]).when(F.coalesce(obvious, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
        return F.struct(s["rows"].alias("rows"), at.alias("at"))

    def build(h):
        names = F.when(h["at"] > 0, F.transform(F.get(h["rows"], h["at"] - 1)["cells"], lambda c: c["text"])).otherwise(
            F.array().cast("array<string>"))
        body = F.filter(F.filter(h["rows"], lambda r, i: i + 1 != h["at"]), lambda r: F.size(r["cells"]) > 0)
        return F.struct(names.alias("headers"), F.transform(body, lambda r: F.transform(r["cells"], lambda c: c["text"])).alias("rows"))

    def level(t):
        width = F.when(F.size(t["headers"]) > 0, F.size(t["headers"])).otherwise(F.size(F.get(t["rows"], F.lit(0))))
        return F.struct(t["headers"].alias("headers"), F.transform(t["rows"], lambda r: F.slice(
            F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), F.lit(1), width)).alias("rows"))

    return T.let(T.let(T.let(T.let(block, shape), header), build), level)


def _with_offsets(items: Column, length) -> Column:
    """Start offsets of items joined by one line break."""
    return F.aggregate(items, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + length(x) + 1)))


def html_document(doc_id, blocks: str) -> Column:
    """A page as a document. Landmarks are tested on leaf blocks, so a wrapper never hides a region."""
    marker = _first(blocks, lambda b: b["text"].rlike(ENACTING))
    annex = _first(blocks, lambda b: b["text"].rlike(ANNEX_HEAD))
    done = _first(blocks, lambda b: b["text"].rlike(r"(?i)^Done\s+at\b"))

    def regions(m):
        enacting = F.when(m["marker"] < F.least(m["annex"], m["done"]), m["marker"]).otherwise(F.lit(1 << 30))

        def region(i):
            last = F.greatest(*[F.when(p <= i, p).otherwise(F.lit(-1)) for p in (enacting, m["annex"], m["done"])])
            return (F.when(last < 0, F.lit("preamble")).when(last == m["done"], F.lit("trailer"))
                    .when(last == m["annex"], F.lit("annex")).otherwise(F.lit("enacting")))

        return F.filter(F.transform(m["blocks"], lambda b, i: F.struct(
            F.when(i == enacting, F.lit("marker")).otherwise(region(i)).alias("region"), b.alias("b"))), lambda x: x["b"]["tag"] != "title")

    def within(x, name):
        return F.transform(F.filter(x, lambda r: r["region"] == name), lambda r: r["b"])

    def recitals(pre):
        rows = F.flatten(F.transform(F.filter(pre, _is_layout_table), lambda b: F.filter(b["rows"], lambda r: F.size(r["cells"]) == 2)))
        items = F.filter(F.transform(rows, lambda r: F.struct(
            F.trim(F.get(r["cells"], F.lit(0))["text"]).alias("number"), F.get(r["cells"], F.lit(1))["text"].alias("text"))),
            lambda r: r["number"].rlike(RECITAL_NUMBER) & (r["text"] != ""))

        def place(x):
            return F.transform(x["i"], lambda r, n: F.struct(
                r["number"].alias("number"), r["text"].alias("text"), F.get(x["o"], n).alias("char_start"),
                (F.get(x["o"], n) + F.length(r["text"])).alias("char_end")))

        return T.let(T.let(items, lambda i: F.struct(i.alias("i"), _with_offsets(i, lambda r: F.length(r["text"])).alias("o"))), place)

    def grouped(body, is_head, build):
        """Blocks under each heading: the heading and what follows up to the next one."""
        def make(x):
            return F.transform(x["at"], lambda p, n: build(
                F.get(x["body"], p), F.slice(x["body"], p + 2, F.coalesce(F.get(x["at"], n + 1), F.size(x["body"])) - p - 1)))

        at = F.filter(F.transform(body, lambda b, i: F.when(is_head(b), i)), lambda i: i.isNotNull())
        return T.let(F.struct(body.alias("body"), at.alias("at")), make)

    def article_head(b):
        return F.array_contains(F.split(b["cls"], " "), "oj-ti-art") | (b["text"].rlike(ARTICLE_HEAD) & (F.length(b["text"]) < 60))

    def article(head, rest):
        number = F.regexp_extract(head["text"], ARTICLE_HEAD, 1)
        texts = F.transform(rest, lambda b: b["text"])
        at = F.array_position(F.transform(texts, lambda t: (F.length(t) < 80) & ~F.endswith(t, F.lit("."))), True)
        return F.struct(F.when(number != "", number).otherwise(head["text"]).alias("number"),
                        F.get(texts, (at - 1).cast("int")).alias("title"),
                        F.filter(texts, lambda t, i: i + 1 != at).alias("paragraphs"))

    def articles(enacting):
        body = F.filter(enacting, lambda b: b["tag"].isin("p", "div") & (b["text"] != ""))

        def place(x):
            return F.transform(x["i"], lambda a, n: F.struct(
                a["number"].alias("number"), a["title"].alias("title"), a["paragraphs"].alias("paragraphs"), F.get(x["o"], n).alias("char_start"),
                (F.get(x["o"], n) + F.length(F.array_join(a["paragraphs"], "\n"))).alias("char_end")))

        return T.let(T.let(grouped(body, article_head, article), lambda i: F.struct(
            i.alias("i"), _with_offsets(i, lambda a: F.length(F.array_join(a["paragraphs"], "\n"))).alias("o"))), place)

    def annex_head(b):
        return b["tag"].isin("p", "div") & b["text"].rlike(ANNEX_HEAD)

    def annex_of(head, rest):
        annex_id = F.regexp_extract(head["text"], ANNEX_HEAD, 1)
        tables = F.filter(F.transform(F.filter(rest, lambda b: (b["tag"] == "table") & ~_is_layout_table(b)), table_parts),
                          lambda t: F.size(t["rows"]) > 0)
        prose = F.filter(rest, lambda b: (b["text"] != "") & ((b["tag"] != "table") | _is_layout_table(b)))
        return F.struct(
            annex_id.alias("annex_id"), head["text"].alias("title"), F.array_join(F.transform(prose, lambda b: b["text"]), "\n").alias("prose"),
            F.transform(tables, lambda t, i: F.struct(annex_id.alias("annex_id"), i.alias("table_id"), t["headers"].alias("headers"), t["rows"].alias("rows"))).alias("tables"))

    def build(x):
        pre, enact, ann, trail = (within(x, n) for n in ("preamble", "enacting", "annex", "trailer"))
        paragraphs = F.transform(F.filter(pre, lambda b: b["tag"] == "p"), lambda b: b["text"])
        stop = F.array_position(F.transform(paragraphs, lambda t: F.lower(t).startswith("whereas")), True)
        cited = F.filter(paragraphs, lambda t, i: F.lower(t).startswith("having regard to") & ((stop == 0) | (i + 1 < stop)))
        recs, arts = recitals(pre), articles(enact)
        annex_body = F.filter(ann, lambda b: b["tag"].isin("p", "div", "table"))
        return F.struct(
            T._col(doc_id).alias("celex"), page_title(blocks).alias("title"), cited.alias("citations"), recs.alias("recitals"), arts.alias("articles"),
            grouped(annex_body, annex_head, annex_of).alias("annexes"),
            F.array_join(F.transform(F.filter(trail, lambda b: b["tag"] == "p"), lambda b: b["text"]), " ").alias("concluding_formulas"),
            F.array_join(F.transform(recs, lambda r: r["text"]), "\n").alias("preamble_text"),
            F.array_join(F.transform(arts, lambda a: F.array_join(a["paragraphs"], "\n")), "\n").alias("enacting_text"))

    marks = F.struct(F.col(blocks).alias("blocks"), marker.alias("marker"), annex.alias("annex"), done.alias("done"))
    return T.let(T.let(marks, regions), build).cast(DOCUMENT_STRUCT)
