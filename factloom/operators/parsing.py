"""Documents as nested rows: building, parsing plain legal text, enumerating sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.schema import DOCUMENT_STRUCT


def section_array(text, mode: str) -> Column:
    """array<struct<number,text,char_start,char_end>> of one text."""
    pieces = T._pieces(text, mode)
    ends = F.aggregate(pieces, F.array(F.lit(0)),
                       lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))

    def place(piece, base):
        body = T.strip(piece)
        start = base + F.length(piece) - F.length(T.lstrip(piece))
        return F.struct(body.alias("text"), start.alias("char_start"), (start + F.length(body)).alias("char_end"))

    placed = F.filter(F.zip_with(pieces, F.slice(ends, F.lit(1), F.size(pieces)), place),
                      lambda s: s["text"] != "")
    return F.transform(placed, lambda s, i: F.struct(
        F.concat(F.lit("("), (i + 1).cast("string"), F.lit(")")).alias("number"),
        s["text"].alias("text"), s["char_start"].alias("char_start"), s["char_end"].alias("char_end")))


def parsed_document_of_text(title, text, mode: str = "paragraph", doc_id=None) -> Column:
    """A pasted text as a document whose sections are numbered recitals."""
    title, text = T._col(title), T._col(text)
    celex = T.pasted_text_id(title, text) if doc_id is None else T._col(doc_id)
    return F.struct(
        celex.alias("celex"), F.coalesce(F.nullif(title, F.lit("")), celex).alias("title"),
        F.array().cast("array<string>").alias("citations"), section_array(text, mode).alias("recitals"),
        F.array().alias("articles"), F.array().alias("annexes"), F.lit("").alias("concluding_formulas"),
        text.alias("preamble_text"), F.lit("").alias("enacting_text")).cast(DOCUMENT_STRUCT)


# --- plain legal text -------------------------------------------------------

# Landmarks of a legal act. (?md) gives line anchors at \n only.
ENACTING_MARK = r"(?i)HAS\s+ADOPTED\s+THIS\s+(?:REGULATION|DECISION|DIRECTIVE|RECOMMENDATION)[\s:]*"
TITLE_END = r"(?mdi)^\s*(?:THE\s+(?:COUNCIL|EUROPEAN|PARLIAMENT)|Having\s+regard\s+to)\b"
ANNEX_LINE = r"^\s*ANNEX(?:\s+([IVX0-9]+))?\b.*$"
DONE_AT = r"(?mdi)^\s*Done\s+at\b"
RECITAL_MARK = r"^\s*\(\s*([0-9]+|[ivxIVX]+)\s*\)\s+"
ARTICLE_LINE = r"^\s*Article\s+([0-9]+[a-zA-Z]?)\s*$"
WHEREAS_LINE = r"^\s*Whereas\b"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _at(text, pattern: str) -> Column:
    """0-based start of the first match, null when there is none."""
    found = F.regexp_instr(text, F.lit(pattern))
    return F.when(found > 0, found - 1)


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, LINE_BREAK), T.strip), lambda l: l != "")


def _runs(text: Column, flags: str, head: str, stop: str | None = None, body: str = ".*?") -> Column:
    """Adjacent blocks opened by ``head``: array<struct<piece,start,end>> with offsets into ``text``."""
    pattern = f"(?smd{flags}){head}{body}(?={stop or head}|\\z)"
    # a dot must not cross lines inside the head itself
    pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(x):
        ends = F.aggregate(x["p"], F.array(F.coalesce(x["first"], F.lit(0))),
                           lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
        return F.transform(x["p"], lambda p, i: F.struct(
            p.alias("piece"), F.get(ends, i).alias("start"), (F.get(ends, i) + F.length(p)).alias("end")))

    return T.let(F.struct(pieces.alias("p"), _at(text, f"(?md{flags})" + head).alias("first")), place)


def plain_text_document(doc_id, text, strict: bool = False) -> Column:
    """A flat legal act as a document: title, citations, recitals, articles, annexes.

    When the closing formula precedes the annex, the enacting part ends at the
    closing formula and the annex keeps its text; ``strict`` keeps the older
    reading, in which the last article swallows the formula and the annex is lost.
    """

    def regions(t):
        return F.struct(
            t.alias("text"), _at(t, TITLE_END).alias("title_end"), _at(t, ENACTING_MARK).alias("enacting"),
            F.length(F.regexp_extract(t, ENACTING_MARK, 0)).alias("enacting_len"),
            _at(t, "(?md)" + ANNEX_LINE).alias("annex"), _at(t, DONE_AT).alias("done"), F.length(t).alias("n"))

    def cut(t, start, end):
        return T.strip(t.substr(start + 1, F.greatest(end - start, F.lit(0))))

    def slices(r):
        preamble_end = F.coalesce(r["enacting"], r["annex"], r["done"], r["n"])
        start = F.when(r["enacting"].isNotNull(), r["enacting"] + r["enacting_len"]).otherwise(preamble_end)
        done_end = F.coalesce(r["done"], r["n"])
        if strict:
            enacting_end, annex_end, trailer_end = F.coalesce(r["annex"], r["done"], r["n"]), done_end, r["n"]
        else:
            enacting_end = F.coalesce(F.least(r["annex"], r["done"]), r["n"])
            annex_end = F.when(r["done"] > r["annex"], r["done"]).otherwise(r["n"])
            trailer_end = F.when(r["annex"] > r["done"], r["annex"]).otherwise(r["n"])
        zone = F.when(r["title_end"].isNotNull(), r["text"].substr(F.lit(1), r["title_end"])).otherwise(F.substring(r["text"], 1, 200))
        return F.struct(
            F.array_join(_lines(zone), " — ").alias("title"), cut(r["text"], F.lit(0), preamble_end).alias("preamble"),
            cut(r["text"], start, enacting_end).alias("enacting"),
            F.when(r["annex"].isNotNull(), cut(r["text"], r["annex"], annex_end)).otherwise(F.lit("")).alias("annex"),
            cut(r["text"], done_end, trailer_end).alias("trailer"))

    def recitals(preamble):
        numbered = F.filter(F.transform(_runs(preamble, "", RECITAL_MARK, r"^\s*\(\s*[0-9ivxIVX]+\s*\)\s+", ".+?"), lambda r: F.struct(
            F.concat(F.lit("("), F.regexp_extract(r["piece"], "(?md)" + RECITAL_MARK, 1), F.lit(")")).alias("number"),
            T.collapse(F.regexp_replace(r["piece"], r"\A\s*\(\s*(?:[0-9]+|[ivxIVX]+)\s*\)\s+", "")).alias("text"),
            r["start"].alias("char_start"), r["end"].alias("char_end"))), lambda r: r["text"] != "")
        whereas = F.transform(_runs(preamble, "", WHEREAS_LINE), lambda r, i: F.struct(
            F.concat(F.lit("("), (i + 1).cast("string"), F.lit(")")).alias("number"), T.collapse(r["piece"]).alias("text"),
            r["start"].alias("char_start"), r["end"].alias("char_end")))
        return T.let(numbered, lambda n: F.when(F.size(n) > 0, n).otherwise(whereas))

    def article(r):
        body = _lines(F.regexp_replace(r["piece"], r"(?i)\A\s*Article\s+[0-9]+[a-zA-Z]?", ""))

        def build(lines):
            first = F.get(lines, F.lit(0))
            titled = F.coalesce((F.length(first) < 80) & ~F.endswith(first, F.lit(".")), F.lit(False))
            return F.struct(
                F.regexp_extract(r["piece"], r"(?i)\A\s*Article\s+([0-9]+[a-zA-Z]?)", 1).alias("number"),
                F.when(titled, first).alias("title"),
                F.when(titled, F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines).alias("paragraphs"),
                r["start"].alias("char_start"), r["end"].alias("char_end"))

        return T.let(body, build)

    def annex(r):
        head = F.regexp_extract(r["piece"], r"(?md)\A\s*ANNEX(?:\s+([IVX0-9]+))?\b.*$", 0)
        return F.struct(
            F.regexp_extract(r["piece"], r"(?md)\A\s*ANNEX(?:\s+([IVX0-9]+))?\b.*$", 1).alias("annex_id"), T.strip(head).alias("title"),
            T.strip(r["piece"].substr(F.length(head) + 1, F.length(r["piece"]))).alias("prose"), F.array().alias("tables"))

    def build(s):
        citations = F.transform(F.filter(_lines(s["preamble"]), lambda l: F.lower(l).startswith("having regard to")),
                                lambda l: F.rtrim(l, F.lit(",")))
        return F.struct(
            T._col(doc_id).alias("celex"), s["title"].alias("title"), citations.alias("citations"),
            recitals(s["preamble"]).alias("recitals"),
            F.transform(_runs(s["enacting"], "i", ARTICLE_LINE), article).alias("articles"),
            F.transform(_runs(s["annex"], "", r"^\s*ANNEX(?:\s+[IVX0-9]+)?\b[^\n]*$"), annex).alias("annexes"),
            s["trailer"].alias("concluding_formulas"), s["preamble"].alias("preamble_text"), s["enacting"].alias("enacting_text"))

    return T.let(T.let(T.let(T._col(text), regions), slices), build).cast(DOCUMENT_STRUCT)


def sections(documents: DataFrame, document: str = "document", with_blank: bool = False) -> DataFrame:
    """(doc_id, section_path, container, base_offset, text): recitals, then articles."""
    recital = F.transform(f"{document}.recitals", lambda r, i: F.struct(
        F.concat(F.lit("preamble.recitals["), i.cast("string"), F.lit("]")).alias("section_path"), F.lit("preamble").alias("container"),
        r["char_start"].alias("base_offset"), r["char_end"].alias("end"), i.alias("ordinal")))
    article = F.transform(f"{document}.articles", lambda a, i: F.struct(
        F.concat(F.lit("enacting.article_"), a["number"]).alias("section_path"), F.lit("enacting").alias("container"),
        a["char_start"].alias("base_offset"), a["char_end"].alias("end"), i.alias("ordinal")))
    rows = documents.select(
        F.col(f"{document}.celex").alias("doc_id"), F.col(f"{document}.preamble_text").alias("_p"), F.col(f"{document}.enacting_text").alias("_e"),
        F.explode(F.concat(recital, article)).alias("s"))
    container = F.when(F.col("s.container") == "preamble", F.col("_p")).otherwise(F.col("_e"))
    out = rows.select("doc_id", "s.section_path", "s.container", "s.base_offset", "s.ordinal",
                      container.substr(F.col("s.base_offset") + 1, F.col("s.end") - F.col("s.base_offset")).alias("text"))
    return out if with_blank else out.where(T.strip("text") != "")


def containers(documents: DataFrame, document: str = "document") -> DataFrame:
    """(doc_id, container, n_chars)."""
    return documents.select(F.col(f"{document}.celex").alias("doc_id"), F.explode(F.array(
        F.struct(F.lit("preamble").alias("container"), F.length(T.text_or_empty(f"{document}.preamble_text")).alias("n_chars")),
        F.struct(F.lit("enacting").alias("container"), F.length(T.text_or_empty(f"{document}.enacting_text")).alias("n_chars")))).alias("c")).select("doc_id", "c.*")


def quality_rejection(document: str = "document") -> Column:
    """Why a document is not worth annotating; empty when it is."""
    d = F.col(document)
    n_rec, n_cit, n_enact = F.size(d["recitals"]), F.size(d["citations"]), F.length(T.text_or_empty(d["enacting_text"]))
    return (F.when(F.length(T.strip(T.text_or_empty(d["title"]))) < 5, F.lit("title missing or too short"))
            .when(F.size(d["articles"]) < 1, F.lit("no articles parsed"))
            .when((n_rec < 2) & (n_cit < 2), F.format_string("thin preamble (recitals=%d, citations=%d)", n_rec, n_cit))
            .when(n_enact < 200, F.format_string("enacting_text too short (%d chars)", n_enact))
            .otherwise(F.lit("")))


def document_summary(documents: DataFrame, document: str = "document") -> DataFrame:
    d = F.col(document)
    return documents.select(
        d["celex"].alias("doc_id"), d["title"].alias("title"), F.size(d["citations"]).alias("n_citations"),
        F.size(d["recitals"]).alias("n_recitals"), F.size(d["articles"]).alias("n_articles"), F.size(d["annexes"]).alias("n_annexes"),
        F.aggregate(d["annexes"], F.lit(0), lambda n, a: n + F.size(a["tables"])).alias("n_tables"),
        F.aggregate(d["annexes"], F.lit(0), lambda n, a: n + F.aggregate(a["tables"], F.lit(0), lambda m, t: m + F.size(t["rows"]))).alias("n_rows"))


def linearised_rows(tables: DataFrame) -> DataFrame:
    """Table rows as sentences. Input columns: annex_id, table_id, headers, rows (plus any others)."""
    keep = [c for c in tables.columns if c not in ("headers", "rows")]
    rows = tables.select(*keep, "headers", F.posexplode("rows").alias("row_idx", "cells"))
    has_headers = F.exists(F.coalesce("headers", F.array().cast("array<string>")), lambda h: T.strip(h) != "")
    n = F.least(F.size("headers"), F.size("cells"))
    named = F.filter(F.zip_with(F.slice("headers", F.lit(1), n), F.slice("cells", F.lit(1), n), lambda h, c: F.when(
        c != "", F.concat(F.rtrim(h, F.lit(":")), F.lit(" = "), c))), lambda p: p.isNotNull())
    plain = F.array_join(F.filter("cells", lambda c: c != ""), " | ")
    body = F.when(has_headers & (F.size(named) > 0), F.array_join(named, "; ")).otherwise(plain)
    return rows.select(*keep, "row_idx", F.concat(
        F.lit("In Annex "), F.coalesce(F.nullif(F.col("annex_id"), F.lit("")), F.lit("(unnumbered)")), F.lit(", Table "),
        F.col("table_id").cast("string"), F.lit(", row "), F.col("row_idx").cast("string"), F.lit(": "), body, F.lit(".")).alias("sentence"))
