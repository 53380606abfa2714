"""Scalar text functions. Every function maps Columns to Columns and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters a Python str treats as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java regex: one property lookup a character is three times as fast as a list of ranges.
WS = r"(?U:[\s\x1c-\x1f])"

# Punctuation trimmed from entity names.
ENTITY_EDGE_PUNCTUATION = " ,;:."

# Leading determiners, date phrases and prepositions of entity names.
DETERMINERS = "the|a|an|this|that|these|those|its|their"
DATE_PHRASE = (
    r"of \d{1,2} \w+ \d{4}|in (?:19|20)\d{2}|on \d{1,2} \w+ \d{4}|\((?:19|20)\d{2}\)"
)
PREPOSITIONS = ["of", "in", "on", "to", "for", "by", "with", "under", "at", "from",
                "concerning", "regarding"]

# Function words dropped from the front of a predicate.
LEADING_FUNCTION_WORDS = (
    "shall|must|may|should|will|would|can|could|is|are|be|been|being|was|were|am|"
    "has|have|had|does|do|did|hereby|to|the|a|an"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; plain reuse would repeat the work."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or_empty(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def strip(c) -> Column:
    """Trim Unicode white space on both sides (``trim`` alone only drops spaces)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def lstrip(c) -> Column:
    return F.ltrim(_col(c), F.lit(WHITESPACE))


def null_if_blank(c) -> Column:
    stripped = strip(c)
    return F.when(stripped != "", stripped)


def collapse(c) -> Column:
    """Runs of white space become one blank, ends are trimmed."""
    return F.btrim(F.regexp_replace(_col(c), WS + "+", " "), F.lit(" "))


def collapse_lower(c) -> Column:
    return collapse(F.lower(text_or_empty(c)))


def words(c) -> Column:
    return F.filter(F.split(_col(c), WS + "+"), lambda w: w != "")


def word_count(c) -> Column:
    return F.size(words(c))


def fact_text(natural_language, subject, predicate, obj) -> Column:
    """The sentence an annotator wrote, else the triple read aloud."""
    triple = F.concat(text_or_empty(subject), F.lit(" "), text_or_empty(predicate),
                      F.lit(" "), text_or_empty(obj))
    return F.coalesce(null_if_blank(natural_language), strip(triple))


def subject_object_text(subject, obj) -> Column:
    return strip(F.concat(text_or_empty(subject), F.lit(" "), text_or_empty(obj)))


def provenance_text(quote, linearized, natural_language) -> Column:
    """Quote (or table sentence) followed by the statement; input of the text flags."""
    return F.concat(
        F.coalesce(F.nullif(_col(quote), F.lit("")), F.nullif(_col(linearized), F.lit("")), F.lit("")),
        F.lit(" "), text_or_empty(natural_language))


def display_label(c, limit: int = 34) -> Column:
    value = strip(text_or_empty(c))
    cut = F.rtrim(F.substring(value, 1, limit - 1), F.lit(WHITESPACE))
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(cut, F.lit("…")))


def predicate_norm(c) -> Column:
    """Lower-case with collapsed white space (property-graph flavour)."""
    return collapse_lower(c)


def predicate_key(c) -> Column:
    """Also drops leading modals, auxiliaries and determiners; one token always stays."""
    return F.regexp_replace(collapse_lower(c), rf"^(?:(?:{LEADING_FUNCTION_WORDS}) )+(?=\S)", "")


def split_entity(c, max_tokens: int = 6) -> Column:
    """struct(core, qualifiers): the core noun phrase and the modifiers cut from it."""
    date_pattern = rf"(?iU)\s*(?:{DATE_PHRASE})"
    no_strings = F.array().cast("array<string>")

    def parse(raw):
        # every date phrase holds a digit, so most names are spared its pattern
        dated = raw.rlike(r"\p{Nd}")
        dates = F.when(dated, F.filter(F.transform(F.regexp_extract_all(raw, F.lit(date_pattern), F.lit(0)), strip),
                                       lambda q: q != "")).otherwise(no_strings)
        bare = F.regexp_replace(F.when(dated, F.regexp_replace(raw, date_pattern, "")).otherwise(raw), rf"(?iU)^(?:{DETERMINERS})\s+", "")
        return F.struct(raw.alias("raw"), dates.alias("dates"), words(bare).alias("tokens"))

    def locate(p):
        # 1-based position, inside tokens[2:], of the first preposition of a long name
        size = F.size(p["tokens"])
        found = F.array_position(
            F.transform(F.slice(p["tokens"], F.lit(3), F.greatest(size - 2, F.lit(0))),
                        lambda t: F.lower(t).isin(PREPOSITIONS)), True)
        return F.struct(p.alias("p"), F.when(size > max_tokens, found + 1).otherwise(0).cast("int").alias("cut"))

    def build(x):
        p, cut = x["p"], x["cut"]
        size = F.size(p["tokens"])
        kept = (F.when(size <= max_tokens, p["tokens"])
                .when(cut > 1, F.slice(p["tokens"], F.lit(1), F.least(cut, F.lit(max_tokens + 2))))
                .otherwise(F.slice(p["tokens"], F.lit(1), F.lit(max_tokens + 2))))
        core = F.btrim(F.array_join(kept, " "), F.lit(ENTITY_EDGE_PUNCTUATION))
        tail = F.btrim(F.array_join(F.slice(p["tokens"], cut + 1, size), " "), F.lit(ENTITY_EDGE_PUNCTUATION))
        tails = F.when(cut > 1, F.filter(F.array(tail), lambda t: t != "")).otherwise(no_strings)
        return F.struct(
            F.coalesce(F.nullif(core, F.lit("")), p["raw"]).alias("core"),
            F.concat(p["dates"], tails).alias("qualifiers"))

    return let(let(let(strip(text_or_empty(c)), parse), locate), build)


def entity_core(c, max_tokens: int = 6) -> Column:
    return split_entity(c, max_tokens)["core"]


def entity_qualifiers(c, max_tokens: int = 6) -> Column:
    """The qualifiers of ``split_entity``. Names without a digit and without a preposition have none and are not taken apart."""
    may = text_or_empty(c).rlike(rf"\p{{Nd}}|(?i:\b(?:{'|'.join(PREPOSITIONS)})\b)")
    return F.when(may, split_entity(c, max_tokens)["qualifiers"]).otherwise(F.array().cast("array<string>"))


def entity_surface(c) -> Column:
    """Stripped surface form, NULL for blanks and for the literal text ``null``."""
    surface = strip(c)
    return F.when((surface != "") & (F.lower(surface) != "null"), surface)


def sha_id(*parts, length: int = 16, prefix: str = "") -> Column:
    """Prefix plus the first hex digits of sha1 over the parts joined by ``|``."""
    joined = F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined), 1, length))


def fact_id(annotator, doc_id, section_path, group_index, triple_index) -> Column:
    return sha_id(annotator, doc_id, section_path, group_index, triple_index)


def group_id(annotator, doc_id, section_path, group_index) -> Column:
    return sha_id(F.lit("grp"), annotator, doc_id, section_path, group_index)


def pasted_text_id(title, text) -> Column:
    digest = F.sha1(F.concat(_col(title), F.char(F.lit(0)), _col(text)))
    return F.concat(F.lit("user-"), F.substring(digest, 1, 10))


def span_id(doc_id, locator_json) -> Column:
    return sha_id(doc_id, locator_json, prefix="sp_")


def model_directory(c, keep_dots: bool = True) -> Column:
    """File-system name of a model tag; the serving layer also replaces dots."""
    return F.translate(_col(c), ":/" if keep_dots else ":/.", "__" if keep_dots else "___")


def capitalised_statement(subject, predicate, obj) -> Column:
    """``S P O.`` with an upper-case first letter; an empty or null object is left out."""
    tail = F.when(text_or_empty(obj).isin("", "null"), F.lit("")).otherwise(F.concat(F.lit(" "), _col(obj)))
    sentence = strip(F.concat(_col(subject), F.lit(" "), _col(predicate), tail, F.lit(".")))
    return F.concat(F.upper(F.substring(sentence, 1, 1)), sentence.substr(F.lit(2), F.length(sentence)))


def fnv1a_hue(c) -> Column:
    """32-bit FNV-1a over the code units of a short id, modulo 360."""
    chars = F.split(_col(c), "")
    state = F.aggregate(
        F.filter(chars, lambda ch: ch != ""), F.lit(2166136261).cast("bigint"),
        lambda h, ch: _mul_mod32(h.bitwiseXOR(F.ascii(ch).cast("bigint"))))
    return F.pmod(state, F.lit(360)).cast("int")


def _mul_mod32(h: Column) -> Column:
    # 16777619 = 2**24 + 403, multiplied piecewise so that 64 bits never overflow
    low = F.pmod(h, F.lit(256)) * F.lit(1 << 24)
    return F.pmod(low + h * F.lit(403), F.lit(1 << 32))


# --- splitting with offsets -------------------------------------------------

# Sentence boundary and paragraph boundary.
SENTENCE_BREAK = rf"(?<=[.!?]){WS}+(?=[A-Z\"'(“])"
PARAGRAPH_BREAK = rf"\n{WS}*\n+"


def _pieces(c, mode: str) -> Column:
    """Consecutive pieces covering the whole text, separators left at their ends."""
    if mode in ("paragraph", "blank_line"):
        boundary = PARAGRAPH_BREAK
    elif mode == "sentence":
        boundary = SENTENCE_BREAK
    else:
        raise ValueError(f"unknown split mode {mode!r}")
    return F.regexp_extract_all(_col(c), F.lit(rf"(?s).+?(?:{boundary}|\z)"), F.lit(0))


def explode_sections(df: DataFrame, text: str, mode: str = "paragraph") -> DataFrame:
    """One row per section: pos, char_start, char_end (half-open code points) and body.

    Only the piece list and its running offsets are computed on arrays; stripping
    happens per exploded row, inside generated code. A piece is exploded together with its offset, as rows that each
    held all offsets would grow with the square of the text. The outer explode keeps Spark from inferring a size
    filter, which would run the split a second time below.
    """
    keep = [c for c in df.columns if c != text]
    pieces = df.select(*keep, _pieces(text, mode).alias("_pieces"))
    ends = F.aggregate(
        "_pieces", F.array(F.lit(0)),
        lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
    rows = (pieces
            .withColumn("_lead", (strip(F.get("_pieces", F.lit(0))) == "").cast("int"))
            .withColumn("_at", ends)
            .select(*keep, "_lead", F.posexplode_outer(F.arrays_zip("_pieces", "_at")).alias("_i", "_x"))
            .select(*keep, "_lead", "_i", F.col("_x._at").alias("_at"), F.col("_x._pieces").alias("_piece"))
            .withColumn("body", strip("_piece")).where("body <> ''"))
    start = F.col("_at") + F.length("_piece") - F.length(lstrip("_piece"))
    return (rows.withColumn("char_start", start)
            .select(*keep, (F.col("_i") - F.col("_lead")).alias("pos"), "char_start",
                    (F.col("char_start") + F.length("body")).alias("char_end"), "body"))


def container_of(section_path) -> Column:
    path = _col(section_path)
    return (F.when(path.startswith("preamble"), F.lit("preamble"))
            .when(path.startswith("enacting"), F.lit("enacting")))


def section_label(section_path) -> Column:
    path = _col(section_path)
    recital = F.regexp_extract(path, r"^preamble\.recitals\[(\d+)\]$", 1)
    article = F.regexp_extract(path, r"^enacting\.article_(.+)$", 1)
    return (F.when(recital != "", F.concat(F.lit("Recital "), (recital.cast("int") + 1).cast("string")))
            .when(article != "", F.concat(F.lit("Article "), article))
            .otherwise(path))


def section_order(section_path) -> Column:
    """Sort key: preamble first, then the first number in the path."""
    path = _col(section_path)
    number = F.regexp_extract(path, r"(\d+)", 1)
    return F.struct((~path.startswith("preamble")).alias("body"),
                    F.when(number != "", number.cast("long")).otherwise(F.lit(0)).alias("ordinal"))
