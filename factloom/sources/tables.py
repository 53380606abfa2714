"""Facts and pairs derived from plain document tables.

A document's sentences become the facts of annotator ``ann_a``; ``ann_b`` repeats
them under an edit fixed by position, so every label occurs and a second engine
can repeat the derivation. Documents are dealt out by id once; everything behind that is a narrow, shuffle-free projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.session import checkpoint_dealt

# Edit codes, by (doc, position): 0-2 same, 3 dropped, 4 number changed, 5 subject
# reworded, 6 object shortened, 7 split in two, 8 negated, 9 condition added.
MATCHED_FROM = 0.78


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a small input arrives in fewer splits than there are cores.

    Text work is CPU-bound, and one row group is one task. Inputs with enough
    splits, which is every large one, are passed through untouched.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


#: Parts a split of the input is dealt into, so that what a task derives from its documents fits its memory.
PARTS_OF_SPLIT = 4


def by_document(df: DataFrame) -> DataFrame:
    """Deal the documents out by id, once and before anything is derived from them.

    What is derived keeps this partitioning, so joins and groups within a document need no shuffle of their own: the
    text travels once instead of every fact in every join. The key is the id as facts name it. Spark reuses it in joins
    on more columns only if told that some of the keys are enough.
    """
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    parts = max(df.sparkSession.sparkContext.defaultParallelism, PARTS_OF_SPLIT * df.rdd.getNumPartitions())
    return df.repartition(parts, F.col("doc_id").cast("string"))


def sentences(spark: SparkSession, sf_dir: str, deal=spread) -> DataFrame:
    """(doc_id, pos, char_start, char_end, body) of every document."""
    return T.explode_sections(deal(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", "sentence")


def _edit(version: Column) -> Column:
    return F.when(version == "v1", (F.col("doc_id") * 31 + F.col("pos")) % 10).otherwise(
        (F.col("doc_id") * 17 + F.col("pos") * 7 + 3) % 10).cast("int")


def _spoken(rows: DataFrame) -> DataFrame:
    """Sentences with the triple read from their words."""
    return rows.withColumn("w", T.words("body")).select(
        "doc_id", "pos", "char_start", "char_end", "body",
        F.array_join(F.slice("w", 1, 2), " ").alias("subject"),
        F.coalesce(F.get("w", F.lit(2)), F.lit("")).alias("predicate"),
        F.btrim(F.array_join(F.expr("slice(w, 4, size(w))"), " "), F.lit(T.ENTITY_EDGE_PUNCTUATION)).alias("object"))


def stored_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with their triples, dealt out by document and kept in the checkpoint folder: ``base`` of every table of facts and pairs
    that one query derives, so that documents are read and split once. Each text is kept about twice, facts and pairs not at all."""
    return checkpoint_dealt(_spoken(sentences(spark, sf_dir, by_document)))


def annotated_sentences(spark: SparkSession, sf_dir: str, versions=("v1",), base: DataFrame | None = None, deal=spread) -> DataFrame:
    """One row per sentence and version: triple, edit code and the facts of both annotators."""
    base = _spoken(sentences(spark, sf_dir, deal)) if base is None else base
    if len(versions) == 1:
        base = base.withColumn("guideline_version", F.lit(versions[0]))
    else:
        base = base.withColumn("guideline_version", F.explode(F.array(*[F.lit(v) for v in versions])))
    base = base.withColumn("edit", _edit(F.col("guideline_version")))
    half = F.array_join(F.expr("slice(split(object, ' '), 1, int((size(split(object, ' ')) + 1) / 2))"), " ")
    rest = F.array_join(F.expr(
        "slice(split(object, ' '), int((size(split(object, ' ')) + 1) / 2) + 1, size(split(object, ' ')))"), " ")
    return base.withColumn("half", half).withColumn("rest", rest)


def _edited(spark: SparkSession, sf_dir: str, versions, base: DataFrame | None) -> DataFrame:
    """Annotated sentences dealt out by document; the parts of an object only where the edit cuts it."""
    rows, cut = annotated_sentences(spark, sf_dir, versions, base, by_document), F.col("edit").isin(6, 7)
    return rows.withColumns({c: F.when(cut, F.col(c)) for c in ("half", "rest")})


def _more(c: Column) -> Column:
    return F.when(c == "", F.lit("")).otherwise(F.concat(F.lit(" "), c))


def _statement(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.concat(subject, _more(predicate), _more(obj), F.lit("."))


def _section() -> Column:
    return F.concat(F.lit("preamble.recitals["), (F.col("pos").cast("int") / 4).cast("int").cast("string"), F.lit("]"))


def _triples_of_row() -> tuple[Column, Column, Column]:
    """What differs between the facts of a row: of ann_a, of ann_b (null when dropped), second half of a split (else null).

    Only this is exploded; whatever follows from it is a column of the exploded rows, so a reader of few columns pays for few.
    """
    s, p, o, e = F.col("subject"), F.col("predicate"), F.col("object"), F.col("edit")
    start, end = F.col("char_start"), F.col("char_end")
    none = F.lit("")
    middle = (start + (end - start) / 2).cast("int")

    def triple(annotator, part, subject, predicate, obj, condition, start, end):
        return F.struct(F.lit(annotator).alias("annotator"), F.lit(part).alias("part"), subject.alias("subject"), predicate.alias("predicate"), obj.alias("object"),
                        condition.alias("condition"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"))

    a = triple("ann_a", 0, s, p, F.when(e == 4, F.trim(F.concat(o, F.lit(" 2,3 %")))).otherwise(o), none, start, end)
    b0 = triple(
        "ann_b", 0, F.when(e == 5, F.concat(F.lit("the "), s)).otherwise(s),
        F.when(e == 8, F.trim(F.concat(F.lit("not "), p))).otherwise(p),
        F.when(e == 4, F.trim(F.concat(o, F.lit(" 2,8 %")))).when(e.isin(6, 7), F.col("half")).otherwise(o),
        F.when(e == 9, F.concat(F.lit("if "), s)).otherwise(none),
        start, F.when(e.isin(6, 7), middle).otherwise(end))
    b1 = triple("ann_b", 1, s, F.concat(F.lit("also "), p), F.col("rest"), none, middle, end)
    return a, F.when(e != 3, b0), F.when((e == 7) & (F.col("rest") != ""), b1)


def facts(spark: SparkSession, sf_dir: str, versions=("v1",), base: DataFrame | None = None) -> DataFrame:
    """The derived facts of both annotators, one row per fact."""
    rows = _edited(spark, sf_dir, versions, base).select(
        "guideline_version", "doc_id", "pos", "body", "edit", F.explode(F.array(*_triples_of_row())).alias("f")).where("f is not null")
    rows = rows.select("guideline_version", F.col("doc_id").cast("string").alias("doc_id"), "pos", "body", "edit", "f.*")
    pos = F.col("pos")
    locator = F.struct(
        F.lit("prose").alias("source_type"), _section().alias("section_path"), "char_start", "char_end", F.col("body").alias("quote"),
        F.lit(None).cast("string").alias("annex_id"), F.lit(None).cast("int").alias("table_id"),
        F.lit(None).cast("int").alias("row_idx"), F.lit(None).cast("array<int>").alias("col_indices"),
        F.lit(None).cast("string").alias("linearized_sentence"))
    branch = pos % 6 < 2
    return rows.select(
        "guideline_version", "doc_id", T.fact_id("annotator", "doc_id", _section(), "pos", "part").alias("fact_id"),
        "annotator", "subject", "predicate", "object", "condition",
        F.when(pos % 11 == 0, F.lit("within two days")).otherwise(F.lit("")).alias("temporal_context"),
        T.group_id("annotator", "doc_id", _section(), "pos").alias("group_id"),
        F.when(branch, F.concat(F.lit("lg"), (pos / 6).cast("int").cast("string"))).otherwise(F.lit("")).alias("logic_group"),
        F.when(branch, F.when(pos % 12 < 6, F.lit("OR")).otherwise(F.lit("AND"))).otherwise(F.lit("")).alias("logic_op"),
        _statement(F.col("subject"), F.col("predicate"), F.col("object")).alias("natural_language"), locator.alias("source_locator"),
        F.lit("unlabeled").alias("conflict_label"), (pos * 2 + F.col("part")).cast("int").alias("fact_pos"), F.col("edit").alias("synth_op"))


def name_bounds(spark: SparkSession, sf_dir: str, versions=("v1",)) -> DataFrame:
    """(scope, n_chars): no less than the characters of all subjects and objects derived from a document, without splitting it.

    A sentence ends in a mark and gives three facts at most; an edit adds at most 16 characters to them. Marks are counted
    in long texts only, as in others three characters a sentence are bound enough.
    """
    text = T.text_or_empty("text")
    n = F.length(text)
    sentences_at_most = F.when(n > 20_000, n - F.length(F.translate(text, ".!?", ""))).otherwise((n / 3).cast("int")) + 1
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(
        F.sum(3 * n + 16 * sentences_at_most).alias("n_chars"))
    return sizes.select(F.explode(F.array(*[F.lit(v) for v in versions])).alias("guideline_version"), "doc_id", "n_chars")


def _word_set(statement: Column) -> Column:
    return F.array_distinct(F.split(F.rtrim(statement, F.lit(".")), " "))


def _shared(a: str, b: str) -> Column:
    """Cosine of two sets of words, to three places."""
    return F.round(F.size(F.array_intersect(a, b)) / F.sqrt((F.size(a) * F.size(b)).cast("double")), 3)


def pairs(spark: SparkSession, sf_dir: str, versions=("v1",), base: DataFrame | None = None) -> DataFrame:
    """Pairs known by construction with the cosine of their words; pairs below ``MATCHED_FROM`` fall apart into two orphans.

    The best partner of a dropped fact is taken to be what shares its subject and predicate only.
    """
    first, second, third = _triples_of_row()
    said = lambda t: _statement(t["subject"], t["predicate"], t["object"])
    dropped = F.col("edit") == 3
    rows = _edited(spark, sf_dir, versions, base).select(
        "guideline_version", "doc_id", "pos", "edit", _word_set(said(first)).alias("a"),
        _word_set(F.when(dropped, F.concat_ws(" ", "subject", "predicate")).otherwise(said(second))).alias("b"), _word_set(said(third)).alias("c"))
    rows = rows.select("guideline_version", F.col("doc_id").cast("string").alias("doc_id"), "pos", "edit",
                       _shared("a", "b").alias("cosine"), F.when(F.col("c").isNotNull(), _shared("a", "c")).alias("split_cosine"), F.col("c").isNotNull().alias("split"))

    def pair(of_a, part_of_b, score, status):
        return F.struct(F.lit(of_a).alias("of_a"), F.lit(part_of_b).cast("int").alias("part"), F.col(score).alias("cosine"), F.lit(status).alias("status"))

    together = F.col("cosine") >= MATCHED_FROM
    rows = rows.select("guideline_version", "doc_id", "pos", F.explode(F.array(
        F.when(~dropped & together, pair(True, 0, "cosine", "matched")),
        F.when(dropped | ~together, pair(True, None, "cosine", "unmatched_a")),
        F.when(~dropped & ~together, pair(False, 0, "cosine", "unmatched_b")),
        F.when(F.col("split"), pair(False, 1, "split_cosine", "unmatched_b")))).alias("p")).where("p is not null")
    fact = lambda annotator, part: T.fact_id(F.lit(annotator), "doc_id", _section(), "pos", part)
    return rows.select(
        "guideline_version", "doc_id", F.lit("ann_a").alias("annotator_a"), F.lit("ann_b").alias("annotator_b"),
        F.when(F.col("p.of_a"), fact("ann_a", F.lit(0))).alias("fact_a_id"),
        F.when(F.col("p.part").isNotNull(), fact("ann_b", F.col("p.part"))).alias("fact_b_id"), "p.cosine", "p.status")
