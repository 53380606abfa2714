"""Coverage, agreement, distribution shift and fact statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions import rules as R
from factloom.functions import text as T
from factloom.operators.align import SCOPE, annotator_pairs
from factloom.operators.scan import dealt, scanned
from factloom.session import checkpoint

BIN_CHARS = 4096


def _islands(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    longest = spans.groupBy(*keys, start).agg(F.max(end).alias(end))
    rows = scanned(dealt(longest, keys, [start]), keys, [start], _reach=("max", F.col(end)))
    opens = (F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).cast("long")
    rows = scanned(rows.withColumn("_opens", opens), keys, [start], _island=("sum", F.col("_opens")))
    return rows.groupBy(*keys, (F.col("_island") + F.col("_opens")).alias("_island")).agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def _cut(spans: DataFrame, keys: list[str], start: str, end: str, bin_size: int) -> DataFrame:
    """Pieces of the intervals inside bins; after folding equal starts a bin holds at most ``bin_size`` of them."""
    real = spans.where(F.col(end) > F.col(start)).groupBy(*keys, start).agg(F.max(end).alias(end))
    pieces = real.withColumn("_bin", F.explode(F.sequence(
        F.floor(F.col(start) / bin_size), F.floor((F.col(end) - 1) / bin_size))))
    return pieces.select(*keys, "_bin", F.greatest(F.col(start), F.col("_bin") * bin_size).cast("long").alias(start),
                         F.least(F.col(end), (F.col("_bin") + 1) * bin_size).cast("long").alias(end))


def merged_intervals(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end",
                     bin_size: int = BIN_CHARS) -> DataFrame:
    """Union of half-open intervals per key as disjoint rows; touching intervals merge.

    Bins are merged first, by windows of at most ``bin_size`` rows; their islands,
    which touch at the borders, join up again in a scan that no key keeps to itself.
    """
    cut = _cut(spans, keys, start, end, bin_size)
    before = W.partitionBy(*keys, "_bin").orderBy(start).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*keys, "_bin").orderBy(start).rowsBetween(W.unboundedPreceding, 0)
    opened = cut.groupBy(*keys, "_bin", start).agg(F.max(end).alias(end)).withColumn("_reach", F.max(end).over(before))
    opened = opened.withColumn("_island", F.count_if(F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).over(upto))
    local = opened.groupBy(*keys, "_bin", "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_bin", "_island")
    return _islands(local, keys, start, end)


def covered_length(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end",
                   bin_size: int = BIN_CHARS) -> DataFrame:
    """Length of the union of intervals per key.

    Intervals are cut at bin borders, where the union length is additive. After
    folding equal starts a bin holds at most ``bin_size`` rows, so the ordered scan
    never sees an unbounded group even if one key holds most intervals.
    """
    cut = _cut(spans, keys, start, end, bin_size).withColumnRenamed(start, "_s").withColumnRenamed(end, "_e")
    cut = cut.groupBy(*keys, "_bin", "_s").agg(F.max("_e").alias("_e"))
    before = W.partitionBy(*keys, "_bin").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max("_e").over(before), F.col("_s"))
    gain = F.greatest(F.lit(0), F.col("_e") - F.greatest(F.col("_s"), reach))
    return cut.withColumn("_gain", gain).groupBy(*keys).agg(F.sum("_gain").alias("covered"))


def coverage(facts: DataFrame, sections: DataFrame, containers: DataFrame) -> DataFrame:
    """Per annotator and document: how much of the document its facts point at.

    ``sections``: (doc_id, section_path) of every section, blanks included.
    ``containers``: (doc_id, container, n_chars).
    """
    key = [*SCOPE, "annotator"]
    loc = facts.select(*key, "source_locator.source_type", "source_locator.section_path",
                       "source_locator.char_start", "source_locator.char_end")
    prose = F.col("source_type") == "prose"
    container = T.container_of("section_path")
    placed = prose & container.isNotNull() & F.col("char_start").isNotNull() & F.col("char_end").isNotNull()
    length = F.greatest(F.lit(0), F.col("char_end") - F.col("char_start"))
    counts = loc.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_facts"), F.round(F.coalesce(F.avg(F.when(placed, length)), F.lit(0.0)), 1).alias("mean_fact_chars"))
    hit = loc.where(prose).select(*key, "section_path").distinct()
    n_sections = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"))
    hits = (hit.join(sections.groupBy("doc_id", "section_path").agg(F.count(F.lit(1)).alias("times")), ["doc_id", "section_path"])
            .groupBy(*key).agg(F.sum("times").alias("n_hit")))
    clipped = (loc.where(placed).withColumn("container", container).join(containers, ["doc_id", "container"])
               .select(*key, "container", F.greatest(F.col("char_start"), F.lit(0)).alias("start"),
                       F.least(F.col("char_end").cast("long"), F.col("n_chars").cast("long")).alias("end")))
    covered = covered_length(clipped, [*key, "container"]).groupBy(*key).agg(F.sum("covered").alias("total_chars_covered"))
    available = containers.groupBy("doc_id").agg(F.sum("n_chars").alias("total_chars_available"))
    out = (counts.join(hits, key, "left").join(covered, key, "left").join(n_sections, "doc_id", "left").join(available, "doc_id", "left"))
    return out.select(
        *key, "n_facts", "mean_fact_chars", F.coalesce("total_chars_covered", F.lit(0)).alias("total_chars_covered"),
        F.coalesce("total_chars_available", F.lit(0)).alias("total_chars_available"),
        F.round(F.coalesce("n_hit", F.lit(0)) / F.greatest(F.coalesce("n_sections", F.lit(0)), F.lit(1)), 3).alias("sections_hit_frac"),
        F.round(F.coalesce("total_chars_covered", F.lit(0)) /
                F.greatest(F.coalesce("total_chars_available", F.lit(0)), F.lit(1)), 3).alias("char_coverage_frac"))


def coverage_rollup(per_document: DataFrame) -> DataFrame:
    """Per annotator means of the rounded document values."""
    return per_document.groupBy("guideline_version", "annotator").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_facts").alias("total_facts"),
        F.round(F.avg("sections_hit_frac"), 3).alias("mean_sections_hit_frac"),
        F.round(F.avg("char_coverage_frac"), 3).alias("mean_char_coverage_frac"),
        F.round(F.avg("mean_fact_chars"), 1).alias("mean_fact_chars"))


def agreement(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per document and annotator pair: matches, Jaccard, mean stored cosine, label histogram."""
    counts = facts.groupBy(*SCOPE, "annotator").agg(F.count(F.lit(1)).alias("n"))
    matched = pairs.where("status = 'matched'").select(
        *SCOPE, F.least("annotator_a", "annotator_b").alias("annotator_a"),
        F.greatest("annotator_a", "annotator_b").alias("annotator_b"), F.round(F.col("cosine") * 10000).cast("long").alias("cosine"), "conflict_label")
    key = [*SCOPE, "annotator_a", "annotator_b"]
    agg = matched.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_matched"), F.sum("cosine").alias("total"),
        *[F.count_if(F.col("conflict_label") == l).alias(f"n_{l}") for l in R.LABELS + ["escalate"]])
    # the skeleton keeps pairs that never matched
    rows = annotator_pairs(facts).join(agg, key, "left")
    for side in ("a", "b"):
        rows = rows.join(counts.select(*SCOPE, F.col("annotator").alias(f"annotator_{side}"), F.col("n").alias(f"n_{side}")),
                         [*SCOPE, f"annotator_{side}"])
    n = F.coalesce("n_matched", F.lit(0))
    union = F.col("n_a") + F.col("n_b") - n
    return rows.select(
        *key, "n_a", "n_b", n.alias("n_matched"), F.when(union > 0, F.round(n / union, 3)).alias("jaccard"),
        # whole ten-thousandths are summed, so the order of rows makes no difference
        (F.floor((200 * F.col("total") + F.col("n_matched")) / (2 * F.col("n_matched"))) / 1_000_000).alias("mean_cosine"),
        *[F.coalesce(f"n_{l}", F.lit(0)).alias(f"n_{l}") for l in R.LABELS + ["escalate"]])


def document_profile(pairs: DataFrame) -> DataFrame:
    """Label counts, matched pairs and arbiter calls per version and document."""
    return pairs.groupBy(*SCOPE).agg(
        *[F.count_if(F.col("conflict_label") == l).alias(l) for l in R.SHIFT_LABELS],
        F.count_if(~F.col("conflict_label").isin(R.SHIFT_LABELS)).alias("other"),
        F.count_if(F.col("status") == "matched").alias("n_matched"), F.count_if("layer2_called").alias("n_layer2"))


def _percent(new, old):
    return F.when(old != 0, F.round((new - old) / old * 100, 1))


def distribution_shift(profile: DataFrame, old: str = "v1", new: str = "v2") -> DataFrame:
    """Per document and label: counts of two versions, difference and relative change.

    Rows with label ``total`` sum the four labels and carry the rule-filter rates.
    """
    measures = R.SHIFT_LABELS + ["total"]
    base = profile.withColumn("total", sum((F.col(l) for l in R.SHIFT_LABELS), F.lit(0))).withColumn(
        "rate", F.round(1 - F.col("n_layer2") / F.greatest(F.col("n_matched"), F.lit(1)), 3))
    a = base.where(F.col("guideline_version") == old).select("doc_id", *[F.col(m).alias(f"{m}_1") for m in measures], F.col("rate").alias("rate_1"))
    b = base.where(F.col("guideline_version") == new).select("doc_id", *[F.col(m).alias(f"{m}_2") for m in measures], F.col("rate").alias("rate_2"))
    long = F.explode(F.array(*[F.struct(
        F.lit(m).alias("label"), F.col(f"{m}_1").alias("n_old"), F.col(f"{m}_2").alias("n_new"),
        F.when(F.lit(m == "total"), F.col("rate_1")).alias("rate_old"),
        F.when(F.lit(m == "total"), F.col("rate_2")).alias("rate_new")) for m in measures]))
    return a.join(b, "doc_id").select("doc_id", long.alias("x")).select(
        "doc_id", "x.*", (F.col("x.n_new") - F.col("x.n_old")).alias("delta"),
        _percent(F.col("x.n_new"), F.col("x.n_old")).alias("delta_pct"))


def corpus_shift(profile: DataFrame, old: str = "v1", new: str = "v2") -> DataFrame:
    """The same over all documents that have both versions; an empty match count has no rate."""
    sides = profile.where(F.col("guideline_version").isin(old, new))
    measures = R.SHIFT_LABELS + ["n_matched", "n_layer2"]
    wide = sides.groupBy("doc_id").agg(
        F.count_distinct("guideline_version").alias("n_versions"),
        *[F.sum(F.when(F.col("guideline_version") == v, F.col(m)).otherwise(0)).alias(f"{m}_{i}")
          for i, v in ((1, old), (2, new)) for m in measures]).where("n_versions = 2")
    total = wide.agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(f"{m}_{i}").alias(f"{m}_{i}") for i in (1, 2) for m in measures])
    for i in (1, 2):
        total = total.withColumn(f"total_{i}", sum((F.col(f"{l}_{i}") for l in R.SHIFT_LABELS), F.lit(0)))
        total = total.withColumn(f"rate_{i}", F.when(F.col(f"n_matched_{i}") > 0, F.round(1 - F.col(f"n_layer2_{i}") / F.col(f"n_matched_{i}"), 3)))
    long = F.explode(F.array(*[F.struct(
        F.lit(m).alias("label"), F.col(f"{m}_1").alias("n_old"), F.col(f"{m}_2").alias("n_new"),
        F.when(F.lit(m == "total"), F.col("rate_1")).alias("rate_old"),
        F.when(F.lit(m == "total"), F.col("rate_2")).alias("rate_new")) for m in R.SHIFT_LABELS + ["total"]]))
    return total.select("n_docs", long.alias("x")).select(
        "n_docs", "x.*", (F.col("x.n_new") - F.col("x.n_old")).alias("delta"), _percent(F.col("x.n_new"), F.col("x.n_old")).alias("delta_pct"))


def annotator_sets_match(facts: DataFrame, old: str = "v1", new: str = "v2") -> DataFrame:
    """Per document: do both versions have the same annotators (else counts are not comparable)."""
    def names(v):
        return F.array_sort(F.coalesce(F.collect_set(F.when(F.col("guideline_version") == v, F.col("annotator"))), F.array()))

    return facts.groupBy("doc_id").agg(names(old).alias("old_annotators"), names(new).alias("new_annotators")).withColumn(
        "annotators_match", F.col("old_annotators") == F.col("new_annotators"))


def facts_per_annotator(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*SCOPE, "annotator").agg(F.count(F.lit(1)).alias("n_facts"))


def section_spread(facts: DataFrame, annotators: list[str]) -> DataFrame:
    """Facts per section and annotator side by side, and the spread between the busiest and the idlest."""
    path = F.coalesce(F.nullif(F.col("source_locator.section_path"), F.lit("")), F.lit("?"))
    counts = facts.withColumn("section_path", path).groupBy(*SCOPE, "section_path").agg(
        *[F.count_if(F.col("annotator") == a).alias(a) for a in annotators])
    if len(annotators) < 2:
        return counts.withColumn("spread", F.lit(0))
    return counts.withColumn("spread", F.greatest(*annotators) - F.least(*annotators)).withColumn("hot", F.col("spread") >= 2)


def overlap_depth(spans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per span the number of earlier spans of the same key it overlaps, and its undrawn part.

    Earlier means smaller in ``order`` (which begins with start, end and tells the
    spans of a key apart). Starting before and not ending before is counted with
    running sums, so no span is ever paired with another one and no task sees a key.
    """
    start, end = order[0], order[1]
    empty = (F.col(end) <= F.col(start)).cast("long")
    ranked = scanned(dealt(spans, keys, order), keys, order, _rank=("sum", F.lit(1)), _reach=("max", F.col(end)), _empty_before=("sum", empty))
    ranked = checkpoint(ranked.drop("_part", "_tie"))
    # events: every span opens at (start, rank) and closes at its end; a close before a start is gone
    opens = ranked.select(*keys, F.col(start).alias("_at"), F.lit(1).alias("_open"), F.col("_rank"), F.lit(0).alias("_closed"))
    closes = ranked.where(F.col(end) > F.col(start)).select(*keys, F.col(end).alias("_at"), F.lit(0).alias("_open"), F.lit(0).cast("long").alias("_rank"), F.lit(1).alias("_closed"))
    by = ["_at", "_open", "_rank"]
    flow = scanned(dealt(opens.unionByName(closes), keys, by), keys, by, _gone=("sum", F.col("_closed")))
    gone = flow.where("_open = 1").select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_rank").alias("_at_rank"), "_gone")
    met = F.col("_rank") == F.col("_at_rank")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    out = ranked.join(gone, met).withColumn("depth", (F.col("_rank") - F.col("_empty_before") - F.col("_gone")).cast("int"))
    out = out.withColumn("draw_start", F.greatest(F.col(start), F.coalesce("_reach", F.lit(0))))
    return out.withColumn("draw_end", F.greatest(F.col(end), F.col("draw_start"))).select(*spans.columns, "depth", "draw_start", "draw_end")
