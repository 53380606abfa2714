"""Selection with resume and stop, against a plain loop over the source."""

import random

from pyspark.sql import functions as F

from factloom.sources import selection as S


def loop(rows, manifest, need):
    out, taken = [], 0
    for place, doc, reason in sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1])):
        if doc in manifest or taken >= need:
            continue
        taken += reason == ""
        out.append((place, doc, reason, reason == ""))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "source_index long, doc_id string, why string")


def judge(rows):
    return rows.select("source_index", "doc_id", F.col("why").alias("reason"))


def test_selection_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(60)]), f"d{i}", rng.choice(["", "", "short", None])) for i in range(300)]
    rows.append(rows[0])
    known = {f"d{i}" for i in range(0, 300, 7)}
    manifest = spark.createDataFrame([(d,) for d in sorted(known)] + [(None,)], "doc_id string")
    df = table(spark, rows)
    for need, ranges in ((1, 8), (40, 8), (40, 1), (10_000, 5)):
        got = S.select_until(df, manifest, need, judge, ranges=ranges, part_rows=17)
        assert sorted(map(tuple, got.collect()), key=str) == loop(rows, known, need), (need, ranges)


def test_stop_leaves_the_rest_unparsed(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = table(spark, [(i, f"d{i:04}", "") for i in range(2000)])

    def counting(part):
        @F.udf("string")
        def look(why):
            seen.add(1)
            return why

        return part.select("source_index", "doc_id", look("why").alias("reason"))

    none = spark.createDataFrame([], "doc_id string")
    first = S.select_until(rows, none, 50, counting)
    assert [r.doc_id for r in first.orderBy("source_index").collect()] == [f"d{i:04}" for i in range(50)]
    assert 50 <= seen.value <= 200
    more = S.select_until(rows, first.where("accepted"), 5, counting)
    assert sorted(r.doc_id for r in more.collect()) == [f"d{i:04}" for i in range(50, 55)]


def test_nothing_to_select(spark):
    none = spark.createDataFrame([], "doc_id string")
    some = table(spark, [(1, "a", ""), (2, "b", "")])
    assert S.select_until(some, none, 0, judge).count() == 0
    assert S.select_until(table(spark, []), none, 3, judge).count() == 0
    assert S.select_until(some, some.select("doc_id"), 3, judge).count() == 0


def test_positions_of_many_triples_never_collide(spark):
    from factloom.operators import extract as X

    rows = [("preamble.recitals[2]", 0, t) for t in range(1200)] + [("preamble.recitals[10]", 0, 0), ("enacting.articles[1]", 0, 0),
            ("preamble.recitals[2]", 1, 0), ("preamble.recitals[0]", 5, 3)]
    df = spark.createDataFrame(rows, "section_path string, group_index int, triple_index int")
    text = [c for c in "subject predicate object condition temporal_context logic_group logic_op natural_language matched_quote source_quote".split()]
    df = df.withColumns({"doc_id": F.lit("d"), "annotator": F.lit("a"), "guideline_version": F.lit("v1"), "char_start": F.lit(0), "char_end": F.lit(1),
                         "anchor_score": F.lit(100.0), **{c: F.lit("x") for c in text}})
    got = sorted((r.fact_pos, r.source_locator.section_path, r.extra.triple_index) for r in X.build_facts(df).collect())
    assert [g[0] for g in got] == [3, *range(1200, 2400), 2400, 3600, 4800]  # groups are as far apart as the largest needs
    assert got[0][1:] == ("preamble.recitals[0]", 3) and [g[2] for g in got[1:1201]] == list(range(1200))
    assert [g[1] for g in got[1201:]] == ["preamble.recitals[2]", "preamble.recitals[10]", "enacting.articles[1]"]
