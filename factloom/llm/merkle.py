"""Merkle manifest of a table: leaf digests, one tree per group, one tree over the groups' roots, and membership proofs.

Rows become leaves where they lie; only digests travel. Leaves get their place by
a range partitioning over (group, order, digest): each partition numbers its own
rows and a running sum over the few (group, partition) counts adds what lies
before, so no task sees a whole group. A level of the tree is a slot pivot:
conditional aggregates spread a parent's children into ``FANOUT`` columns, whose
concatenation is hashed. Going down again, a parent's row is turned back into its
children: leaving out the own slot's column gives a child's siblings, which are
put in front of the parent's own path. Only parents are joined, a level with an
eighth of the rows below it.

Digests are lowercase hex SHA-256 and enter further digests as text. A run of one
node is hashed like any other; a group of one leaf is its own root.

Defined cases: nulls in any column are ``-``; null groups come first, then groups
bytewise; null ids come first, equal ones in the order of their leaves; repeated
rows are leaves of their own with equal digests, so which of them has which place
makes no difference; empty texts count zero bytes, very long ones are hashed in
place; columns that are not leaf columns are not read, so their names cannot
clash; an empty table gives an empty table.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

FANOUT = 8
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes dealt to one range partition while they are numbered.
RANGE = 100_000


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def lower_ascii(text: Column) -> Column:
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def numbered(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with ``idx`` (place within ``g``, from 0) and ``n`` (nodes of ``g``), and the counts (g, n) of all groups."""
    parts = max(1, -(-nodes.count() // RANGE))
    tied = nodes.withColumn("tie", F.monotonically_increasing_id())  # equal rows may be parted anywhere
    dealt = tied.repartitionByRange(parts, "g", *order, "tie").sortWithinPartitions("g", *order, "tie").drop("tie")

    def placed(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("g").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            pos = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
            if g[0] == last:
                pos[: starts[1] if len(starts) > 1 else len(g)] += seen
            last, seen = g[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(g), part, dtype=np.int32)), pa.array(pos)], [*b.schema.names, "part", "pos"])

    dealt = cut(dealt.mapInArrow(placed, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", part int, pos long"))
    counts = dealt.groupBy("g", "part").agg(F.count(F.lit(1)).alias("here"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))).withColumn(
        "n", F.sum("here").over(Window.partitionBy("g"))))
    rows = dealt.join(counts, ["g", "part"]).withColumn("idx", F.col("pos") + F.col("before"))
    return rows.select(*nodes.columns, "idx", "n"), counts.select("g", "n").distinct()


def parents(nodes: DataFrame, carried: list[str] = ()) -> DataFrame:
    """One row per run of ``FANOUT`` nodes (g, idx, n, h, ...): ``h0``, ``h1``, ... by slot, and the run's digest ``h``.

    ``carried`` columns of the children are spread in the same way, with the slot behind their names.
    """
    slot = F.pmod(F.col("idx"), F.lit(FANOUT))
    spread = [F.max(F.when(slot == k, F.col(c))).alias(f"{c}{k}") for c in ["h", *carried] for k in range(FANOUT)]
    runs = nodes.where("n > 1").groupBy("g", F.floor(F.col("idx") / FANOUT).alias("idx")).agg(F.max("n").alias("n"), *spread)
    return runs.withColumn("h", F.sha2(F.concat(*[F.coalesce(F.col(f"h{k}"), F.lit("")) for k in range(FANOUT)]), 256)).withColumn(
        "n", F.ceil(F.col("n") / FANOUT).cast("long"))


def children(runs: DataFrame, carried: list[str] = ()) -> DataFrame:
    """Back from ``runs`` with a ``path`` to their nodes (g, subroot, idx, h, path, ...): siblings left and right, then the parent's path."""
    held = [F.coalesce(F.col(f"h{k}"), F.lit("")) for k in range(FANOUT)]

    def node(k: int) -> Column:
        around = F.struct(F.concat(F.lit(""), *held[:k]).alias("left"), F.concat(F.lit(""), *held[k + 1 :]).alias("right"))
        return F.struct((F.col("idx") * FANOUT + k).alias("idx"), F.col(f"h{k}").alias("h"), *[F.col(f"{c}{k}").alias(c) for c in carried],
                        F.concat(F.array(around), F.col("path")).alias("path"))

    out = runs.select("g", "subroot", F.explode(F.array(*[node(k) for k in range(FANOUT)])).alias("x")).select("g", "subroot", "x.*")
    return out.where("h is not null")


def tree(nodes: DataFrame, most: int, carried: list[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The levels of parents, lowest first, and (g, h): the root of each group; ``most`` is the size of the largest group."""
    levels, roots, at = [], nodes.where("n = 1").select("g", "h"), nodes
    while most > 1:
        at = cut(parents(at, [] if levels else carried))
        levels.append(at)
        roots = roots.unionByName(at.where("n = 1").select("g", "h"))
        most = -(-most // FANOUT)
    return levels, roots


def paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, carried: list[str] = ()) -> DataFrame:
    """Every node with its path to the root; ``tops`` (g, subroot, path) names each group's root and continues above it."""
    down = None
    for i, runs in reversed(list(enumerate(levels))):
        of_root = runs.where("n = 1").join(tops, "g")
        runs = of_root if down is None else of_root.unionByName(runs.where("n > 1").join(down.select("g", "idx", "subroot", "path"), ["g", "idx"]))
        down = children(runs, [] if i else carried)
    alone = nodes.where("n = 1").join(tops, "g").select("g", "subroot", "idx", "h", *carried, "path")
    return alone if down is None else alone.unionByName(down)


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, digest, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = LEAF_COLUMNS, id_col: str = "doc_id",
             group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(id, grp, leaf, claimed, subroot, root, path): one row per row of ``docs``, with what a verifier needs.

    ``claimed`` is the leaf as a later reader of the table would compute it:
    where ``tampered`` holds, with the text's A-Z in lower case, else ``leaf``.
    """
    own = leaf(*[F.col(c) for c in columns])
    other = leaf(*[lower_ascii(F.col(c)) if c == text_col else F.col(c) for c in columns])
    # a null group sorts before all others, which keep their bytewise order
    g = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    claimed = F.when(F.lit(False) if tampered is None else tampered, other)
    nodes = cut(docs.select(g.alias("g"), F.col(id_col).alias("id"), own.alias("h"), claimed.alias("claimed")))
    carried = ["id", "claimed"]
    nodes, counts = numbered(nodes, ["id", "h"])
    nodes = cut(nodes)
    most = counts.agg(F.max("n")).first()[0] or 0
    levels, roots = tree(nodes, most, carried)
    # the groups' roots are the leaves of one more tree
    upper, total = numbered(cut(roots.select(F.lit("").alias("g"), F.col("g").alias("of"), "h")), ["of"])
    upper = cut(upper)
    n_groups = total.agg(F.max("n")).first()[0] or 0
    above, top = tree(upper, n_groups, ["of"])
    root = F.lit(next((r.h for r in top.collect()), None))  # one row at most
    none = F.array().cast("array<struct<left:string,right:string>>")
    tops = paths(upper, above, top.select("g", F.col("h").alias("subroot"), none.alias("path")), ["of"])
    tops = cut(tops.select(F.col("of").alias("g"), F.col("h").alias("subroot"), "path"))
    out = paths(nodes, levels, tops, carried)
    return out.select("id", F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias("grp"), F.col("h").alias("leaf"),
                      F.coalesce("claimed", "h").alias("claimed"), "subroot", root.alias("root"), "path")
