"""Similarity self-join on word n-grams by chosen paths.

A text is the set of its word n-grams. Texts of equal sets fold into one unit.
In each run a unit follows a path of sampled tokens: the token with the least
hash under the run's seed names its first node; a node that holds too many units
is split again, in two ways each time, by the least token under a seed made from
the path so far, up to three levels. Two units whose Jaccard similarity is j
meet with probability j at the first level and 1 - (1 - j)^2 at each further
one, so the number of runs follows from the target recall at the threshold.

Nodes of at most ``LIMIT`` units, and what is still larger at the last level,
are compared by brute force. Large ones are cut into chunks and each task
compares two chunks, so no task holds more than two chunks and nothing is left
out. Nodes of equal members are compared once, and a pair that meets in several
nodes counts in the one of least key only; tasks return link counts and one edge
per unit, never pairs. Classes are connected components of these edges.

Tokens are 32-bit hashes when compared; 64-bit ones choose the paths.

Defined cases: a null text is an empty one; texts without words are linked only
with equal texts; a text of fewer than ``n`` words is one n-gram; equal
rows are copies of each other; null ids are allowed (a class of null ids only
has a null class id, ``class_key`` tells it apart); other columns of the input
are not read by ``classes`` and pass through ``keep_one``; an empty table gives
an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, digest, fresh, mix, shingles, text_words
from factloom.operators.components import connected_components

N, SIMILARITY, RECALL = 5, 0.8, 0.998
LIMIT = 256
KEYS = 7  # of a run: one node at the first level, two at the second, four at the third


def runs_for(recall: float, similarity: float) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``, if every node has to be split."""
    meet = similarity * (1 - (1 - similarity) ** 2) ** 2
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def token_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    return [np.unique(shingles(w, n)) for w in text_words(texts)]


def _least(tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(mix(tokens ^ np.repeat(seeds, lengths)), starts)


def path_keys(sets: list[np.ndarray], runs: int) -> np.ndarray:
    """Node keys of each (non-empty) set: ``KEYS`` per run."""
    lengths = np.array([len(s) for s in sets])
    starts, tokens = np.append(0, np.cumsum(lengths)[:-1]), np.concatenate(sets)
    out = np.zeros((len(sets), runs, KEYS), dtype=np.uint64)
    for r in range(runs):
        seed = mix(np.full(len(sets), r + 1, dtype=np.uint64))
        out[:, r, 0] = mix(_least(tokens, starts, lengths, seed) + seed)
        for child in range(1, KEYS):
            parent = out[:, r, (child - 1) // 2]
            seed = mix(parent + np.uint64(child))
            out[:, r, child] = mix(_least(tokens, starts, lengths, seed) + seed)
    return out


def _keyed(runs: int, n: int):
    def rows(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                sets = token_sets(part["text"].tolist(), n)
                sign = part[["t1", "t2"]].to_numpy(dtype=np.int64).view(np.uint64).copy()
                keys = [None] * len(sets)
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    for i, k in zip(full, path_keys([sets[i] for i in full], runs)):
                        keys[i] = k.reshape(-1).view(np.int64)
                for i in full:
                    sign[i] = mix(sets[i]).sum(), mix(sets[i] ^ np.uint64(0x5DEECE66D)).sum()
                yield pd.DataFrame({"id": part["id"], "t1": part["t1"], "t2": part["t2"], "s1": sign[:, 0].view(np.int64),
                                    "s2": sign[:, 1].view(np.int64), "keys": keys})

    return rows


def _leaves(units: DataFrame, runs: int, limit: int) -> DataFrame:
    """(s1, leaf, n): the nodes of two or more units in which units are compared, nodes of equal members once."""
    member = F.bit_xor(F.xxhash64("s1"))

    def counted(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), member.alias("sig")).where("n > 1")
        return rows.join(sizes, "key")

    at = lambda r, k: F.col("keys")[r * KEYS + k]
    first = units.where("keys is not null").select("s1", F.explode(F.array(*[
        F.struct(at(r, 0).alias("key"), F.array(*[at(r, k) for k in range(1, KEYS)]).alias("below")) for r in range(runs)])).alias("x"))
    first = cut(counted(first.select("s1", "x.key", "x.below")))
    below = F.col("below")
    second = counted(first.where(F.col("n") > limit).select("s1", F.explode(F.array(
        F.struct(below[0].alias("key"), F.array(below[2], below[3]).alias("below")),
        F.struct(below[1].alias("key"), F.array(below[4], below[5]).alias("below")))).alias("x")).select("s1", "x.key", "x.below"))
    second = cut(second)
    third = counted(second.where(F.col("n") > limit).select("s1", F.explode("below").alias("key")))
    all_ = first.where(F.col("n") <= limit).select("s1", "key", "n", "sig").unionByName(
        second.where(F.col("n") <= limit).select("s1", "key", "n", "sig")).unionByName(third.select("s1", "key", "n", "sig"))
    once = all_.groupBy("n", "sig").agg(F.min("key").alias("key"))
    return all_.join(once, ["n", "sig", "key"]).select("s1", F.col("key").alias("leaf"), "n")


def compare(ids: np.ndarray, sets: list[np.ndarray], leaves: list[np.ndarray], leaf: int, side: np.ndarray | None,
            similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each unit counted in this node, and the least id that each is connected with here.

    ``side`` tells the two chunks of a node apart; pairs within one chunk are left to that chunk's own task.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    inter = np.zeros((n, n), dtype=np.float32)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.append(True, tokens[1:] != tokens[:-1])
    number = np.cumsum(new) - 1
    common = np.bincount(number) > 1
    keep = common[number]
    column = (np.cumsum(common) - 1)[number[keep]]
    owner = owner[keep]
    width = max(1, 4_000_000 // n)
    for at in range(0, int(common.sum()), width):
        inside = slice(*np.searchsorted(column, [at, at + width]))
        held = np.zeros((n, width), dtype=np.float32)
        held[owner[inside], column[inside] - at] = 1
        inter += held @ held.T
    linked = inter * (1 + similarity) + 1e-6 >= similarity * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    root = np.arange(n)
    while True:  # the least position among a unit and its neighbours, until nothing moves
        best = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1))
        best = best[best]
        if (best == root).all():
            break
        root = best
    earlier = sorted({x for held in leaves for x in held.tolist() if x < leaf})
    if earlier:
        place = {x: i for i, x in enumerate(earlier)}
        met = np.zeros((n, len(earlier)), dtype=np.float32)
        for i, held in enumerate(leaves):
            met[i, [place[x] for x in held.tolist() if x < leaf]] = 1
        linked &= (met @ met.T) == 0
    return linked.sum(axis=1), ids[root]


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similarity: float = SIMILARITY,
            recall: float = RECALL, limit: int = LIMIT) -> DataFrame:
    """One row per document: id, t1, t2 (text digest), class_id (least id of the class), class_key, n_links, n_copies.

    ``n_links`` counts the other sets of n-grams that are similar enough, ``n_copies`` the documents with the same set.
    """
    runs = runs_for(recall, similarity)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    t1, t2 = digest(text)
    source = docs.select(F.col(id_col).alias("id"), t1.alias("t1"), t2.alias("t2"), text.alias("text"))
    rows = cut(source.mapInPandas(_keyed(runs, n), f"id {kind}, t1 long, t2 long, s1 long, s2 long, keys array<long>"))
    units = rows.groupBy("s1", "s2").agg(F.min(F.struct("id", "t1", "t2")).alias("rep"), F.count(F.lit(1)).alias("n_copies"),
                                         F.first("keys").alias("keys"))
    leaves = cut(_leaves(units, runs, limit))
    chunks = F.ceil(F.col("n") / limit).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "s1"), chunks).cast("int")
    met = leaves.groupBy("s1").agg(F.collect_list(F.struct("leaf", chunks.alias("chunks"), own.alias("own"))).alias("met"))
    wanted = met.join(units.select("s1", "rep"), "s1").select("s1", "met", F.col("rep.id").alias("id"), "rep.t1", "rep.t2")
    texts = source.alias("d").join(wanted.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.t1") == F.col("w.t1")) & (
        F.col("d.t2") == F.col("w.t2"))).select("w.s1", "w.met", "d.text")

    def tokens(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                sets = [(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in token_sets(part["text"].tolist(), n)]
                yield pd.DataFrame({"s1": part["s1"], "met": part["met"], "tokens": sets})

    placed = texts.mapInPandas(tokens, "s1 long, met array<struct<leaf:long,chunks:int,own:int>>, tokens binary")
    placed = placed.withColumn("leaves", F.col("met.leaf")).withColumn("m", F.explode("met"))
    other = F.explode(F.sequence(F.lit(0), F.col("m.chunks") - 1))
    placed = placed.select("s1", "tokens", "leaves", "m", other.alias("c")).select(
        "s1", "tokens", "leaves", F.col("m.leaf").alias("leaf"), F.col("m.own").alias("own"),
        F.least("c", "m.own").alias("lo"), F.greatest("c", "m.own").alias("hi"))

    def brute(batches):
        def compared(group):
            first = group[0]
            held = {}
            for row in group:
                held.setdefault(row[0], row)
            if len(held) < 2:
                return None
            group = list(held.values())
            ids = np.array([r[0] for r in group], dtype=np.int64)
            order = np.argsort(ids)
            ids, group = ids[order], [group[i] for i in order]
            side = np.array([r[6] for r in group]) if first[4] != first[5] else None
            links, roots = compare(ids, [np.unique(np.frombuffer(r[1], dtype=np.uint32)) for r in group],
                                   [np.asarray(r[2], dtype=np.int64) for r in group], first[3], side, similarity)
            return pd.DataFrame({"s1": ids, "links": links.astype(np.int64), "root": roots})

        group, key, out, made = [], None, [], 0
        for b in batches:
            for row in b[["s1", "tokens", "leaves", "leaf", "lo", "hi", "own"]].itertuples(index=False, name=None):
                if row[3:6] != key:
                    if len(group) > 1 and (got := compared(group)) is not None:
                        out.append(got)
                        made += len(got)
                    group, key = [], row[3:6]
                group.append(row)
            if made > 5_000:
                yield pd.concat(out)
                out, made = [], 0
        if len(group) > 1 and (got := compared(group)) is not None:
            out.append(got)
        if out:
            yield pd.concat(out)

    found = cut(placed.repartition("leaf", "lo", "hi").sortWithinPartitions("leaf", "lo", "hi", "s1").mapInPandas(
        brute, "s1 long, links long, root long"))
    links = found.groupBy("s1").agg(F.sum("links").alias("n_links"))
    edges = found.where("s1 <> root").select(F.lit(0).alias("scope"), F.col("s1").alias("a"), F.col("root").alias("b")).distinct()
    parts = connected_components(edges, ["scope"]).select(F.col("node").alias("s1"), F.col("component").alias("part"))
    named = units.join(parts, "s1", "left").join(links, "s1", "left").select(
        "s1", "s2", "n_copies", F.coalesce("part", "s1").alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("rep.id").alias("rep_id"))
    least = named.groupBy("class_key").agg(F.min("rep_id").alias("class_id"))
    named = cut(named.join(least, "class_key").select("s1", "s2", "n_copies", "class_key", "n_links", "class_id"))
    return rows.select("id", "t1", "t2", "s1", "s2").join(named, ["s1", "s2"]).select(
        "id", "t1", "t2", "class_id", "class_key", "n_links", "n_copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the document of the least id of each class only; of repeated rows one stays."""
    got = classes(docs, id_col, text_col, **options)
    stay = got.groupBy("class_key").agg(F.min(F.struct("id", "t1", "t2")).alias("k"))
    names = fresh(docs, "join_t1", "join_t2", "join_id", "keep_t1", "keep_t2")
    t1, t2, k_id, k1, k2 = names
    stay = stay.select(F.col("k.id").alias(k_id), F.col("k.t1").alias(k1), F.col("k.t2").alias(k2))
    d1, d2 = digest(F.coalesce(F.col(text_col), F.lit("")))
    out = docs.withColumns({t1: d1, t2: d2})
    out = out.join(stay, F.col(id_col).eqNullSafe(F.col(k_id)) & (F.col(t1) == F.col(k1)) & (F.col(t2) == F.col(k2)))
    return out.dropDuplicates([k_id, k1, k2]).select(*docs.columns)
