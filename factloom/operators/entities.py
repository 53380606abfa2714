"""Entity resolution: surface forms of one document that mean the same thing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions import text as T
from factloom.operators.align import SCOPE
from factloom.operators.components import connected_components, connected_components_of_hubs
from factloom.operators.encode import _gram_codes, _windows, unit_length
from factloom.operators.skew import join_weighted
from factloom.session import checkpoint


def surface_forms(facts: DataFrame) -> DataFrame:
    """(scope, annotator, surface) of every subject and object; blanks and ``null`` are no entities."""
    return facts.select(*SCOPE, "annotator", F.explode(F.array(
        T.entity_surface("subject"), T.entity_surface("object"))).alias("surface")).where("surface is not null")


def cluster_id(representative) -> Column:
    """Readable, order-independent name: slug of the shortest member plus a short digest."""
    slug = F.btrim(F.substring(F.regexp_replace(F.lower(representative), "[^a-z0-9]+", "_"), 1, 24), F.lit("_"))
    return F.concat(F.lit("ent_"), slug, F.lit("_"), F.substring(F.sha1(representative), 1, 8))


def _merge_key(core_entities: bool) -> Column:
    return F.lower(T.entity_core("surface") if core_entities else F.col("surface"))


#: A gram that more prefixes of one document share is dealt into chunks of so many.
CHUNK = 1024
MOST_HOT = 250_000


def _counted(batches):
    """Each name with its distinct grams and how often it has them."""
    for b in batches:
        held = [_windows(name) for name in b.column("key").to_pylist()]
        yield pa.record_batch({**{c: b.column(c) for c in b.schema.names if c != "key"}, "gram": pa.array([list(h) for h in held], pa.list_(pa.string())),
                               "tf": pa.array([list(h.values()) for h in held], pa.list_(pa.int32()))})


def name_vectors(keys: DataFrame, threshold: float) -> DataFrame:
    """(k, g, w, rest, n_prefix): unit TF-IDF vector of each name of (scope, k, key, copies, total), rarest grams first.

    ``rest`` is the length of what follows each gram. The first ``n_prefix`` grams are those before which at least
    ``threshold`` is left: two names that share none of them cannot reach it.
    """
    named = keys.select(*SCOPE, "k", "key", "copies")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema if f.name != "key")
    rows = named.mapInArrow(_counted, kinds + ", gram array<string>, tf array<int>")
    rows = rows.select(*SCOPE, "k", "copies", F.explode(F.arrays_zip("gram", "tf")).alias("x"))
    rows = checkpoint(rows.select("k", F.col("copies").cast("int").alias("copies"), F.xxhash64(*SCOPE, "x.gram").alias("g"), F.col("x.tf").alias("tf")))
    often = rows.groupBy("g").agg(F.sum("copies").alias("df"), F.count(F.lit(1)).alias("n"))
    met = join_weighted(rows.select("k", "g", "tf"), often, ["g"], "n", rows.count())
    packed = met.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("df", "g", "tf"))).alias("v")).join(keys.select("k", "total"), "k")
    weight = F.transform("v", lambda x: (F.log(x["tf"]) + 1.0) * (F.log((F.col("total") + 1.0) / (x["df"] + 1.0)) + 1.0))
    packed = packed.select("k", F.col("v.g").alias("g"), weight.alias("w"))

    def prefixed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("w")
            w, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            starts = np.append(0, ends[:-1])
            owner = np.repeat(np.arange(len(ends)), ends - starts)
            w = w / np.sqrt(np.add.reduceat(w * w, starts))[owner]
            gone = np.cumsum(w * w)
            before = np.append(0.0, gone[ends - 1])[owner]
            rest = np.sqrt(np.maximum(0.0, 1.0 - (gone - before)))
            left = 1.0 - (gone - before - w * w)
            n_prefix = np.add.reduceat((left >= threshold * threshold - 1e-9).astype(np.int64), starts)
            offsets = pa.array(np.append(0, ends), pa.int32())
            yield pa.record_batch({"k": b.column("k"), "g": b.column("g"), "w": pa.ListArray.from_arrays(offsets, pa.array(w)),
                                   "rest": pa.ListArray.from_arrays(offsets, pa.array(rest)), "n_prefix": pa.array(n_prefix, pa.int32())})

    return packed.mapInArrow(prefixed, "k long, g array<long>, w array<double>, rest array<double>, n_prefix int")


def _reached(threshold: float):
    """Exact cosines of (a, b, g_a, w_a, g_b, w_b), a batch at a time; keeps (a, b) that reach the threshold."""
    def flat(column):
        return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())

    def run(batches):
        for b in batches:
            (ga, pair_a), (gb, pair_b) = flat(b.column("g_a")), flat(b.column("g_b"))
            g, pair = np.concatenate([ga, gb]), np.concatenate([pair_a, pair_b])
            w = np.concatenate([b.column("w_a").flatten().to_numpy(), b.column("w_b").flatten().to_numpy()])
            order = np.lexsort((g, pair))
            g, pair, w = g[order], pair[order], w[order]
            both = np.flatnonzero((g[1:] == g[:-1]) & (pair[1:] == pair[:-1]))
            dot = np.bincount(pair[both], weights=w[both] * w[both + 1], minlength=b.num_rows)
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(dot >= threshold))

    return run


def similar_names(vectors: DataFrame, threshold: float, chunk: int = CHUNK) -> DataFrame:
    """(a, b), a < b: names of one document whose cosine reaches the threshold.

    Prefixes meet on their grams. What they share, and the product of what both have left behind the last shared gram,
    bounds the cosine; only pairs within the bound fetch whole vectors. A gram of many prefixes is dealt into chunks.
    """
    part = lambda c: F.slice(c, 1, F.col("n_prefix")).alias(c)
    prefix = vectors.select("k", F.explode(F.arrays_zip(part("g"), part("w"), part("rest"))).alias("x")).select("k", "x.*")
    hot = checkpoint(prefix.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select("g", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    n_hot = hot.count()
    left, right, on = prefix, prefix, ["g"]
    if n_hot:
        hot, on = F.broadcast(hot) if n_hot <= MOST_HOT else hot, ["g", "c"]
        held = prefix.join(hot, "g", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        left = held.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        right = held.withColumn("c", F.pmod(F.xxhash64("k"), "chunks").cast("int")).drop("chunks")
    left, right = (df.select(*on, F.col("k").alias(s), F.col("w").alias(f"w_{s}"), F.col("rest").alias(f"rest_{s}")) for df, s in ((left, "a"), (right, "b")))
    met = left.join(right, on).where("a < b").groupBy("a", "b").agg(
        F.sum(F.col("w_a") * F.col("w_b")).alias("shared"), F.min("rest_a").alias("rest_a"), F.min("rest_b").alias("rest_b"))
    near = met.where(F.col("shared") + F.col("rest_a") * F.col("rest_b") >= threshold - 1e-9).select("a", "b")
    of = lambda s: vectors.select(F.col("k").alias(s), F.col("g").alias(f"g_{s}"), F.col("w").alias(f"w_{s}"))
    return near.join(of("a"), "a").join(of("b"), "b").select("a", "b", "g_a", "w_a", "g_b", "w_b").mapInArrow(_reached(threshold), "a long, b long")


def _cluster_large(forms: DataFrame, threshold: float, core_entities: bool, chunk: int) -> DataFrame:
    """(scope, surface, representative) of (scope, surface): weights, candidates and components are joins over all documents at
    once, so a document may have any number of names; no task holds a document, and there is no matrix."""
    forms = checkpoint(forms.withColumn("key", _merge_key(core_entities)))
    keys = forms.groupBy(*SCOPE, "key").agg(F.count(F.lit(1)).alias("copies"))
    keys = checkpoint(keys.withColumn("k", F.monotonically_increasing_id()))
    n = keys.count()
    totals = keys.groupBy(*SCOPE).agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("names"))
    vectors = checkpoint(name_vectors(join_weighted(keys, totals, SCOPE, "names", n), threshold))
    edges = similar_names(vectors, threshold, chunk).select(F.lit(0).alias("s"), "a", "b")
    roots = connected_components_of_hubs(edges, ["s"]).select(F.col("node").alias("k"), "component")
    placed = keys.join(roots, "k", "left").select(*SCOPE, "key", F.coalesce("component", "k").alias("root"))
    members = checkpoint(forms.join(placed, [*SCOPE, "key"]).select(*SCOPE, "surface", "root"))
    named = members.groupBy("root").agg(F.min(F.struct(F.length("surface").alias("l"), "surface")).alias("x"), F.count(F.lit(1)).alias("n"))
    named = named.select("root", F.col("x.surface").alias("representative"), "n")
    return join_weighted(members, named, ["root"], "n", members.count()).select(*SCOPE, "surface", "representative")


#: Characters of names one task may hold for one document; about so many of several documents are clustered at a time.
TASK_CHARS = 1_000_000
BATCH_CHARS = 250_000
#: Gram meetings and pairs looked at in one go, whatever the document.
MEETINGS = 1_000_000
PAIRS = 10_000


class _Vectors:
    """Unit TF-IDF vectors of names that know their document, each with its rarest grams first; ``term`` is a gram of a document."""

    def __init__(self, names: list[str], document: np.ndarray, copies: np.ndarray, total: np.ndarray):
        name, code = _gram_codes(names)
        found, gram = np.unique(code, return_inverse=True)
        both, tf = np.unique(name * max(len(found), 1) + gram, return_counts=True)
        name, gram = np.divmod(both, max(len(found), 1))
        terms, term = np.unique(document[name] * max(len(found), 1) + gram, return_inverse=True)
        df = np.bincount(term, weights=copies[name], minlength=len(terms))[term]
        raw = (np.log(tf) + 1.0) * (np.log((total[document[name]] + 1.0) / (df + 1.0)) + 1.0)
        order = np.lexsort((term, df, name))
        self.name, self.term = name[order], term[order]
        self.weight = unit_length(self.name, raw[order], self.term, len(names))[2]
        self.starts = np.searchsorted(self.name, np.arange(len(names) + 1))

    def after(self) -> tuple[np.ndarray, np.ndarray]:
        """(what is left from each gram on, what is left behind it), squared."""
        square = self.weight * self.weight
        gone = np.append(0.0, np.cumsum(square))
        left = gone[self.starts[self.name + 1]] - gone[:-1]
        return left, np.maximum(left - square, 0.0)

    def cosines(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whole cosines of listed pairs."""
        size = np.concatenate([self.starts[a + 1] - self.starts[a], self.starts[b + 1] - self.starts[b]])
        pair = np.repeat(np.append(np.arange(len(a)), np.arange(len(b))), size)
        at = np.arange(len(pair)) + np.repeat(np.append(self.starts[a], self.starts[b]) - np.append(0, np.cumsum(size)[:-1]), size)
        key = pair * (int(self.term.max(initial=0)) + 1) + self.term[at]
        order = np.argsort(key)
        key, at = key[order], at[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        return np.bincount(pair[order[same]], weights=self.weight[at[same]] * self.weight[at[same + 1]], minlength=len(a))


def _linked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (the smallest name of each component) after linking the pairs (a, b)."""
    while len(a):
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        np.minimum.at(root, np.maximum(x, y), low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _similar_roots(vectors: _Vectors, n: int, threshold: float) -> np.ndarray:
    """The root of each of ``n`` names, linked where the cosine within a document reaches the threshold.

    The prefix filter of ``similar_names``: names meet on the grams before which the threshold is left, in slices of bounded
    size; pairs that earlier links have joined are passed over, so links are never listed.
    """
    root = np.arange(n)
    left, rest = vectors.after()
    prefix = np.flatnonzero(left >= threshold * threshold - 1e-9)
    # by term, then name: those that a gram meets are the ones behind it up to the end of its term
    by_term = prefix[np.argsort(vectors.term[prefix], kind="stable")]
    place = np.empty(len(vectors.term), np.int64)
    place[by_term] = np.arange(len(by_term))
    end = np.searchsorted(vectors.term[by_term], vectors.term[prefix], side="right")
    meets = end - place[prefix] - 1
    upto = np.append(0, np.cumsum(meets))
    bounds = np.searchsorted(vectors.name[prefix], np.arange(n + 1))
    done = 0
    while done < n:  # all meetings of one name fall into one slice
        following = max(done + 1, int(np.searchsorted(upto[bounds], upto[bounds[done]] + MEETINGS, side="right")) - 1)
        own = prefix[bounds[done]:bounds[following]]
        many = meets[bounds[done]:bounds[following]]
        done = following
        mine = np.repeat(own, many)
        if not len(mine):
            continue
        other = by_term[np.arange(len(mine)) + np.repeat(place[own] + 1 - np.append(0, np.cumsum(many)[:-1]), many)]
        key = vectors.name[mine] * n + vectors.name[other]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        shared = np.add.reduceat((vectors.weight[mine] * vectors.weight[other])[order], first)
        rest_a, rest_b = (np.minimum.reduceat(rest[s][order], first) for s in (mine, other))
        a, b = np.divmod(key[first][shared + np.sqrt(rest_a * rest_b) >= threshold - 1e-9], n)
        for at in range(0, len(a), PAIRS):
            x, y = a[at:at + PAIRS], b[at:at + PAIRS]
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
            near = vectors.cosines(x, y) >= threshold
            root = _linked(root, x[near], y[near])
    return root


def _representatives(surfaces: list[str], keys: list[str], document: np.ndarray, total: np.ndarray, threshold: float) -> list[str]:
    """The shortest surface, of equal ones the first, of each surface's cluster."""
    numbers: dict[tuple[int, str], int] = {}
    key = np.fromiter((numbers.setdefault(x, len(numbers)) for x in zip(document.tolist(), keys)), np.int64, len(keys))
    of = np.fromiter((d for d, _ in numbers), np.int64, len(numbers))
    vectors = _Vectors([k for _, k in numbers], of, np.bincount(key, minlength=len(numbers)), total)
    root = _similar_roots(vectors, len(numbers), threshold)[key].tolist()
    least: dict[int, tuple[int, str]] = {}
    for r, s in zip(root, surfaces):
        if r not in least or (len(s), s) < least[r]:
            least[r] = (len(s), s)
    return [least[r][1] for r in root]


def _cluster_documents(threshold: float):
    """(scope, surface, representative) of whole documents that come one behind the other as rows (scope, surface, key, total)."""
    def clustered(rows: pa.Table) -> list[pa.RecordBatch]:
        starts = _document_starts(rows)
        held = np.diff(np.append(starts, rows.num_rows))
        total = rows.column("total").to_numpy()[starts]
        if (held != total).any():
            raise RuntimeError("a document's names came in parts")
        surface = rows.column("surface")
        found = _representatives(surface.to_pylist(), rows.column("key").to_pylist(), np.repeat(np.arange(len(starts)), held), total, threshold)
        out = rows.select([*SCOPE, "surface"]).append_column("representative", pa.array(found, pa.string()))
        return out.combine_chunks().to_batches()

    def run(batches):
        waiting, chars = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            waiting.append(b)
            chars += pc.sum(pc.utf8_length(b.column("key"))).as_py() or 0
            if chars >= BATCH_CHARS:
                rows = pa.Table.from_batches(waiting)
                whole = int(_document_starts(rows)[-1])
                if whole:
                    yield from clustered(rows.slice(0, whole))
                    waiting = rows.slice(whole).combine_chunks().to_batches()
                    chars = pc.sum(pc.utf8_length(waiting[0].column("key"))).as_py() or 0
        if waiting:
            yield from clustered(pa.Table.from_batches(waiting))

    return run


def _document_starts(rows: pa.Table) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for c in SCOPE:
        values = rows.column(c).combine_chunks()
        new[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def cluster(facts: DataFrame, threshold: float = 0.78, core_entities: bool = True, chunk: int = CHUNK, sizes: DataFrame | None = None) -> DataFrame:
    """(scope, surface, cluster_id): single-link clusters of similar names per document.

    Names with equal merge keys fold first. Names travel once, keyed by document, or stay where facts dealt out by document
    lie; tasks fit TF-IDF and link the names of as many documents at a time as fill a batch, so grams are never shuffled or
    stored. Documents of more than ``TASK_CHARS`` of names are clustered by joins: ``sizes`` has (scope, n_chars), once for each
    document and no less than its names; without it they are measured. Documents without an id or version are left out.
    """
    named = surface_forms(facts.dropna(subset=SCOPE)).select(*SCOPE, "surface")
    if sizes is None:
        sizes = named.groupBy(*SCOPE).agg(F.sum(F.length("surface")).alias("n_chars"))
    oversized = checkpoint(sizes.where(F.col("n_chars") > TASK_CHARS).select(*SCOPE))
    some = not oversized.isEmpty()
    ordinary = (named.join(F.broadcast(oversized), SCOPE, "left_anti") if some else named).distinct().withColumn("key", _merge_key(core_entities))
    # the window brings a document's names together, and says how many there are
    ordinary = ordinary.withColumn("total", F.count(F.lit(1)).over(W.partitionBy(*SCOPE)))
    kinds = "guideline_version string, doc_id string, surface string, representative string"
    found = ordinary.mapInArrow(_cluster_documents(threshold), kinds)
    if some:
        large = named.join(F.broadcast(oversized), SCOPE, "left_semi").distinct()
        found = found.unionByName(_cluster_large(large, threshold, core_entities, chunk))
    return found.select(*SCOPE, "surface", cluster_id(F.col("representative")).alias("cluster_id"))


def alignment_components(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(scope, fact_id, component): facts linked by any chain of pairs; singletons keep their own id."""
    links = pairs.where("fact_a_id is not null and fact_b_id is not null").select(
        *SCOPE, F.col("fact_a_id").alias("a"), F.col("fact_b_id").alias("b"))
    linked = connected_components(links, SCOPE).withColumnRenamed("node", "fact_id")
    return facts.select(*SCOPE, "fact_id").join(linked, [*SCOPE, "fact_id"], "left").select(
        *SCOPE, "fact_id", F.coalesce("component", "fact_id").alias("component"))
