"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has bit b set if more than half of the 64-bit hashes of its
word shingles (repeats included) have it. Fingerprints link at ``radius`` or
fewer differing bits. Cut into ``radius // 2 + 1`` segments, two linked ones
differ by at most one bit in some segment, or the segments would differ by more
than ``radius`` together. Every segment is therefore indexed under each of its
one-wildcard variants (which bit is left out, and all others): segments that
differ by at most one bit share a variant, an equality join brings them
together, and the whole fingerprints are verified.

Equal fingerprints fold into one before anything else. How many fingerprints
share a segment is counted first, so a variant of more than ``limit`` of them is
known before it is shuffled. Such a variant is dealt into chunks that are
compared each in itself; components follow; then, in variants that are not of one
component by now, everything outside the main component meets everything, chunk
by chunk. Pairs of one component need no comparison, so the rows of a large
group of near copies are copied only as often as there are chunks of strangers
among them. Tasks return spanning edges, never all pairs.

Defined cases: a null or blank text has fingerprint zero and is linked like any
other; fewer words than a shingle are one shingle; repeated rows, and texts of
equal fingerprints, are one component; null ids are kept, and a component of null
ids only has a null name; very long texts are hashed in pieces of a megabyte;
columns besides id and text are not read, so their names cannot clash; an empty
table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut
from factloom.operators.components import connected_components_of_hubs
from factloom.operators.skew import join_weighted

WORDS, RADIUS, SEED = 4, 4, 42
BITS = 64
LIMIT = 4096
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20
#: Groups of at most so many rows are compared all at once, by shifting the sorted rows.
_SHORT = 16


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    """Fingerprint of a UTF-8 text; only A-Z is lower-cased and only ASCII blanks part words."""
    ones, n, carried, at = np.zeros(BITS, dtype=np.int64), 0, [], 0
    hashed = xxhash.xxh64_intdigest
    while at < len(raw):
        stop = _BLANK.search(raw, at + _PIECE)
        stop = stop.start() if stop else len(raw)
        held = carried + raw[at:stop].lower().split()
        at = stop
        if len(held) < words:
            carried = held
            continue
        line = b" ".join(held)
        lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
        ends = np.cumsum(lengths + 1) - 1
        first, last = (ends - lengths)[: len(held) - words + 1].tolist(), ends[words - 1 :].tolist()
        got = np.fromiter([hashed(line[a:b], SEED) for a, b in zip(first, last)], dtype=np.uint64, count=len(last))
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(got)
        carried = held[len(held) - words + 1 :]
    if not n and carried:
        return hashed(b" ".join(carried), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp): one row per row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        for b in batches:
            got = np.array([fingerprint(raw.as_py() or b"", words) for raw in b.column("raw")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got.view(np.int64))], ["id", "fp"])

    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))
    return raw.mapInArrow(rows, f"id {kind}, fp long")


def segments(radius: int) -> list[tuple[int, int]]:
    """(offset, width) of the segments, of which one differs by at most one bit within ``radius``."""
    parts = radius // 2 + 1
    ends = [BITS * (i + 1) // parts for i in range(parts)]
    return [(lo, hi - lo) for lo, hi in zip([0, *ends], ends)]


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left, a, b = np.sort(fps), [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            found = []
            for at in range(0, len(front), 256):
                near = np.bitwise_count(front[at : at + 256, None] ^ left[None, :]) <= radius
                hit = near.any(axis=0)
                if hit.any():
                    a.append(front[at + near.argmax(axis=0)[hit]])
                    b.append(left[hit])
                    found.append(left[hit])
                    left = left[~hit]
            front = np.concatenate(found) if found else left[:0]
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate(a or [empty]), np.concatenate(b or [empty])


def grouped_edges(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal keys (sorted): all of those of short groups, a spanning forest of others."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    short = np.repeat(sizes <= _SHORT, sizes)
    for step in range(1, min(_SHORT, int(sizes.max(initial=1)))):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & short[step:])
        at = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= radius]
        a.append(fps[at])
        b.append(fps[at + step])
    for i in np.flatnonzero(sizes > _SHORT).tolist():
        x, y = forest(np.unique(fps[starts[i] : starts[i] + sizes[i]]), radius)
        a.append(x)
        b.append(y)
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate(a or [empty]), np.concatenate(b or [empty])


def _edges(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b) from (key, fp): rows of one key are compared in one task; a group never exceeds two chunks."""

    def compared(batches):
        keys, fps, seen = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), set()
        for b in batches:
            keys = np.concatenate([keys, b["key"].to_numpy()])
            fps = np.concatenate([fps, b["fp"].to_numpy().view(np.uint64)])
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if done >= 1 << 16:
                yield made(keys[:done], fps[:done])
                keys, fps = keys[done:], fps[done:]
        yield made(keys, fps)

    def made(keys, fps):
        x, y = grouped_edges(keys, fps, radius)
        pairs = pd.DataFrame({"a": np.minimum(x, y).view(np.int64), "b": np.maximum(x, y).view(np.int64)})
        return pairs[pairs["a"] != pairs["b"]].drop_duplicates()

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(compared, "a long, b long")


def _each_bit():
    return F.explode(F.expr("transform(sequence(0, w - 1), i -> struct(i, shiftleft(1L, i) AS bit))")).alias("x")


def _marked(units: DataFrame, radius: int, limit: int) -> DataFrame:
    """(fp, s, v, w, marks): each fingerprint's segments; ``marks`` has the chunks of each wildcard whose variant is too large."""
    cuts = segments(radius)
    value = lambda lo, width: F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(-1 if width == BITS else (1 << width) - 1))
    parts = units.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s).alias("s"), value(lo, w).alias("v"), F.lit(w).alias("w")) for s, (lo, w) in enumerate(cuts)])).alias("x"))
    parts = cut(parts.select("fp", "x.*"))
    counts = parts.groupBy("s", "v", "w").agg(F.count(F.lit(1)).alias("c"))
    # a variant holds two values of its segment, so one above the limit has a value above half of it
    large = counts.where(F.col("c") > limit // 2).select("s", "v", "c", _each_bit()).select(
        "s", F.col("x.i").alias("i"), F.col("v").bitwiseAND(F.bitwise_not("x.bit")).alias("rest"), "x.bit", "c")
    large = large.groupBy("s", "i", "rest", "bit").agg(F.ceil((F.sum("c") + limit // 2) / limit).cast("int").alias("chunks"))
    marks = large.select("s", F.explode(F.array("rest", F.col("rest").bitwiseOR(F.col("bit")))).alias("v"), "i", "chunks")
    marks = marks.groupBy("s", "v").agg(F.map_from_entries(F.collect_list(F.struct("i", "chunks"))).alias("marks"))
    counts = counts.join(marks, ["s", "v"], "left").select("s", "v", "c", "marks")
    return cut(join_weighted(parts, counts, ["s", "v"], "c", parts.count()).select("fp", "s", "v", "w", "marks"))


def _variants(marked: DataFrame) -> DataFrame:
    """(fp, variant, chunks): each fingerprint under every one-wildcard variant, and in how many chunks that is dealt."""
    variant = F.xxhash64("s", "x.i", F.col("v").bitwiseAND(F.bitwise_not("x.bit")))
    return marked.select("fp", "s", "v", "marks", _each_bit()).select(
        "fp", variant.alias("variant"), F.coalesce(F.col("marks")[F.col("x.i")], F.lit(1)).alias("chunks"))


def _strangers(large: DataFrame, parts: DataFrame, limit: int) -> DataFrame:
    """(key, fp): in large variants of several components, all pairs of chunks of which one is outside the main component."""
    rows = cut(large.join(parts, "fp", "left").select("variant", "fp", F.coalesce("part", "fp").alias("part")))
    counts = rows.groupBy("variant", "part").agg(F.count(F.lit(1)).alias("n"))
    plan = counts.groupBy("variant").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("total")).where("main.n < total")
    chunks = lambda n: F.ceil(n / limit).cast("int")
    plan = plan.select("variant", "total", F.col("main.part").alias("main"), chunks(F.col("main.n")).alias("m"),
                       chunks(F.col("total") - F.col("main.n")).alias("r"))
    got = join_weighted(rows, plan, ["variant"], "total", rows.count())
    inside, h = F.col("part") == F.col("main"), F.xxhash64(F.lit(5), "fp")
    own = F.when(inside, F.pmod(h, "m")).otherwise(F.pmod(h, "r")).cast("int")
    pair = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    met = F.when(inside, F.transform(upto("r"), lambda r: pair("mr", F.col("own"), r))).otherwise(F.concat(
        F.transform(upto("m"), lambda m: pair("mr", m, F.col("own"))),
        F.transform(upto("r"), lambda r: pair("rr", F.least(r, F.col("own")), F.greatest(r, F.col("own"))))))
    got = got.withColumn("own", own).select("variant", "fp", F.explode(met).alias("x"))
    return got.select(F.xxhash64("variant", "x.kind", "x.lo", "x.hi").alias("key"), "fp")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS,
               limit: int = LIMIT) -> DataFrame:
    """(id, fp, component_id): one row per row of ``docs``; ``component_id`` is the least id that links reach."""
    rows = cut(fingerprints(docs, id_col, text_col, words))
    units = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    marked = _marked(units, radius, limit)
    dealt = F.when(F.col("chunks") > 1, F.xxhash64("variant", F.pmod(F.xxhash64("fp"), "chunks"))).otherwise(F.col("variant"))
    edges = cut(_edges(_variants(marked).select(dealt.alias("key"), "fp"), radius).distinct())
    parts = lambda e: connected_components_of_hubs(e.select(F.lit(0).alias("scope"), "a", "b"), ["scope"]).select(
        F.col("node").alias("fp"), F.col("component").alias("part"))
    large = cut(_variants(marked.where("marks is not null")).where("chunks > 1").select("variant", "fp"))
    found = parts(edges)
    if not large.isEmpty():
        found = cut(found)
        more = _edges(_strangers(large, found, limit), radius)
        found = parts(edges.unionByName(more))
    named = cut(units.join(found, "fp", "left").select("fp", "least", "n", F.coalesce("part", "fp").alias("part")))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("of_part"))
    n = rows.count()
    named = join_weighted(named, least, ["part"], "of_part", n).select("fp", "n", "component_id")
    return join_weighted(rows, named, ["fp"], "n", n).select("id", "fp", "component_id")
