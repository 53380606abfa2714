"""Find benchmark items inside documents by SimHash over item-sized windows.

Every item gets a 64-bit SimHash of its word pairs. Documents slide windows of the
items' own sizes: the per-bit votes of all pairs are summed up once per document,
so a window's fingerprint is a difference of two rows. Item sizes are gathered in
classes a few per cent apart, and windows step by a small part of their size from
the first word of each document on, with one more window at its end, so one
window is always nearly in place. A multi-index over blocks of the
fingerprint finds every item of the class within the radius: the blocks' own
radii and one each add up to one more than the radius, so whoever is beyond all
of them is beyond it. Each block value leads to the list of items near it, and
only listed items are compared. Survivors are moved over the words around them and verified by the
exact Jaccard similarity of their word shingles with the item's, plain or
weighted, whichever is greater; in the weighted one a shingle that several
distinct items share weighs less. Those counts are taken once over all items, so
neither copies of an item nor the slices below change a similarity.

The items travel to the tasks in slices of at most ``SLICE`` items, one pass over
the documents for each slice. Documents are never shuffled.

Defined cases: null and empty texts and items without words match nothing; items
of fewer words than a shingle compare as one shingle; equal items match alike
and equal documents too; null ids pass through; other columns are not read by
``leaks`` and pass through ``clean``; empty tables give no leaks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fresh, remembered, shingles, text_words

N, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 17, 4
#: Items per pass; their lists take about 13 kB each in every worker.
SLICE = 5_000
#: Windows step by this part of their size, and the sizes of a class differ by as much at either side.
STEP = 16
#: Word pairs whose votes are summed up at a time.
BLOCK = 1 << 15
#: Windows times items of a class that are looked up at a time.
LOOKED_UP = 1 << 21


def votes(pairs: np.ndarray, kind: type) -> np.ndarray:
    """Running sums of the bits of the word pairs, several counters to a 64-bit number; one row more than pairs.

    Counters may run over into their neighbours here; the difference of two rows
    is exact as long as each counter of the difference fits ``kind``.
    """
    bits = np.unpackbits(pairs.astype("<u8").view(np.uint8), bitorder="little").astype(kind, copy=False)
    lanes = bits.view(np.uint64).reshape(len(pairs), -1)
    out = np.zeros((len(pairs) + 1, lanes.shape[1]), dtype=np.uint64)
    np.cumsum(lanes, axis=0, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, kind: type, size: int, starts: np.ndarray) -> np.ndarray:
    """SimHash of the windows of ``size`` pairs that begin at ``starts``."""
    ones = (sums[starts + size] - sums[starts]).view(kind)
    return np.packbits(ones.reshape(-1) > size // 2, bitorder="little").view("<u8")


def grid(begins: np.ndarray, lengths: np.ndarray, size: int, step: int) -> np.ndarray:
    """First words of the windows of ``size`` words: every ``step`` words from each text's begin, and the last one of each text."""
    fits = lengths >= size
    begins, last = begins[fits], lengths[fits] - size
    each = -(-last // step) + 1
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return np.repeat(begins, each) + np.minimum(at * step, np.repeat(last, each))


class Index:
    """Items of one slice: by size class a multi-index of fingerprints, and their weighted shingles."""

    def __init__(self, ids: list, texts: list[str | None], n: int, similarity: float, radius: int, blocks: int,
                 shared: tuple[np.ndarray, np.ndarray] | None = None):
        """``shared`` as from ``shared_shingles``; without it, these items are all there are."""
        self.n, self.similarity, self.radius = n, similarity, radius
        hashed = text_words(texts)
        keep = [i for i, h in enumerate(hashed) if len(h)]
        if not keep:
            self.classes, self.ids = [], []
            return
        self.ids, self.words = [ids[i] for i in keep], [hashed[i] for i in keep]
        self.shingles = [Counter(shingles(h, n).tolist()) for h in self.words]
        if shared is None:
            distinct = {h.tobytes(): s for h, s in zip(self.words, self.shingles)}
            counts = Counter(x for s in distinct.values() for x in s)
            held = sorted(x for x, c in counts.items() if c > 1)
            shared = np.array(held, dtype=np.uint64), np.array([counts[x] for x in held], dtype=np.int64)
        self.shared = shared
        self.total = []
        for s in self.shingles:
            weight = self.weights(np.fromiter(s, dtype=np.uint64, count=len(s)))
            self.total.append(float(weight @ np.fromiter(s.values(), dtype=np.int64, count=len(s))))
        sizes = sorted({len(h) for h in self.words})
        self.classes, members = [], {}
        while sizes:
            least = sizes[0]
            inside = [x for x in sizes if x <= least + 2 * least / STEP]
            sizes = sizes[len(inside) :]
            size = (inside[0] + inside[-1]) // 2
            members[size] = [i for i, h in enumerate(self.words) if inside[0] <= len(h) <= inside[-1]]
        self.blocks, self.lists = blocks, {}
        for size, held in members.items():
            prints = np.array([self._print(self.words[i]) for i in held], dtype=np.uint64)
            self.classes.append((size, max(1, round(size / STEP)), np.array(held), prints))
        longest = max(members)
        self.kind = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.uint32

    def weights(self, grams: np.ndarray) -> np.ndarray:
        """1 / number of distinct items that hold a shingle; 1 also if none does."""
        keys, counts = self.shared
        out = np.ones(len(grams))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            known = keys[at] == grams
            out[known] /= counts[at[known]]
        return out

    @staticmethod
    def _print(hashes: np.ndarray) -> int:
        pairs = shingles(hashes, 2)
        return int(fingerprints(votes(pairs, np.uint32), np.uint32, len(pairs), np.array([0]))[0])

    def _block_lists(self, prints: np.ndarray) -> list[tuple[np.uint64, np.ndarray, np.ndarray]]:
        """For each block (shift, first place of each of its values, items): the items near a value lie side by side."""
        width, out = 64 // self.blocks, []
        each, more = divmod(self.radius + 1, self.blocks)
        values = np.arange(1 << width, dtype=np.uint32)
        kind = np.uint16 if len(prints) <= 1 << 16 else np.int32
        for b in range(self.blocks):
            near = values[np.bitwise_count(values) <= each + (b < more) - 1] if each + (b < more) else values[:0]
            shift = np.uint64(b * width)
            own = ((prints >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)
            keys = (own[:, None] ^ near[None, :]).ravel().astype(np.uint16 if width <= 16 else np.uint32)
            order = np.argsort(keys, kind="stable")
            first = np.zeros((1 << width) + 1, dtype=np.int64)
            np.cumsum(np.bincount(keys, minlength=1 << width), out=first[1:])
            out.append((shift, first, (order // max(1, len(near))).astype(kind)))
        return out

    def _near(self, got: np.ndarray, size: int, prints: np.ndarray):
        """(window, item) positions within the radius, of the items that the blocks of a window lead to."""
        lists = self.lists.get(size)
        if lists is None:
            lists = self.lists[size] = self._block_lists(prints)
        mask, most = np.uint64((1 << 64 // self.blocks) - 1), max(1, LOOKED_UP // len(prints))
        for lo in range(0, len(got), most):
            part, found = got[lo : lo + most], []
            for shift, first, items in lists:
                value = ((part >> shift) & mask).astype(np.intp)
                begin = first[value]
                n = first[value + 1] - begin
                end = np.cumsum(n)
                w = np.repeat(np.arange(len(part)), n)
                i = items[np.arange(end[-1]) + np.repeat(begin - end + n, n)]
                close = np.flatnonzero(np.bitwise_count(prints[i] ^ part[w]) <= self.radius)
                if len(close):
                    found.append(w[close] * len(prints) + i[close])
            if found:
                w, i = np.divmod(np.unique(np.concatenate(found)), len(prints))
                yield lo + w, i

    def candidates(self, words: list[np.ndarray]):
        """(document, item, first word, words) positions of all windows within the radius, for several documents at once."""
        flat, lengths = np.concatenate(words), np.array([len(w) for w in words])
        begins = np.append(0, np.cumsum(lengths)[:-1])
        doc_of = np.repeat(np.arange(len(words)), lengths)
        pairs = shingles(flat, 2)
        most = max(c[0] for c in self.classes)
        longer = [(begins[lengths > size], lengths[lengths > size]) for size, *_ in self.classes]
        grids = [grid(*of, max(2, size), step) for of, (size, step, *_) in zip(longer, self.classes)]
        for lo in range(0, len(pairs), BLOCK):
            sums = votes(pairs[lo : lo + BLOCK + most], self.kind)
            for (size, _, held, prints), starts in zip(self.classes, grids):
                starts = starts[slice(*np.searchsorted(starts, [lo, lo + BLOCK]))]
                if not len(starts):
                    continue
                for w, i in self._near(fingerprints(sums, self.kind, max(1, size - 1), starts - lo), size, prints):
                    first = starts[w]
                    yield doc_of[first], held[i], first - begins[doc_of[first]], size
        own = {}
        for size, _, held, prints in self.classes:  # a text not longer than the window is one window, if long enough to match
            short = np.flatnonzero((lengths <= size) & (lengths > 0) & (lengths >= self.similarity * size - self.n))
            for d in short.tolist():
                if d not in own:
                    own[d] = self._print(words[d])
            for w, i in self._near(np.array([own[d] for d in short.tolist()], dtype=np.uint64), size, prints):
                for at in np.unique(w):
                    d, items = short[at], held[i[w == at]]
                    yield np.full(len(items), d), items, np.zeros(len(items), dtype=np.int64), int(lengths[d])

    def best(self, item: int, hashes: np.ndarray, grams: np.ndarray, weights: np.ndarray, at: int, size: int) -> tuple[float, int, int]:
        """(similarity, first word, words) of the most similar item-sized window at most a step away from ``at``."""
        own, total, length = self.shingles[item], self.total[item], len(self.words[item])
        k = min(self.n, len(hashes))
        reach = max(1, round(size / STEP)) + abs(length - size) + 1
        first, end = max(0, at - reach), min(len(hashes), at + max(size, length) + reach)
        span = min(length, end - first) - k + 1
        near, weight = grams[first : end - k + 1].tolist(), weights[first : end - k + 1].tolist()
        n_own = sum(own.values())
        known = [x in own for x in near]
        if sum(known) < self.similarity * n_own - 1e-9 and sum([w for w, x in zip(weight, known) if x]) < self.similarity * total - 1e-9:
            return 0.0, first, 0
        count, same, inter, sum_ = Counter(), 0, 0.0, 0.0
        top = (0.0, first, min(length, end - first))
        for j, x in enumerate(near):
            sum_ += weight[j]
            count[x] += 1
            if count[x] <= own[x]:
                same += 1
                inter += weight[j]
            if j >= span:
                y = near[j - span]
                sum_ -= weight[j - span]
                if count[y] <= own[y]:
                    same -= 1
                    inter -= weight[j - span]
                count[y] -= 1
            if j >= span - 1:
                got = max(inter / max(sum_ + total - inter, 1e-12), same / max(span + n_own - same, 1))
                if got > top[0] + 1e-12:
                    top = (got, first + j - span + 1, min(length, end - first))
        return top

    def hits(self, words: list[np.ndarray]) -> list[list[tuple[int, float, int, int]]]:
        """For each document (item position, similarity, first word, words): the best window of every item that reaches the similarity."""
        out: list[dict] = [{} for _ in words]
        if self.classes and any(len(w) for w in words):
            tried, grams = set(), {}
            for docs, items, firsts, size in self.candidates(words):
                reach = max(1, round(size / STEP))
                for d, item, at in zip(docs.tolist(), items.tolist(), firsts.tolist()):
                    if (d, item, at // reach) in tried:
                        continue
                    tried.add((d, item, at // reach))
                    if d not in grams:
                        held = shingles(words[d], self.n)
                        grams[d] = held, self.weights(held)
                    got = self.best(item, words[d], *grams[d], at, size)
                    if got[0] >= self.similarity - 1e-9 and got[0] > out[d].get(item, (0.0,))[0]:
                        out[d][item] = got
        return [[(i, *found[i]) for i in sorted(found)] for found in out]


def _slices(items: DataFrame, id_col: str, text_col: str, most: int):
    """Lists of (id, text), at most ``most`` at a time, in the order of a digest."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    n = rows.count()
    parts = max(1, -(-n // (most // 2)))
    for k in range(parts):
        got = rows.where(F.pmod(F.xxhash64(F.lit(9), "id", "text"), F.lit(parts)) == k).collect() if n else []
        for at in range(0, len(got), most):
            part = sorted(got[at : at + most], key=lambda r: (r[0] is None, r[0], r[1]))
            yield [r[0] for r in part], [r[1] for r in part]


def shared_shingles(items: DataFrame, text_col: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several distinct items hold, sorted, and how many do; items of the same words count once."""

    def held(batches):
        import hashlib

        for b in batches:
            words = [h for h in text_words(b["text"].tolist()) if len(h)]
            grams = [np.unique(shingles(h, n)).view(np.int64) for h in words]
            keys = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in words]
            yield pd.DataFrame({"item": [k for k, g in zip(keys, grams) for _ in range(len(g))],
                                "shingle": np.concatenate([*grams, np.empty(0, dtype=np.int64)])})

    rows = items.select(F.col(text_col).alias("text")).where("text is not null").mapInPandas(held, "item binary, shingle long")
    got = rows.distinct().groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toPandas()
    keys, counts = got["shingle"].to_numpy(dtype=np.int64).view(np.uint64), got["n"].to_numpy(dtype=np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


HITS = "array<struct<item:int,similarity:double,first_word:int,words:int>>"


def _matcher(spark, ids, texts, n, similarity, radius, blocks, counts):
    """``counts`` is a broadcast of ``shared_shingles``."""
    import uuid

    key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast((ids, texts))

    @F.pandas_udf(HITS)
    def match(column: pd.Series) -> pd.Series:
        held = remembered()
        if held.get("items", ("",))[0] != key:
            held["items"] = (key, Index(*shared.value, n, similarity, radius, blocks, counts.value))
        index, out = held["items"][1], []
        for at in range(0, len(column), 64):
            for found in index.hits(text_words(column.iloc[at : at + 64].tolist())):
                out.append([dict(zip(("item", "similarity", "first_word", "words"), h)) for h in found])
        return pd.Series(out)

    return match


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", n: int = N, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, words): the best window of each item found in each document."""
    spark, out = docs.sparkSession, None
    kind = items.schema[item_id].dataType.simpleString()
    counts = spark.sparkContext.broadcast(shared_shingles(items, item_text, n))
    for ids, texts in _slices(items, item_id, item_text, SLICE):
        index = Index(ids, texts, n, similarity, radius, blocks, counts.value)
        match = _matcher(spark, ids, texts, n, similarity, radius, blocks, counts)
        named = F.array(*[F.lit(i).cast(kind) for i in index.ids]) if len(index.ids) <= 64 else None
        hits = docs.select(F.col(id_col).alias("doc_id"), F.explode(match(F.col(text_col))).alias("h"))
        hits = hits.select("doc_id", F.col("h.item").alias("at"), "h.similarity", "h.first_word", "h.words")
        if named is not None:
            part = hits.withColumn("item_id", named[F.col("at")])
        else:
            names = spark.createDataFrame(list(enumerate(index.ids)), f"at int, item_id {kind}")
            part = hits.join(names, "at")
        part = part.select("doc_id", "item_id", "similarity", "first_word", "words")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame(
        [], f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {kind}, similarity double, first_word int, words int")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
          n: int = N, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    out, counts = docs, docs.sparkSession.sparkContext.broadcast(shared_shingles(items, item_text, n))
    for ids, texts in _slices(items, item_id, item_text, SLICE):
        (name,) = fresh(out, "item_hits")
        match = _matcher(docs.sparkSession, ids, texts, n, similarity, radius, blocks, counts)
        out = out.withColumn(name, F.size(match(F.col(text_col)))).where(F.col(name) == 0).drop(name)
    return out.select(*docs.columns)
