"""Toxicity of whole texts by noisy-channel restoration.

A character model (interpolated 1- to 4-grams) is counted over the words of all
documents: words are counted first, then every n-gram and context by a 64-bit
key of its own, so the table grows with the corpus. It is summed by Spark,
written in key order to two files of the shared folder, a piece at a time, and
memory-mapped by the tasks. Tokens that look disguised (letters mixed with
digits or symbols, repetitions of three, doubled letters that the model finds
unlikely, letters spaced out) span a lattice of readings, and a Viterbi search
over the last three characters finds the likeliest one; it leaves out only what
cannot beat a reading already found. Restored words and their prefixes, each known by 64 bits of its
own, then carry log-odds learned from labelled documents; a logistic curve over the strongest of them gives the
score.

Labels are learned from rows whose crc32 remainder is not held out, at most
``FIT_ROWS`` of them in hash order, so that ids and labels fit a broadcast of
known size and no text is shuffled. They give the log-odds, as sums; the first
``CURVE_ROWS`` of them give the curve, each scored without its own share of the
counts. A score sees the text alone.

Defined cases: null and empty texts score like a text without marks; repeated
rows are scored each; a null id is never learned from and never held out;
without labels of both kinds every score is the share of toxic labels (0 if
none); other columns pass through; an empty table stays empty. Very long texts
are read whole, as a set of tokens; a very long token costs time in proportion.
Of readings of equal cost the one of the least last part stays. Digits alone and
words broken into longer pieces are scored as they stand.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, fresh, remembered
from factloom.session import ensure_checkpoint_dir

THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: N-grams that a task counts before it hands them on.
GRAMS_HELD = 1 << 21
#: Marks that a task counts before it hands them on.
MARKS_HELD = 1 << 19
#: Labelled rows to learn log-odds from, and of these to fit the curve on, at most.
FIT_ROWS, CURVE_ROWS = 60_000, 20_000
#: A mark needs as many toxic documents.
LEAST_TOXIC = 3
#: States of the first, quick search; its reading bounds the second one, which is complete.
BEAM = 200
#: A doubled letter of this cost (-log p) or more is taken for a disguise.
RARE_DOUBLE = 3.5
STATS = ("m1", "m2", "m3", "strong", "size")
ORDER = 4
BEGIN, STOP = "\x02", "\x03"

# What a disguised character may stand for, and the cost of each way to disguise.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "abcdefghijklmnopqrstuvwxyz"}
COST_LEET, COST_SAME, COST_DROPPED, COST_REPEAT, COST_KEPT_RUN, COST_GAP = 1.0, 3.0, 3.0, 0.5, 4.0, 2.0

_TOKEN = re.compile(r"[\w@$!|*+]+")
_EDGE = re.compile(r"^[!|*+]+|^([@$])\1+|[!|*+]+$|(?<![^\W\d_])([@$])\2+$")
_ODD = re.compile(r"[^\W\d_].*[\d@$!|*+]|[\d@$!|*+].*[^\W\d_]|([^\W\d_])\1\1")
_TWICE = re.compile(r"(.)\1")
_MASK = (1 << 64) - 1
_MUL = 0x9E3779B97F4A7C15
_SALT = 0x632BE59BD9B4E019


def _fold(h, c):
    return ((h ^ c) * _MUL) & _MASK


def _key(h: int, context: bool) -> int:
    h = ((h ^ (_SALT if context else 0)) * _MUL) & _MASK
    return h - (1 << 64) if h >> 63 else h


def _gram(text: str) -> int:
    h = len(text)
    for c in text:
        h = _fold(h, ord(c))
    return h


def char_counts(words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the n-grams of ``words`` and of the contexts that a character follows, in key order."""
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    text = BEGIN + (STOP + BEGIN).join(words) + STOP
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    begins = np.flatnonzero(chars == ord(BEGIN))
    lengths = np.diff(np.append(begins, len(chars)))
    place = np.arange(len(chars)) - np.repeat(begins, lengths)
    weight = np.repeat(counts.astype(np.float64), lengths)
    mul, salt, last = np.uint64(_MUL), np.uint64(_SALT), chars == ord(STOP)
    keys, held = [], []
    for k in range(1, ORDER + 1):
        ends = np.flatnonzero(place >= k - 1)
        h = np.full(len(ends), k, dtype=np.uint64)
        for i in range(k):
            h = (h ^ chars[ends - k + 1 + i]) * mul
        for context in (False, True):
            if context and k == ORDER:
                continue
            keep = ~last[ends] if context else (place[ends] > 0)
            keys.append(((h[keep] ^ (salt if context else np.uint64(0))) * mul).view(np.int64))
            held.append(weight[ends[keep]])
    return summed(keys, held)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    return known, np.bincount(at, weights=np.concatenate(counts), minlength=len(known))


class Grams:
    """Exact counts of n-grams and contexts: keys in order, looked up by binary search."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: float):
        self.keys, self.counts = keys, counts
        self.total = max(total / (2 * ORDER), 1.0)

    def of(self, gram: str, context: bool = False) -> float:
        key = np.int64(_key(_gram(gram), context))
        at = int(self.keys.searchsorted(key))
        return float(self.counts[at]) if at < len(self.keys) and self.keys[at] == key else 0.0


class GramFiles:
    """What ``char_model`` wrote; ``load`` maps it in a task."""

    def __init__(self, name: str, total: float):
        self.name, self.total = name, total

    def load(self) -> Grams:
        from pyspark import SparkFiles

        def mapped(part: str, kind) -> np.ndarray:
            path = SparkFiles.get(f"{self.name}-{part}")
            return np.asarray(np.memmap(path, dtype=kind, mode="r")) if os.path.getsize(path) else np.zeros(0, dtype=kind)

        return Grams(mapped("keys", "<i8"), mapped("counts", "<f8"), self.total)


class Restorer:
    """Viterbi search for the likeliest reading of a disguised token."""

    def __init__(self, grams: Grams):
        self.grams, self.known, self.costs = grams, {}, {}

    def cost(self, context: str, c: str) -> float:
        """-log p(c | context), each order resting on the one below."""
        got = self.costs.get((context, c))
        if got is None:
            p = 1.0 / 200
            for k in range(0, len(context) + 1):
                before = context[len(context) - k :]
                of = self.grams.of(before, True) if before else self.grams.total
                seen = self.grams.of(before + c) if of else 0.0
                p = (min(seen, of) + 4 * p) / (of + 4)
            got = self.costs[context, c] = -float(np.log(p))
            if len(self.costs) > 500_000:
                self.costs.clear()
        return got

    @staticmethod
    def lattice(token: str, gaps: bool = False) -> list[list[tuple[str, float]]]:
        out = []
        for m in re.finditer(r"(.)\1*", token, re.S):
            run, c = m[0], m[1]
            if c == " ":
                out.append([("", 0.0), (" ", COST_GAP)] if gaps else [(" ", 0.0)])
            elif c in LEET:
                each = [(x, COST_LEET) for x in LEET[c]]
                if c.isdigit():
                    each.append((c, COST_SAME))
                else:
                    each.append(("", COST_DROPPED))
                if len(run) > 2:
                    out.append(each + [(run, COST_SAME)])
                else:
                    out += [each] * len(run)
            elif len(run) > 2 and c.isalpha():
                out.append([(c, COST_REPEAT), (2 * c, COST_REPEAT), (run, COST_KEPT_RUN)])
            elif len(run) == 2 and c.isalpha():
                out.append([(run, 0.0), (c, COST_REPEAT)])
            else:
                out.append([(run, 0.0)])
        return out

    def _search(self, lattice: list[list[tuple[str, float]]], limit: float, beam: int | None) -> tuple[float, str, bool]:
        """(cost, reading, whether states were dropped for the beam); states that cannot stay within ``limit`` go."""
        rest = [0.0]
        for options in reversed(lattice):
            rest.append(rest[-1] + min(extra for _, extra in options))
        rest.reverse()
        states, cut_off = {BEGIN: (0.0, None)}, False
        for column, options in enumerate([*lattice, [(STOP, 0.0)]]):
            left = limit - (rest[column + 1] if column < len(lattice) else 0.0)
            after: dict[str, tuple[float, tuple | None]] = {}
            for state, (base, path) in states.items():
                for text, extra in options:
                    cost, now = base + extra, state
                    for c in text:
                        if c == " ":
                            cost, now = cost + self.cost(now, STOP), BEGIN
                        else:
                            cost, now = cost + self.cost(now, c), (now + c)[-(ORDER - 1) :]
                    if cost > left:
                        continue
                    held = after.get(now)
                    if held is None or (cost, text) < (held[0], held[1][0]):
                        after[now] = (cost, (text, path))
            if beam and len(after) > beam:
                after, cut_off = dict(sorted(after.items(), key=lambda x: (x[1][0], x[0]))[:beam]), True
            states = after
        cost, path = min(states.values(), key=lambda x: x[0])
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return cost, "".join(reversed(out)).strip(BEGIN + STOP), cut_off

    def best(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest reading. Where the quick search dropped states, a complete one follows: no cost is negative, so
        a state dearer than the reading already found, less what later columns cost at least, leads to no better one."""
        cost, reading, cut_off = self._search(lattice, float("inf"), BEAM)
        return self._search(lattice, cost + 1e-9, None)[1] if cut_off else reading

    def doubled(self, token: str) -> bool:
        """Whether a letter comes twice where the model hardly expects it."""
        return any(m[1].isalpha() and self.cost((BEGIN + token[: m.start() + 1])[-(ORDER - 1) :], m[1]) >= RARE_DOUBLE for m in _TWICE.finditer(token))

    def word(self, token: str) -> str:
        """The token itself, or its likeliest reading if it looks disguised."""
        core = _EDGE.sub("", token)
        if not _ODD.search(core) and not self.doubled(core):
            return core
        got = self.known.get(core)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[core] = self.best(self.lattice(core))
        return got

    def spaced(self, letters: list[str]) -> str:
        """The likeliest word or words behind letters that stand apart."""
        return self.best(self.lattice(" ".join(letters), gaps=True))

    def split(self, text: str) -> tuple[set[str], list[tuple[str, str]]]:
        """Distinct tokens of a text, and (observed, restored) of its runs of letters that stand apart."""
        text = text.lower()
        if "_" in text:
            text = text.replace("_", " ")
        tokens, runs = _TOKEN.findall(text), []
        single = [i for i, t in enumerate(tokens) if len(t) == 1]
        at = 0
        while at < len(single):
            end = at
            while end + 1 < len(single) and single[end + 1] == single[end] + 1:
                end += 1
            if end - at >= 2:
                run = tokens[single[at] : single[end] + 1]
                runs.append((" ".join(run), self.spaced(run)))
            at = end + 1
        return set(tokens), runs

    def words(self, text: str) -> tuple[set[str], list[tuple[str, str]]]:
        """Distinct restored words of a text, and (observed, restored) of those that were changed."""
        tokens, changed = self.split(text)
        out = {w for _, got in changed for w in got.split()}
        for t in tokens:
            got = self.word(t)
            if got != _EDGE.sub("", t):
                changed.append((t, got))
            out.update(got.split())
        return out, sorted(changed)


class Lexicon:
    """What each token is worth after restoration; ``value`` rates a tuple of words, and every token is rated once."""

    def __init__(self, restorer: Restorer, value, most: int = 400_000):
        self.restorer, self.value, self.most = restorer, value, most
        self.known: dict[str, object] = {}
        self.changed: dict[str, str] = {}

    def read(self, text: str) -> tuple[list, list[tuple[str, str]]]:
        """Values of the distinct tokens and of the spaced-out runs, and (observed, restored) of what was changed."""
        tokens, runs = self.restorer.split(text)
        known = self.known
        if len(known) > self.most:
            known.clear()
            self.changed.clear()
        for t in tokens:
            if t not in known:
                if t.isalpha() and not _TWICE.search(t):  # nothing to restore
                    known[t] = self.value((t,))
                    continue
                got = self.restorer.word(t)
                known[t] = self.value(got.split())
                if got != _EDGE.sub("", t):
                    self.changed[t] = got
        out = [known[t] for t in tokens] + [self.value(got.split()) for _, got in runs]
        return out, sorted([(t, self.changed[t]) for t in tokens & self.changed.keys()] + runs)


def marks_of(word: str) -> list[int]:
    """64-bit hashes of a word and of its first three, four and five characters."""
    import xxhash

    h = xxhash.xxh64_intdigest
    return [h(word), *(h(f"{k}\x00{word[:k]}") for k in (3, 4, 5) if len(word) > k)]


def char_model(docs: DataFrame, text_col: str = "text") -> GramFiles:
    """Character n-gram counts over every word of every document, as files that Spark hands to the executors.

    The counts are summed and put in order by Spark; the driver appends one piece after the other and holds none of them.
    """
    import uuid

    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{M}\p{Nd}]+")).alias("w"))
    counted = words.where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))

    def grams(batches):
        keys, counts = [], []
        for b in batches:
            k, n = char_counts(b["w"].tolist(), b["n"].to_numpy())
            keys.append(k)
            counts.append(n)
            if sum(map(len, keys)) > GRAMS_HELD:
                k, n = summed(keys, counts)
                keys, counts = [k], [n]
                if len(k) > GRAMS_HELD // 2:
                    yield pd.DataFrame({"key": k, "n": n})
                    keys, counts = [], []
        if keys:
            k, n = summed(keys, counts)
            yield pd.DataFrame({"key": k, "n": n})

    def pieces(batches):
        for b in batches:
            keys, counts = b["key"].to_numpy(dtype="<i8"), b["n"].to_numpy(dtype="<f8")
            yield pd.DataFrame({"keys": [keys.tobytes()], "counts": [counts.tobytes()], "total": [float(counts.sum())]})

    known = cut(counted.mapInPandas(grams, "key long, n double").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key"))
    spark, name, total = docs.sparkSession, f"char-grams-{uuid.uuid4().hex}", 0.0
    ensure_checkpoint_dir(spark)
    places = [f"{spark.sparkContext.getCheckpointDir()}/{name}-{part}" for part in ("keys", "counts")]
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in places]
    outs = [p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True) for p in paths]
    for row in known.mapInPandas(pieces, "keys binary, counts binary, total double").toLocalIterator():
        outs[0].write(bytearray(row["keys"]))
        outs[1].write(bytearray(row["counts"]))
        total += row["total"]
    for out, place in zip(outs, places):
        out.close()
        spark.sparkContext.addFile(place)
    return GramFiles(name, total)


def fold(id_col: str, of: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of))


def share_of(id_col: str, most: int, n: int) -> Column:
    """Rows of least hash, so that about ``most`` of ``n`` stay; by 3 per cent fewer, which chance does not make up for."""
    return F.lit(True) if n <= most else F.pmod(F.xxhash64(F.lit(6), id_col), F.lit(1 << 20)) < int(0.97 * most / n * (1 << 20))


def labelled(labels: DataFrame, id_col: str, label_col: str, folds: int, held_out: int, most: int) -> tuple[DataFrame, int]:
    """(id, y) of at most about ``most`` labelled rows that are not held out, and how many there are in all.

    Ids and labels only, of a bounded number of rows: a broadcast of them cannot grow.
    """
    known = cut(labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col, folds) != held_out)).groupBy(
        F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")))
    n = known.count()
    return cut(known.where(share_of("id", most, n))), n


class Model:
    """What was learned: character counts, log-odds of marks, curve."""

    def __init__(self, key: str, table: GramFiles, odds: dict[int, float], curve: list[float], share: float):
        self.key, self.table, self.odds, self.curve, self.share = key, table, odds, curve, share


def _stats(texts, lexicon: Lexicon) -> tuple[np.ndarray, list]:
    out, changed_all = np.zeros((len(texts), len(STATS))), []
    for row, text in enumerate(texts):
        values, changed = lexicon.read(text or "")
        found = sorted([x for x in values if x > 0], reverse=True)
        top = (found + [0.0, 0.0, 0.0])[:3]
        out[row] = [*top, np.log1p(sum(x > 3 for x in found)), np.log1p(len(values))]
        changed_all.append([{"observed": a, "restored": b} for a, b in changed])
    return out, changed_all


def _stat_udf(spark, key: str, table: GramFiles, odds: dict[int, float]):
    shared = spark.sparkContext.broadcast(odds)

    @F.pandas_udf("stats array<double>, restored array<struct<observed:string,restored:string>>")
    def stats(texts: pd.Series) -> pd.DataFrame:
        held = remembered()
        if held.get("lexicon", ("", None))[0] != key:
            marked = shared.value
            held["lexicon"] = (key, Lexicon(Restorer(table.load()), lambda words: max((marked.get(m, 0.0) for w in words for m in marks_of(w)), default=0.0)))
        x, changed = _stats(texts.tolist(), held["lexicon"][1])
        return pd.DataFrame({"stats": list(x), "restored": changed})

    return stats


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """Learn from the rows of ``labels`` whose remainder is not ``held_out``."""
    import uuid

    spark, key = docs.sparkSession, uuid.uuid4().hex
    table = char_model(docs, text_col)
    known, n = labelled(labels, id_col, label_col, folds, held_out, FIT_ROWS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    def count(batches):
        seen, sizes = ({}, {}), [0, 0]

        def rows():
            marks = list(seen[0].keys() | seen[1].keys())
            out = pd.DataFrame({"known": True, "mark": np.array(marks, dtype=np.uint64).view(np.int64),
                                "clean": [seen[0].get(m, 0) for m in marks], "toxic": [seen[1].get(m, 0) for m in marks]})
            for held in seen:
                held.clear()
            return out

        lexicon = Lexicon(Restorer(table.load()), lambda words: tuple({m for w in words for m in marks_of(w)}))
        for b in batches:
            for text, y in zip(b["text"].tolist(), b["y"].tolist()):
                sizes[y] += 1
                own = seen[y]
                for m in set().union(*lexicon.read(text or "")[0]):
                    own[m] = own.get(m, 0) + 1
                if len(own) > MARKS_HELD:
                    yield rows()
        yield rows()
        yield pd.DataFrame({"known": [False], "mark": [0], "clean": [sizes[0]], "toxic": [sizes[1]]})

    summed = texts.join(F.broadcast(known), "id").select("text", "y").mapInPandas(count, "known boolean, mark long, clean long, toxic long").groupBy(
        "known", "mark").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(
        (F.col("toxic") >= LEAST_TOXIC) | ~F.col("known")).toPandas()
    known_marks = summed["known"].to_numpy(dtype=bool)
    sizes = summed[~known_marks]
    n_clean, n_toxic = int(sizes["clean"].sum()), int(sizes["toxic"].sum())
    share = n_toxic / max(n_clean + n_toxic, 1)
    rows = summed[known_marks]
    marks, toxic, clean = (rows[c].to_numpy(dtype=np.int64) for c in ("mark", "toxic", "clean"))
    marks = marks.view(np.uint64)

    def odds_without(own_toxic: int, own_clean: int) -> dict[int, float]:
        t, c = toxic - own_toxic + 0.5, np.maximum(clean - own_clean, 0) + 0.5
        sure = np.log(t / (n_toxic + 1)) - np.log(c / (n_clean + 1)) - 1.6 * np.sqrt(1 / t + 1 / c)
        keep = (t > LEAST_TOXIC) & (sure > 0)
        return dict(zip(marks[keep].tolist(), sure[keep].tolist()))

    if not (n_clean and n_toxic):
        return Model(key, table, {}, [], share)
    odds = odds_without(0, 0)
    sample = known.where(share_of("id", CURVE_ROWS, n))
    parts = []
    for y, own in ((0, (0, 1)), (1, (1, 0))):
        stats = _stat_udf(spark, f"{key}-{y}", table, odds_without(*own))
        rows = texts.join(F.broadcast(sample.where(F.col("y") == y)), "id")
        parts.append(rows.select("y", stats("text").getField("stats").alias("x")).toPandas())
    got = pd.concat(parts)
    curve = logistic(np.array(got["x"].tolist()).reshape(len(got), len(STATS)), got["y"].to_numpy(dtype=float))
    return Model(key, table, odds, curve, share)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> list[float]:
    """Intercept and slopes by Newton steps with a ridge on the slopes; [] if only one kind of row is there."""
    if len(set(y.tolist())) < 2:
        return []
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), np.diag([0.0, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / scale
    return [float(w[0] - slopes @ mean), *map(float, slopes)]


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``restored`` added (underscores in front of names already there)."""
    name, restored, got = fresh(docs, "score", "restored", "tox_stats")
    stats = _stat_udf(docs.sparkSession, model.key, model.table, model.odds)
    out = docs.withColumn(got, stats(F.col(text_col)))
    if model.curve:
        x = F.col(got).getField("stats")
        at = F.lit(model.curve[0])
        for i, slope in enumerate(model.curve[1:]):
            at = at + F.lit(slope) * x[i]
        value = 1 / (1 + F.exp(-at))
    else:
        value = F.lit(float(model.share))
    return out.withColumns({name: value, restored: F.col(got).getField("restored")}).drop(got)


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold."""
    scored = score(docs, fit(docs, labels))
    return scored.where(F.col(scored.columns[len(docs.columns)]) < THRESHOLD).select(*docs.columns)
