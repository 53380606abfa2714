"""Spelling variants: words that one inserted, deleted or replaced character parts, by pivotal bigrams.

A word's bigrams are put in order of their document frequency over all distinct
words, rarest first. Its *prefix* are the bigrams up to the third (and whatever
equals the third): one edit destroys at most two, so two near words share a
bigram of their prefixes. Its *pivots* are two bigrams of the prefix that do not
overlap, the rarest such pair, chosen by dynamic programming. One edit cannot
destroy both, so for near words a pivot of the one whose prefix ends earlier in
the order is in the prefix of the other. Exactly one edit also fixes its place.
Either the edit lies behind the bigram: then it keeps its position, and all that
is before it is the same in both words. Or the edit lies before it: then it keeps
its distance from the end, and all behind it is the same. Pivots are therefore
joined with prefixes on the bigram, the unchanged side and the other word's
length; where that side is short, the first or the last half of the other side,
one of which is unchanged too, joins the key. What meets is verified.

Words are counted where the texts lie, before they are shuffled. Keys that more
than ``CHUNK`` prefix entries hold are known from counts; these entries are dealt
into chunks and each pivot visits all of them, so no task holds a whole key. The
list of such keys goes out by broadcast up to ``MOST_HOT`` of them.

Defined cases: null and empty texts have no words; a null id counts as an empty
one in the digest that picks a character to drop; repeated rows count again;
ties of the most frequent neighbour go to the smaller word in code-point order;
very long runs of letters are words like others; other columns are not read, so
their names cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut

LEAST_LENGTH, LEAST_COUNT, FACTOR, DROP_EVERY = 7, 2, 10, 31
PREFIX = 3
CHUNK = 2048
MOST_HOT = 250_000
#: Characters, bigram included, that make the unchanged side of a word a key by itself.
ENOUGH = 5
#: Letters in Latin-1, where bytes and code points are the same; bytes.lower() only touches A-Z.
_RUN = re.compile(rb"[a-z\xC0-\xFF]+")
_HELD = 200_000


def runs(text: str) -> list[bytes]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, in Latin-1."""
    return _RUN.findall(text.encode("latin-1", "replace").lower())


def misspelt(doc_id: str, run: bytes, every: int = DROP_EVERY) -> bytes:
    """The run, short of one character where its digest with the document's id says so."""
    utf8 = run if run.isascii() else run.decode("latin-1").encode("utf-8")
    h = zlib.crc32(utf8, zlib.crc32(f"{doc_id}:".encode()))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = DROP_EVERY,
               least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts and how often they occur."""

    def counted(batches):
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b["id"].to_pylist(), b["text"].to_pylist()):
                for run, n in Counter(runs(text or "")).items():
                    if len(run) >= least_length:
                        word = misspelt(doc_id, run, every)
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) > _HELD:
                    yield frame(held)
                    held = Counter()
        yield frame(held)

    def frame(held):
        return pa.record_batch({"word": pa.array([w.decode("latin-1") for w in held], pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    words = source.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.where(F.col("n") >= least_count)


def bigrams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def prefix_of(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """(rank, position) of the rarest bigrams up to the third, and of those equal to the third."""
    ranked = sorted((order[g], i) for i, g in enumerate(bigrams(word)))
    if len(ranked) <= PREFIX:
        return ranked
    last = ranked[PREFIX - 1][0]
    return [x for x in ranked if x[0] <= last]


def pivots_of(prefix: list[tuple[int, int]], weight: list[int]) -> list[tuple[int, int]]:
    """The two bigrams of the prefix that do not overlap and weigh least together.

    Dynamic programming over positions: the lightest single bigram that ends
    before a position, and with it the lightest pair up to there.
    """
    by_place = sorted(prefix, key=lambda x: x[1])
    best_one, best_two = None, None
    ready = 0  # bigrams before this one end before the current position
    for rank, at in by_place:
        while ready < len(by_place) and by_place[ready][1] <= at - 2:
            one = by_place[ready]
            if best_one is None or (weight[one[0]], one) < (weight[best_one[0]], best_one):
                best_one = one
            ready += 1
        if best_one is not None:
            pair = (weight[best_one[0]] + weight[rank], best_one, (rank, at))
            if best_two is None or pair < best_two:
                best_two = pair
    return [] if best_two is None else [best_two[1], best_two[2]]


def _placed(words: DataFrame, grams: list[tuple[str, int]]) -> DataFrame:
    """(word, n, prefix, pivots): each word with the positions of its prefix and of its pivots."""
    order, weight = {g: i for i, (g, _) in enumerate(grams)}, [c for _, c in grams]

    def rows(batches):
        for b in batches:
            held = b["word"].to_pylist()
            prefixes = [prefix_of(w, order) for w in held]
            places = pa.list_(pa.int32())
            yield pa.record_batch({"word": b["word"], "n": b["n"], "prefix": pa.array([[at for _, at in p] for p in prefixes], places),
                                   "pivots": pa.array([[at for _, at in pivots_of(p, weight)] for p in prefixes], places)})

    return words.mapInArrow(rows, "word string, n long, prefix array<int>, pivots array<int>")


def _keys(lengths: list[tuple[str, str]]) -> str:
    """SQL for the keys of ``word`` at the bigram ``at``, for (length of the word that is asked, length of the shorter one).

    A side of ``ENOUGH`` characters is a key by itself. A shorter one is joined by
    the first or the last half of the other side, one of which has no edit.
    """
    def left(asked: str, least: str) -> tuple[str, str]:
        rest = f"({least} - at - 2)"
        return (f"xxhash64(1, {asked}, {least}, left(word, at + 2 + {rest} div 2))",
                f"xxhash64(2, {asked}, {least}, left(word, at + 2), right(word, {rest} - {rest} div 2))")

    def right(asked: str, least: str) -> tuple[str, str]:
        rest = f"({least} - length(word) + at)"
        return (f"xxhash64(3, {asked}, {least}, left(word, {rest} div 2), substring(word, at + 1))",
                f"xxhash64(4, {asked}, {least}, right(word, {rest} - {rest} div 2 + length(word) - at))")

    alone = list(dict.fromkeys(asked for asked, _ in lengths))
    sides = []
    for enough, whole, halves in ((f"at + 2 >= {ENOUGH}", "xxhash64(5, {0}, left(word, at + 2))", left),
                                  (f"length(word) - at >= {ENOUGH}", "xxhash64(6, {0}, substring(word, at + 1))", right)):
        split = [k for x in lengths for k in halves(*x)]
        sides.append(f"if({enough}, array({', '.join(whole.format(x) for x in alone)}), array({', '.join(split)}))")
    return f"explode(concat({', '.join(sides)})) AS key"


def near_pairs(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, n_a, b, n_b), a < b: the words at an edit distance of exactly one; words have five letters at least."""
    pair = F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))"))
    counts = words.where("length(word) > 1").select("word", pair.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # at most the square of 90 letters
    grams = [(r.gram, r.n) for r in sorted(counts.collect(), key=lambda r: (r.n, r.gram))]
    placed = cut(_placed(words, grams))
    n = "length(word)"
    asked = placed.selectExpr("word", "n", "explode(prefix) AS at").selectExpr("word", "n", _keys([(n, n), (n, f"{n} - 1")]))
    asking = placed.selectExpr("word", "n", "explode(pivots) AS at").selectExpr("word", "n", _keys([(n, n), (f"{n} + 1", n), (f"{n} - 1", f"{n} - 1")]))
    hot = cut(asked.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > chunk).select(
        "key", F.ceil(F.col("held") / chunk).cast("int").alias("chunks")))
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= MOST_HOT else hot
        own = F.pmod(F.xxhash64("word"), "chunks").cast("int")
        dealt = lambda c: F.when(F.col("chunks").isNull(), F.col("key")).otherwise(F.xxhash64("key", c)).alias("key")
        asked = asked.join(hot, "key", "left").select("word", "n", dealt(own))
        asking = asking.join(hot, "key", "left").select("*", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("c")).select(
            "word", "n", dealt(F.col("c")))
    asked = asked.select("key", F.col("word").alias("y"), F.col("n").alias("n_y"))
    found = asking.select("key", F.col("word").alias("x"), F.col("n").alias("n_x")).join(asked, "key").where(
        (F.col("x") != F.col("y")) & (F.levenshtein("x", "y", 1) == 1))
    up = F.col("x") < F.col("y")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return found.select(pick("x", "y").alias("a"), pick("n_x", "n_y").alias("n_a"), pick("y", "x").alias("b"), pick("n_y", "n_x").alias("n_b")).distinct()


def variants(words: DataFrame, factor: int = FACTOR, chunk: int = CHUNK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n), whose words are distinct.

    A word's form is its most frequent near word, if that is ``factor`` times as
    frequent; its root is where its forms lead. Counts grow by the factor with
    each step, so paths are short and have no circle.
    """
    words = cut(words)
    if words.where("length(word) < 5").limit(1).count():
        raise ValueError("words need five letters: shorter ones may lack two bigrams that do not overlap")
    pairs = cut(near_pairs(words, chunk))
    both = pairs.select(F.col("a").alias("word"), F.col("n_b").alias("m"), F.col("b").alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("n_a").alias("m"), F.col("a").alias("near")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("x"))
    got = words.join(best, "word", "left")
    fits = -F.col("x.less") >= factor * F.col("n")
    got = cut(got.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("x.near")).alias("form"),
                         F.when(fits, -F.col("x.less")).alias("form_n")))
    # every round doubles the steps that are known
    step = cut(got.where("form is not null").select("word", F.col("form").alias("to")))
    while True:
        further = step.select(F.col("word").alias("to"), F.col("to").alias("next"))
        longer = cut(step.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        step = longer.select("word", "to")
        if longer.where("moved").isEmpty():
            break
    return got.join(step, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
