"""Where subject, predicate and object of a fact show up in its quote.

Exact pass: each role is searched verbatim, whatever its case, behind the one
before. Only roles that this misses go on to the fuzzy pass, which is relational:
tokens of the quote carry positions, and those that a role wants are its hits. A
window opens at a hit and counts each wanted token as often as both sides have
it, so the hit at ``i`` counts for an opening ``a`` exactly if ``L < a <= i``,
where ``L`` is the larger of the reach of a window and of the place of the same
token as many occurrences back as the role wants. The hits of every opening are
then one running sum over +1 at ``L + 1`` and -1 at ``i + 1``: no window is ever
counted anew. Only openings that reach the most hits look for their last one.

Windows and sums run within one quote. Tables of no facts give no bands; null or
blank roles and null quotes have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions import text as T
from factloom.session import checkpoint

# What counts as a token of a band, and the share of a role's tokens a fuzzy band must hold.
BAND_TOKEN = r"\d+(?:[.,]\d+)?|%|\p{L}+"
BAND_MIN_OVERLAP = 0.55
ROLES = ("subject", "predicate", "object")
BAND = "struct<start:int,end:int,role:string,fuzzy:boolean>"


def exact_pass(facts: DataFrame, key: list[str], quote: str = "quote") -> DataFrame:
    """(key, low, found, missed): bands of roles found verbatim, and (role, needle) of those that were not."""
    found, missed, rows = [], [], facts.select(*key, *ROLES, F.lower(F.coalesce(F.col(quote), F.lit(""))).alias("low"), F.lit(1).alias("at"))
    for role in ROLES:
        needle, place = f"needle_{role}", f"place_{role}"
        rows = rows.withColumn(needle, F.lower(T.strip(F.coalesce(F.col(role), F.lit("")))))
        rows = rows.withColumn(place, F.when(F.col(needle) != "", F.position(needle, "low", "at")).otherwise(0))
        end = F.col(place) - 1 + F.length(needle)
        rows = rows.withColumn("at", F.when(F.col(place) > 0, end + 1).otherwise(F.col("at")))
        found.append(F.when(F.col(place) > 0, F.struct((F.col(place) - 1).cast("int").alias("start"), end.cast("int").alias("end"),
                                                       F.lit(role).alias("role"), F.lit(False).alias("fuzzy"))))
        missed.append(F.when((F.col(place) <= 0) & (F.col(needle) != ""), F.struct(F.lit(role).alias("role"), F.col(needle).alias("needle"))))
    return rows.select(*key, "low", F.array_compact(F.array(*found)).alias("found"), F.array_compact(F.array(*missed)).alias("missed"))


def tokens(quotes: DataFrame, key: list[str]) -> DataFrame:
    """(key, idx, token, start, end) of every token of ``low``. Marks are put around tokens, and what lies between marks is measured."""
    plain = F.translate("low", "\x01\x02", "  ")
    pieces = F.split(F.regexp_replace(plain, f"({BAND_TOKEN})", "\x01$1\x02"), "\x01")
    rows = quotes.select(*key, F.posexplode(pieces).alias("idx", "piece"))
    width = F.length("piece") - F.when(F.col("idx") > 0, 1).otherwise(0)
    before = W.partitionBy(*key).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(width).over(before), F.lit(0)).cast("int"))
    token = F.split_part("piece", F.lit("\x02"), F.lit(1))
    return rows.where("idx > 0").select(*key, "idx", token.alias("token"), "start", (F.col("start") + F.length(token)).alias("end"))


def fuzzy_bands(missed: DataFrame, key: list[str]) -> DataFrame:
    """(key, role, start, end) from (key, low, role, needle): the window of tokens that holds the largest part of the role.

    Of equal parts the shortest window wins, then the first. A window has at most two tokens more than the role.
    """
    of = [*key, "role"]
    wanted = F.regexp_extract_all("needle", F.lit(f"({BAND_TOKEN})"), F.lit(1))
    roles = missed.select(*of, "low", wanted.alias("wanted"), F.size(wanted).alias("n")).where("n > 0")
    need = roles.select(*of, "n", F.explode("wanted").alias("token")).groupBy(*of, "n", "token").agg(F.count(F.lit(1)).alias("need"))
    spans = tokens(roles.dropDuplicates(key).select(*key, "low"), key)
    hits = spans.join(need, [*key, "token"])
    order = F.row_number().over(W.partitionBy(*of, "token").orderBy("idx"))
    hits = checkpoint(hits.withColumn("nth", order))
    back = hits.select(*of, "token", (F.col("nth") + F.col("need")).alias("nth"), F.col("idx").alias("barrier"))
    after = F.greatest(F.coalesce("barrier", F.lit(-1)), F.col("idx") - F.col("n") - 2)
    hits = checkpoint(hits.join(back, [*of, "token", "nth"], "left").withColumn("after", after))
    one = F.lit(1).cast("long")
    events = hits.select(*of, F.explode(F.array(
        F.struct((F.col("after") + 1).alias("idx"), one.alias("d"), F.lit(False).alias("opens")),
        F.struct((F.col("idx") + 1).alias("idx"), (-one).alias("d"), F.lit(False).alias("opens")),
        F.struct(F.col("idx").alias("idx"), F.lit(0).cast("long").alias("d"), F.lit(True).alias("opens")))).alias("e")).select(*of, "e.*")
    running = F.sum("d").over(W.partitionBy(*of).orderBy("idx").rangeBetween(W.unboundedPreceding, 0))
    openings = events.withColumn("held", running).where("opens").select(*of, F.col("idx").alias("a"), "held")
    most = openings.groupBy(*of).agg(F.max("held").alias("held"))
    best = openings.join(most, [*of, "held"])
    last = best.join(hits, of).where((F.col("after") < F.col("a")) & (F.col("a") <= F.col("idx")) & (F.col("held") >= BAND_MIN_OVERLAP * F.col("n")))
    window = last.groupBy(*of, "a").agg(F.max(F.struct("idx", "end")).alias("b"))
    chosen = window.groupBy(*of).agg(F.min(F.struct((F.col("b.idx") - F.col("a")).alias("more"), "a", F.col("b.end").alias("end"))).alias("w"))
    opened = hits.select(*of, F.col("idx").alias("a"), "start")
    return chosen.select(*of, "w.a", "w.end").join(opened, [*of, "a"]).select(*of, "start", "end")


def spo_bands(facts: DataFrame, key: list[str], quote: str = "quote") -> DataFrame:
    """(key, role, start, end, fuzzy): non-overlapping bands; one gives way to those that begin earlier.

    ``key`` tells the facts apart; of rows with equal keys one is taken.
    """
    rows = checkpoint(exact_pass(facts.dropDuplicates(key), key, quote))
    missed = rows.where(F.size("missed") > 0).select(*key, "low", F.explode("missed").alias("m")).select(*key, "low", "m.*")
    close = fuzzy_bands(missed, key).select(*key, F.struct("start", "end", "role", F.lit(True).alias("fuzzy")).alias("b"))
    every = rows.select(*key, F.explode("found").alias("b")).unionByName(close)
    bands = every.groupBy(*key).agg(F.array_sort(F.collect_list("b")).alias("bands"))
    free = F.aggregate("bands", F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{BAND}>").alias("out")), lambda s, b: F.when(
        b["end"] > F.greatest(b["start"], s["at"]), F.struct(b["end"].alias("at"), F.concat(s["out"], F.array(F.struct(
            F.greatest(b["start"], s["at"]).alias("start"), b["end"].alias("end"), b["role"].alias("role"), b["fuzzy"].alias("fuzzy")))).alias("out"))).otherwise(s),
        lambda s: s["out"])
    return bands.select(*key, F.explode(free).alias("b")).select(*key, "b.role", "b.start", "b.end", "b.fuzzy")
