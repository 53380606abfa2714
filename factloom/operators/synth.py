"""Synthetic annotators: facts rewritten so that every conflict label occurs.

Random choices of a generator are replaced by digits of sha1(fact id, purpose), so
a fact is always rewritten the same way, on any cluster and in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T

# Entity variants and predicate paraphrases.
ENTITY_VARIANTS = {
    "the Council": ["Council of the European Union", "the EU Council", "the Council"],
    "the Commission": ["European Commission", "EC", "the Commission"],
    "the Netherlands": ["Netherlands", "the Kingdom of the Netherlands"],
    "general government deficit": ["general government balance", "government deficit", "the deficit"],
    "cyclically adjusted deficit": ["structural deficit", "cyclically adjusted balance"],
    "savings measures": ["austerity measures", "fiscal measures"],
    "Decision 2005/136/EC": ["the 2005/136/EC Decision", "Decision (2005/136/EC)"],
}
PREDICATE_PARAPHRASES = {
    "decided": ["determined", "ruled"],
    "made": ["issued", "produced"],
    "made a Recommendation": ["issued a Recommendation"],
    "established a deadline": ["set a deadline", "fixed a deadline"],
    "is to be abrogated": ["shall be abrogated", "must be repealed"],
    "are laid down": ["are defined", "are specified"],
    "are provided": ["are supplied", "are reported"],
    "is estimated at": ["was estimated at", "stood at"],
    "was": ["stood at", "reached"],
    "is in compliance with": ["complies with", "is consistent with"],
    "was to be reduced below": ["had to fall under", "was required to drop below"],
    "was pursued in 2004": ["was carried out in 2004", "was undertaken in 2004"],
    "were partly contained in": ["were partly included in"],
    "were partly decided in": ["were partly defined in"],
    "added up to": ["totalled", "amounted to"],
    "was projected to reach": ["was forecast to hit", "was expected to reach"],
    "was projected to fall to": ["was forecast to drop to"],
    "was projected to decrease in 2005 by": ["was forecast to decline in 2005 by"],
    "was expected to reach close to balance": ["was forecast to approach balance"],
    "fell to": ["dropped to", "declined to"],
    "was compared to": ["compared with"],
    "was kept below": ["stayed under", "remained below"],
    "was projected to remain below": ["was forecast to stay under"],
    "was completed": ["was finalised", "was concluded"],
    "is hereby abrogated": ["is repealed", "shall be abrogated"],
    "is addressed to": ["is directed at"],
    "was projected to show a further decline in 2005": ["was forecast to decline further in 2005"],
    "followed": ["came after"],
}
SPLIT_MARKS = [" by ", " for ", " in ", " of ", " and "]
PERCENT_NUMBER = r"(\d+),(\d+)\s*%"
NUMBER_STEPS = [3, 5, 7]  # tenths of a percentage point

# Shares, in percent, of each rewrite per profile.
PROFILES = {
    "friendly": {"drop": 12, "split": 10, "number": 0, "entity": 35, "predicate": 40},
    "adversarial": {"drop": 16, "split": 0, "number": 50, "entity": 55, "predicate": 55},
}


def draw(purpose: str, sides: int, fact: str = "fact_id") -> Column:
    """A reproducible number in [0, sides) for one fact and one purpose."""
    digest = F.sha1(F.concat(F.col(fact), F.lit("|" + purpose)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % sides


def _choice(options: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (at % len(options)).cast("int") + 1)


def swap_entity(column: str, share: int, purpose: str) -> Column:
    """Replace the first known entity by a variant, when the draw allows it."""
    value = F.col(column)
    out = value
    for name, variants in reversed(list(ENTITY_VARIANTS.items())):
        pattern = "(?i)" + name.replace("(", r"\(").replace(")", r"\)").replace("/", "/")
        picked = _choice(variants, draw(purpose + name, 1 << 20))
        at = F.locate(name.lower(), F.lower(value))
        swapped = F.concat(F.substring(value, F.lit(1), at - 1), picked, value.substr(at + len(name), F.length(value)))
        out = F.when(value.rlike(pattern) & (picked != name), swapped).otherwise(out)
    return F.when(draw(purpose, 100) < share, out).otherwise(value)


def paraphrase_predicate(share: int) -> Column:
    out = F.col("predicate")
    for name, options in PREDICATE_PARAPHRASES.items():
        out = F.when(F.col("predicate") == name, _choice(options, draw("wording", 1 << 20))).otherwise(out)
    return F.when(draw("predicate", 100) < share, out).otherwise(F.col("predicate"))


def bump_number(c) -> Column:
    """The first ``2,3 %`` of a text raised by 0.3, 0.5 or 0.7 points."""
    value = T._col(c)
    whole, frac = (F.regexp_extract(value, PERCENT_NUMBER, i) for i in (1, 2))
    tenths = F.round((F.concat(whole, F.lit("."), frac).cast("double")) * 10).cast("long") + F.element_at(
        F.array(*[F.lit(n) for n in NUMBER_STEPS]), (draw("step", len(NUMBER_STEPS))).cast("int") + 1)
    changed = F.concat((tenths / 10).cast("long").cast("string"), F.lit(","), (tenths % 10).cast("string"), F.lit(" %"))
    found = F.regexp_extract(value, PERCENT_NUMBER, 0)
    at = F.locate("\u0000", F.replace(value, found, F.lit("\u0000")))
    return F.when(found == "", value).otherwise(
        F.concat(F.substring(value, F.lit(1), at - 1), changed, value.substr(at + F.length(found), F.length(value))))


def split_object() -> Column:
    """struct(head, mark, tail) at the first usable connective of the object, else null."""
    value = F.col("object")
    out = F.lit(None).cast("struct<head:string,mark:string,tail:string>")
    for mark in reversed(SPLIT_MARKS):
        at = F.locate(mark, value)
        head = F.substring(value, F.lit(1), at - 1)
        tail = value.substr(at + len(mark), F.length(value))
        usable = (at > 0) & F.length(head).between(4, 79) & F.length(tail).between(4, 79)
        out = F.when(usable, F.struct(T.strip(head).alias("head"), F.lit(mark.strip()).alias("mark"), T.strip(tail).alias("tail"))).otherwise(out)
    return out


def synthesize(facts: DataFrame, annotator: str, profile: str) -> DataFrame:
    """Facts of a synthetic annotator with ``synth_op`` and ``derived_from``; narrow, one pass."""
    p = PROFILES[profile]
    kept = facts.where(draw("drop", 100) >= p["drop"])
    parts = split_object() if p["split"] else F.lit(None).cast("struct<head:string,mark:string,tail:string>")
    base = (kept.withColumn("_split", F.when(draw("split", 100) < p["split"], parts))
            .withColumn("_number", (draw("number", 100) < p["number"]))
            .withColumn("_bump_o", F.col("_number") & F.col("object").rlike(PERCENT_NUMBER))
            .withColumn("_bump_s", F.col("_number") & ~F.col("_bump_o") & F.col("subject").rlike(PERCENT_NUMBER))
            .withColumn("_s", swap_entity("subject", p["entity"], "subject"))
            .withColumn("_o", swap_entity("object", p["entity"], "object"))
            .withColumn("_p", paraphrase_predicate(p["predicate"])))

    def fact(subject, predicate, obj, op, changed):
        return F.struct(subject.alias("subject"), predicate.alias("predicate"), obj.alias("object"), op.alias("synth_op"), changed.alias("changed"))

    s, pr, o = F.col("subject"), F.col("predicate"), F.col("object")
    ops = F.concat_ws("+", F.when(F.col("_s") != s, F.lit("entity_swap_subject")), F.when(F.col("_o") != o, F.lit("entity_swap_object")),
                      F.when(F.col("_p") != pr, F.lit("predicate_paraphrase")))
    yes = F.lit(True)
    qualified = F.when(F.col("_split.mark") == "and", F.concat(F.lit("also "), pr)).otherwise(F.concat(F.lit("qualified "), F.col("_split.mark")))
    out = (F.when(F.col("_split").isNotNull(), F.array(
        fact(s, pr, F.col("_split.head"), F.lit("granularity_split"), yes),
        fact(s, qualified, F.col("_split.tail"), F.lit("granularity_split"), yes)))
        .when(F.col("_bump_o"), F.array(fact(s, pr, bump_number("object"), F.lit("number_perturb_object"), yes)))
        .when(F.col("_bump_s"), F.array(fact(bump_number("subject"), pr, o, F.lit("number_perturb_subject"), yes)))
        .otherwise(F.array(fact(F.col("_s"), F.col("_p"), F.col("_o"), F.coalesce(F.nullif(ops, F.lit("")), F.lit("identity")), ops != ""))))
    untouched = [c for c in facts.columns if c not in ("subject", "predicate", "object", "synth_op", "annotator", "fact_id", "natural_language", "fact_pos")]
    rows = base.select(*untouched, "fact_id", "natural_language", "fact_pos", F.posexplode(out).alias("_i", "_f"))
    return rows.select(
        *untouched, F.lit(annotator).alias("annotator"), F.col("fact_id").alias("derived_from"),
        T.sha_id(F.lit(annotator), "fact_id", "_i").alias("fact_id"),
        F.col("_f.subject").alias("subject"), F.col("_f.predicate").alias("predicate"), F.col("_f.object").alias("object"),
        F.when(F.col("_f.changed"), T.capitalised_statement("_f.subject", "_f.predicate", "_f.object"))
        .otherwise(F.col("natural_language")).alias("natural_language"),
        F.col("_f.synth_op").alias("synth_op"), (F.col("fact_pos") * 2 + F.col("_i")).alias("fact_pos"))
