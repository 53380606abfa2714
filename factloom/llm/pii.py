"""Replace personal data by keyed surrogates of the same type and format.

Detected entities: e-mail addresses, phone numbers, long account numbers, IPv4
addresses, secrets (access keys, passwords, tokens) and names behind a title. A
surrogate is a keyed permutation of the entity's canonical form: a Feistel
network over its digits and letters, each staying in its own alphabet, so length,
script, case, separators and check digit survive, equal entities get equal
surrogates and different ones different ones. Names become syllables of the same
script, first names with an ending of the gender that the title shows.

Permutations cannot tell whether a surrogate is somebody else's real value, and
names may coincide, so distinct entities are checked against each other by joins:
whoever hits a real value, or a surrogate that a smaller entity has, tries again
under another tweak until none is left. An entity that ``MOST_TRIES`` tries could
not help, as its format has too few values, gets a longer surrogate, an address
one of the reserved range; further tries lengthen it further. Texts are rewritten where they lie; only
entities with a tweak, usually none, are joined back.

Defined cases: null and empty texts stay as they are and have no entities; equal
rows are rewritten alike; other columns pass through ``replace``; an empty table
stays empty; the key is a parameter and never part of a result.
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, digest, fresh

ROUNDS, MOST_TRIES = 8, 40
KINDS = ("email", "phone", "number", "ip", "secret", "name")

# Titles by gender, alphabets by script, syllables by script.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"],
          "": ["Dr", "Prof"]}
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ",
             "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
             "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
SYLLABLES = {"latin": "ba be bo da de do fa fe ga ka ke la le lo ma me mi na ne no pa ra re ri ro sa se ta te to va ve".split(),
             "cyrillic": "ба ва го да де жи за ка ки ла ле ло ма ми на не но па ра ро са се та то".split(),
             "greek": "βα γα δε κα κο λα λε μα μι να νο πα πε ρα ρο σα σε τα το".split()}
ENDINGS = {"latin": {"m": "n", "f": "a", "": "l"}, "cyrillic": {"m": "н", "f": "а", "": "л"}, "greek": {"m": "ς", "f": "α", "": "λ"}}

_ALPHABET_OF = {c: a for a in ALPHABETS for c in a}
_TITLE_GENDER = {t.lower(): g for g, held in TITLES.items() for t in held}
_NAME = "[^\\W\\d_](?:[^\\W\\d_]|['’-](?=[^\\W\\d_]))+"
_ACCESS_KEY = re.compile(r"(?:AKIA|ASIA)(?P<v>[A-Z0-9]{16})(?![A-Za-z0-9])")
_SECRET_WORDS = ("password", "passwd", "secret", "token", "api")
_SECRET = re.compile(r"\b(?i:password|passwd|secret|token|api[_-]?key)\b\s*[:=]\s*[\"']?(?P<v>[^\s\"']{6,})")
_EMAIL = re.compile(r"(?P<v>[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})\b")
_EMAIL_BEFORE, _EMAIL_AFTER = 66, 400
#: Runs of digits and what stands between them; the numeric entities lie inside such runs.
_RUN = re.compile(r"[\d+(][\d().+ -]{5,}\d")
_NUMERIC = [
    ("ip", re.compile(r"(?<![\d.])(?P<v>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d.]*\d)")),
    ("number", re.compile(r"(?<![\d-])(?P<v>\d{4}(?:[ -]?\d{4}){2}(?:[ -]?\d{1,7}))(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])(?P<v>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])(?:\d{2,4}[ .-]){0,3}\d{3,4}|\+\d{8,14})(?![\w])")),
]
_TITLED = re.compile(rf"(?P<t>{'|'.join(sorted((t for held in TITLES.values() for t in held), key=len, reverse=True))})\.? (?P<v>{_NAME}(?: {_NAME})?)")
_RANK = {k: i for i, k in enumerate(("secret", "email", "ip", "number", "phone", "name"))}


class Keyed:
    """Keyed numbers and permutations; after ``most`` tries surrogates grow."""

    def __init__(self, key: bytes, most: int = MOST_TRIES):
        self.key, self.most = key, most

    def number(self, *parts) -> int:
        said = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
        return int.from_bytes(hmac.new(self.key, said, hashlib.sha256).digest(), "big")

    def permute(self, digits: list[int], radices: list[int], *tweak) -> list[int]:
        """A permutation of the numbers whose digits have these radices: two halves add to each other in turn."""
        half = len(digits) // 2
        parts, sizes = [0, 0], [1, 1]
        for i, (d, r) in enumerate(zip(digits, radices)):
            side = int(i >= half)
            parts[side], sizes[side] = parts[side] * r + d, sizes[side] * r
        for k in range(ROUNDS):
            side = k % 2
            parts[side] = (parts[side] + self.number("round", k, parts[1 - side], *radices, *tweak)) % sizes[side]
        out = []
        for i in range(len(digits) - 1, -1, -1):
            side = int(i >= half)
            parts[side], d = divmod(parts[side], radices[i])
            out.append(d)
        return out[::-1]

    def reshape(self, text: str, *tweak, keep: int = 0) -> str:
        """``text`` with the letters and digits behind the first ``keep`` characters permuted, each within its alphabet."""
        at = [i for i, c in enumerate(text) if i >= keep and c in _ALPHABET_OF]
        if re.fullmatch(r"[0-9a-f]+", text[keep:]):
            sets = ["0123456789" if text[i].isdigit() else "abcdef" for i in at]
        else:
            sets = [_ALPHABET_OF[text[i]] for i in at]
        got = self.permute([s.index(text[i]) for i, s in zip(at, sets)], [len(s) for s in sets], *tweak)
        out = list(text)
        for i, s, d in zip(at, sets, got):
            out[i] = s[d]
        return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` plus it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + (i % 2 == 0))
        total += d - 9 * (d > 9)
    return -total % 10


def script_of(word: str) -> str:
    c = word[:1].lower()
    return "cyrillic" if "а" <= c <= "я" or c == "ё" else "greek" if "α" <= c <= "ω" else "latin"


def canonical(kind: str, text: str) -> str:
    """What makes two mentions the same entity."""
    if kind in ("phone", "number"):
        return re.sub(r"\D", "", text)
    return text.lower() if kind in ("email", "first", "last") else text


def longer(keyed: Keyed, kind: str, value: str, tries: int, letters: str) -> str:
    """Keyed characters that a surrogate is lengthened by after so many tries; each four tries one more."""
    n, out = keyed.number("longer", kind, value, tries), ""
    for _ in range(2 + (tries - keyed.most) // 4):
        n, at = divmod(n, len(letters))
        out += letters[at]
    return out


def surrogate(keyed: Keyed, kind: str, value: str, tries: int = 0) -> str:
    """The canonical surrogate of a canonical value. First names are ``gender:name``."""
    if tries > keyed.most and kind not in ("first", "last"):  # names grow by themselves
        if kind == "ip":
            n = keyed.number("reserved", value, tries)
            parts = [240 + n % 16, *(n >> 8 * k & 255 for k in range(1, 4))]
            # should the reserved range be full as well, more octets make room
            parts += [n >> 8 * k & 255 for k in range(4, 3 + (tries - 1) // keyed.most)]
            return ".".join(map(str, parts))
        new, more = surrogate(keyed, kind, value), longer(keyed, kind, value, tries, ALPHABETS[kind in ("email", "secret")])
        if kind == "number":
            shift = int(value[-1]) - luhn(value[:-1])
            return new[:-1] + more + str((luhn(new[:-1] + more) + shift) % 10)
        return new.replace("@", more + "@", 1) if kind == "email" else new + more
    if kind == "number":
        body = keyed.reshape(value[1:-1], kind, tries)
        shift = int(value[-1]) - luhn(value[:-1])
        return value[0] + body + str((luhn(value[0] + body) + shift) % 10)
    if kind == "ip":
        first, *rest = map(int, value.split("."))
        if first in (10, 127) or value.startswith(("192.168.", "172.")):  # stays in its private or local range
            keep = 1 if first in (10, 127) else 2
            got = [*map(int, value.split(".")[:keep]), *keyed.permute(list(map(int, value.split(".")[keep:])), [256] * (4 - keep), kind, tries)]
        else:
            got = keyed.permute([first, *rest], [256] * 4, kind, tries)
        return ".".join(map(str, got))
    if kind == "email":
        local, _, domain = value.partition("@")
        own, *public = domain.rsplit(".", 2) if domain.count(".") > 1 else ["", domain]
        return keyed.reshape(local, kind, "local", own, tries) + "@" + ".".join(
            [*([keyed.reshape(own, kind, "domain", tries)] if own else []), *public])
    if kind in ("first", "last"):
        gender, _, name = value.rpartition(":")
        script = script_of(name)
        held, n = SYLLABLES[script], keyed.number(kind, value, tries)
        out = ""
        for _ in range(2 if kind == "first" else 3):
            n, at = divmod(n, len(held))
            out += held[at]
        # a try after the first adds syllables, so there is always another name
        for _ in range(tries // 4):
            n, at = divmod(n, len(held))
            out += held[at]
        return (f"{gender}:" if gender else "") + out + (ENDINGS[script][gender] if kind == "first" else "")
    keep = 1 if kind == "phone" and len(value) > 10 else 0
    return keyed.reshape(value, kind, tries, keep=keep)


def parts_of(kind: str, value: str, title: str) -> list[tuple[str, str]]:
    """(kind, canonical value) of the entities in one mention; a name is a last name behind a first name, if there are two words."""
    if kind != "name":
        return [(kind, canonical(kind, value))]
    *first, last = value.split(" ")
    gender = _TITLE_GENDER[title.lower()]
    return [("first", f"{gender}:{canonical('first', f)}") for f in first] + [("last", canonical("last", last))]


def _found(text: str):
    """(kind, match) of everything that looks like an entity; a search runs only where its first sign is there."""
    if "AKIA" in text or "ASIA" in text:
        for m in _ACCESS_KEY.finditer(text):
            if not text[max(0, m.start() - 1) : m.start()].isalnum():
                yield "secret", m
    low = text.lower()
    if any(w in low for w in _SECRET_WORDS):
        for m in _SECRET.finditer(text):
            yield "secret", m
    at = text.find("@")
    while at >= 0:
        # the address around this sign: its local part is bounded, and its domain is searched as far as it can reach
        m = next((m for m in _EMAIL.finditer(text, max(0, at - _EMAIL_BEFORE), at + _EMAIL_AFTER) if m.start() < at < m.end()), None)
        if m:
            yield "email", m
        at = text.find("@", at + 1)
    for run in _RUN.finditer(text):
        for kind, pattern in _NUMERIC:
            for m in pattern.finditer(text, run.start(), min(len(text), run.end() + 1)):
                yield kind, m
    for m in _TITLED.finditer(text):
        if not text[max(0, m.start() - 1) : m.start()].isalnum():
            yield "name", m


def mentions(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(begin, end, kind, value, title), in order, without overlaps; what begins first, and then the earlier kind, wins."""
    found = [(m.start("v"), _RANK[kind], m.end("v"), kind, m["v"], m["t"] if kind == "name" else "") for kind, m in _found(text or "")]
    out, last = [], 0
    for begin, _, end, kind, value, title in sorted(found):
        if begin < last or kind == "name" and not value[0].isupper():
            continue
        if kind == "name" and not value.split(" ")[-1][0].isupper():
            value = value.split(" ")[0]
            end = begin + len(value)
        out.append((begin, end, kind, value, title))
        last = end
    return out


def dressed(kind: str, text: str, new: str) -> str:
    """A canonical surrogate in the format of the mention."""
    if kind in ("phone", "number"):
        digits = iter(new)
        return "".join([next(digits) if c.isdigit() else c for c in text] + list(digits))
    if kind == "email":
        if len(text) == len(new):
            return "".join(n.upper() if c.isupper() else n for c, n in zip(text, new))
        return new
    if kind in ("first", "last"):
        new = new.rpartition(":")[2]
        return new.upper() if text.isupper() and len(text) > 1 else new.capitalize() if text[0].isupper() else new
    return new


def rewrite(keyed: Keyed, text: str | None, tries: dict[tuple[str, str], int] | None = None) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, original, surrogate) of each mention."""
    if not text:
        return text, []
    out, at, done, tries = [], 0, [], tries or {}
    for begin, end, kind, value, title in mentions(text):
        words = value.split(" ") if kind == "name" else [value]
        new = " ".join(dressed(k, w, surrogate(keyed, k, c, tries.get((k, c), 0))) for (k, c), w in zip(parts_of(kind, value, title), words))
        out += [text[at:begin], new]
        done.append((kind, value, new))
        at = end
    return "".join(out) + text[at:], done


def colliding(docs: DataFrame, key: bytes, text_col: str = "text", most: int = MOST_TRIES) -> DataFrame:
    """(kind, value, tries) of the distinct entities that need a tweak: those whose first surrogates are a real value or taken."""

    def held(batches):
        for b in batches:
            rows = {p for text in b["text"] for _, _, kind, value, title in mentions(text) for p in parts_of(kind, value, title)}
            yield pd.DataFrame(sorted(rows), columns=["kind", "value"])

    def named(batches):
        keyed = Keyed(key, most)
        for b in batches:
            b["new"] = [surrogate(keyed, k, v, t) for k, v, t in zip(b["kind"], b["value"], b["tries"])]
            yield b

    schema = "kind string, value string, tries int, new string"
    real = cut(docs.select(F.col(text_col).alias("text")).mapInPandas(held, "kind string, value string").distinct())
    now = cut(real.withColumn("tries", F.lit(0)).mapInPandas(named, schema))
    while True:
        taken = real.select("kind", F.col("value").alias("new"), F.lit(True).alias("real"))
        least = now.groupBy("kind", "new").agg(F.min("value").alias("least"), F.count(F.lit(1)).alias("n"))
        again = least.join(taken, ["kind", "new"], "left").where("n > 1 or real").select("kind", "new", "least", "real")
        marked = now.join(again, ["kind", "new"], "left")
        wrong = cut(marked.where("real or value > least").select("kind", "value", (F.col("tries") + 1).alias("tries")))
        if wrong.isEmpty():
            return now.where("tries > 0").select("kind", "value", "tries")
        now = cut(now.join(wrong.select("kind", "value"), ["kind", "value"], "left_anti").unionByName(wrong.mapInPandas(named, schema)))


def replace(docs: DataFrame, key: bytes, text_col: str = "text", most: int = MOST_TRIES) -> DataFrame:
    """``docs`` with the text rewritten, and ``entities`` (kind, original, surrogate) added, underscores in front if taken."""
    entities, got, extra, t1, t2, e1, e2 = fresh(docs, "entities", "pii_rewritten", "pii_tries", "pii_t1", "pii_t2", "pii_e1", "pii_e2")
    tweaked = cut(colliding(docs, key, text_col, most))
    tries = "array<struct<kind:string,value:string,tries:int>>"
    if tweaked.isEmpty():
        out = docs.withColumn(extra, F.array().cast(tries))
    else:
        def held(batches):
            for b in batches:
                rows = {(x1, x2, *p) for x1, x2, text in zip(b["t1"], b["t2"], b["text"])
                        for _, _, kind, value, title in mentions(text) for p in parts_of(kind, value, title)}
                yield pd.DataFrame(sorted(rows), columns=["t1", "t2", "kind", "value"])

        text = F.coalesce(F.col(text_col), F.lit(""))
        d1, d2 = digest(text)
        where = docs.select(d1.alias("t1"), d2.alias("t2"), text.alias("text")).mapInPandas(held, "t1 long, t2 long, kind string, value string")
        where = where.join(tweaked, ["kind", "value"]).groupBy(F.col("t1").alias(e1), F.col("t2").alias(e2)).agg(
            F.collect_set(F.struct("kind", "value", "tries")).alias(extra))
        out = docs.withColumns({t1: d1, t2: d2}).join(where, (F.col(t1) == F.col(e1)) & (F.col(t2) == F.col(e2)), "left")

    @F.pandas_udf("text string, entities array<struct<kind:string,original:string,surrogate:string>>")
    def rewritten(texts: pd.Series, tweaks: pd.Series) -> pd.DataFrame:
        keyed, rows = Keyed(key, most), []
        for text, tweak in zip(texts, tweaks):
            known = {(t["kind"], t["value"]): t["tries"] for t in tweak} if tweak is not None else {}
            new, done = rewrite(keyed, text, known)
            rows.append((new, [dict(zip(("kind", "original", "surrogate"), d)) for d in done]))
        return pd.DataFrame(rows, columns=["text", "entities"])

    out = out.withColumn(got, rewritten(F.col(text_col), F.col(extra)))
    return out.withColumns({text_col: F.col(got).getField("text"), entities: F.col(got).getField("entities")}).select(*docs.columns, entities)
