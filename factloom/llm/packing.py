"""Pack tokenised documents into sequences of a fixed length by bounded-space online best-fit.

Each input partition tokenises its documents and packs the pieces in the order
in which they come: a fixed number of open bins, held in a bitset keyed by free
space, so the bin with the least sufficient space is one shift and one lowest
bit away. If all bins are open and none fits, the fullest closes. What is open
at the end of a partition goes through the same packing again, as whole bins
beside those of the neighbouring partitions, so small partitions waste nothing.
Pieces of full length are a sequence each. No text, token or bin is shuffled;
only the few bins that were open last are joined with their pieces.

Defined cases: a null or empty text is the end mark alone; equal rows are packed
each; a null id passes through; an empty table gives no pieces; other columns
are not read.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, remembered

SEQUENCE = 2048
OPEN_BINS = 128
#: Partitions whose last bins meet in one task: at most this many times OPEN_BINS rows.
NEIGHBOURS = 64
#: Words kept per worker.
KEPT_WORDS = 400_000
END = b"\0\0\0\0"

_ODD = re.compile(r"[^\S \n]")
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    A byte-level vocabulary never merges across the border between a character
    that is no white space and a blank or line feed behind it, so a text is the
    sum of such chunks and each chunk needs to be encoded once. Words of Latin
    letters, which are most of the misses, go through the merge ranks that the
    tokenizer file itself lists; every other chunk, every text with other white
    space and every text with a special token's string goes through the
    tokenizer as it is. Tests compare the sum with the tokenizer's own ids.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.special = [t["content"] for t in described.get("added_tokens", [])]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {}
        for token, i in described["model"]["vocab"].items():
            if token not in self.special:
                ranks[bytes(byte_of[c] for c in token)] = i
        self.ranks = tiktoken.Encoding("ranks", pat_str=r" ?\p{L}+|[.,]+|\s+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _by_tokenizer(self, text: str) -> bytes:
        return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)

    def _learn(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            got = self._bytes(self.ranks.encode_ordinary(chunk))
        else:
            got = self._by_tokenizer(chunk)
        self.known[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        if _ODD.search(text) or any(s in text for s in self.special):
            return self._by_tokenizer(text)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        get, learn = self.known.get, self._learn
        return b"".join([get(c) or learn(c) for c in _CHUNK.findall(text)])


def _encoder(path: str) -> Encoder:
    held = remembered()
    if ("encoder", path) not in held:
        held["encoder", path] = Encoder(path)
    return held["encoder", path]


class BestFit:
    """Online best-fit over at most ``most`` open bins; bins are numbered as they open."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.mask, self.at, self.open, self.made = size, most, 0, {}, 0, 0

    def _take(self, free: int) -> int:
        held = self.at[free]
        number = held.pop()
        if not held:
            self.mask &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, need: int) -> tuple[int, int]:
        """(bin, offset) of a piece of ``need`` tokens, 1 to ``size``."""
        fits = self.mask >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.size, self.made
            self.made += 1
            if need < self.size and self.open >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
        left = free - need
        if left:
            self.at.setdefault(left, []).append(number)
            self.mask |= 1 << left
            self.open += 1
        return number, self.size - free

    def last(self) -> dict[int, int]:
        """Open bins and the tokens that they hold."""
        return {number: self.size - free for free, held in self.at.items() for number in held}


def pieces_of(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; all but the first are full."""
    if length <= size:
        return [(0, length)]
    first = length % size
    return ([(0, first)] if first else []) + [(at, size) for at in range(first, length, size)]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE,
         open_bins: int = OPEN_BINS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""

    def first_round(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, fit, rows = _encoder(tokenizer).encode, BestFit(size, open_bins), []
        # bins open at the end are known only then; small rows wait, texts don't
        for batch in batches:
            for doc, text in zip(batch["id"].tolist(), batch["text"].tolist()):
                ids = encode(text or "") + END
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, size)):
                    number, offset = fit.place(length)
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), number, offset))
        last = fit.last()
        for at in range(0, len(rows), 50_000):
            out = pd.DataFrame(rows[at : at + 50_000], columns=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset"])
            out["held"] = [last.get(b, 0) for b in out["bin"]]
            out["part"] = part
            yield out

    def second_round(keys, bins):
        bins = bins.sort_values(["held", "part", "bin"], ascending=[False, True, True])
        fit, out = BestFit(size, open_bins), []
        for p, b, held in zip(bins["part"].tolist(), bins["bin"].tolist(), bins["held"].tolist()):
            number, base = fit.place(held)
            out.append((p, b, keys[0], number, base))
        return pd.DataFrame(out, columns=["part", "bin", "block", "number", "base"])

    kind = docs.schema[id_col].dataType.simpleString()
    placed = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        first_round, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, held long, part long"))
    done = placed.where("held = 0").select(
        "doc_id", "piece", "start", "length", "ids_crc32", _number(F.lit(0), "part", "bin").alias("sequence_id"), "offset")
    open_ = placed.where("held > 0")
    merged = open_.groupBy("part", "bin").agg(F.max("held").alias("held")).groupBy(
        F.floor(F.col("part") / neighbours).alias("block")).applyInPandas(
        second_round, "part long, bin long, block long, number long, base long")
    moved = open_.join(merged, ["part", "bin"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", _number(F.lit(1), "block", "number").alias("sequence_id"),
        (F.col("offset") + F.col("base")).alias("offset"))
    return done.unionByName(moved)


def _number(round_: Column, part: str, number: str) -> Column:
    """One long from round, partition (up to 2^29) and bin (up to 2^32)."""
    return (F.shiftleft(round_.cast("long"), 62) + F.shiftleft(F.col(part).cast("long"), 32) + F.col(number).cast("long"))
