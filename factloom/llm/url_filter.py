"""Judge urls by host and path rules kept in a sorted digest array.

Rules and their hosts are hashed to 64-bit xxhash keys, sorted, and written with
their full strings to one file in the shared checkpoint folder; Spark hands that
file to every executor, where tasks memory-map it. A batch of urls probes the
hosts' keys with all its host suffixes at once by binary search, then the rules'
keys with the path prefixes of the lengths that the matching hosts have. Equal
keys are confirmed on the stored strings, so collisions decide nothing. The
urls themselves are never shuffled.

Defined cases: a null url or one without ``://`` has empty host and path and
matches no rule; a url that no rule fits gets ``DEFAULT`` and a null rule; equal
rules count once, of contradicting ones the block wins; no rules and empty tables
are allowed; other columns pass through ``judge``.
"""

from __future__ import annotations

import hashlib
import json
import string
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import fresh, remembered
from factloom.session import ensure_checkpoint_dir

#: An unlisted url is allowed: a list blocks what it names.
DEFAULT = "allow"
#: The rules are a configuration, not data: a longer file than this is refused.
MOST_BYTES = 1 << 30


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _keys(texts: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=np.uint64)


def _section(texts: list[str]) -> tuple[list[str], dict[str, np.ndarray]]:
    """Texts in the order of their keys, and the arrays that hold them."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    keys = _keys(raw)
    order = np.argsort(keys, kind="stable")
    raw = [raw[i] for i in order]
    return [texts[i] for i in order], {
        "keys": keys[order], "ends": np.cumsum([0, *map(len, raw)]).astype(np.int64),
        "text": np.frombuffer(b"".join(raw), dtype=np.uint8)}


def build(rules: Iterable[tuple[str, str]]) -> bytes:
    """The index file of (rule, verdict) pairs; a rule is host and path in one string, as in ``example.org/es/``."""
    verdicts: dict[str, str] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        rule = host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) + slash + path
        verdicts[rule] = "block" if "block" in (verdict, verdicts.get(rule)) else "allow"
    lengths: dict[str, set[int]] = {}
    for rule in verdicts:
        host, slash, path = rule.partition("/")
        lengths.setdefault(host, set()).add(len(slash + path))
    names, rule_part = _section(sorted(verdicts))
    hosts, host_part = _section(sorted(lengths))
    per_host = [sorted(lengths[h]) for h in hosts]
    arrays = {f"rule_{k}": v for k, v in rule_part.items()} | {f"host_{k}": v for k, v in host_part.items()}
    arrays["rule_block"] = np.array([verdicts[r] == "block" for r in names], dtype=np.uint8)
    arrays["host_first"] = np.cumsum([0, *map(len, per_host)]).astype(np.int64)
    arrays["path_lengths"] = np.array([x for p in per_host for x in p], dtype=np.int64)
    head, body, at = {}, [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = (a.dtype.str, at, len(a))
        raw += b"\0" * (-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    described = json.dumps(head).encode()
    described += b" " * (-len(described) % 8)
    out = np.array([len(described)], dtype="<i8").tobytes() + described + b"".join(body)
    if len(out) > MOST_BYTES:
        raise ValueError(f"{len(out)} bytes of rules; at most {MOST_BYTES} are handed to executors")
    return out


class Digests:
    """A memory-mapped index file."""

    def __init__(self, path: str):
        whole = np.memmap(path, dtype=np.uint8, mode="r")
        size = int(whole[:8].view("<i8")[0])
        self.arrays = {}
        for name, (kind, at, n) in json.loads(whole[8 : 8 + size].tobytes()).items():
            at += 8 + size
            self.arrays[name] = whole[at : at + n * np.dtype(kind).itemsize].view(kind)

    def find(self, part: str, texts: list[str]) -> np.ndarray:
        """Position of each text among the stored ones, or -1."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        keys, probes = self.arrays[f"{part}_keys"], _keys(raw)
        ends, stored = self.arrays[f"{part}_ends"], self.arrays[f"{part}_text"]
        out = np.full(len(texts), -1, dtype=np.int64)
        first, last = np.searchsorted(keys, probes, "left"), np.searchsorted(keys, probes, "right")
        for i in np.flatnonzero(first < last):
            for k in range(first[i], last[i]):  # more than one only where keys collide
                if stored[ends[k] : ends[k + 1]].tobytes() == raw[i]:
                    out[i] = k
                    break
        return out

    def match(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, bool]]:
        """(longest fitting rule, whether it blocks) of each url."""
        known = sorted(set(hosts))
        suffixes = [[h, *(h[i + 1 :] for i, c in enumerate(h) if c == ".")] if h else [] for h in known]
        every = sorted({s for held in suffixes for s in held})
        found = dict(zip(every, self.find("host", every).tolist())) if every else {}
        first, lengths = self.arrays["host_first"], self.arrays["path_lengths"]
        fits = {h: [(s, lengths[first[found[s]] : first[found[s] + 1]].tolist()) for s in held if found[s] >= 0]
                for h, held in zip(known, suffixes)}
        wanted: list[list[str]] = []
        for host, path in zip(hosts, paths):
            wanted.append([s + path[:n] for s, held in fits[host] for n in held if n <= len(path)] if fits[host] else [])
        every = sorted({w for held in wanted for w in held})
        at = dict(zip(every, self.find("rule", every).tolist())) if every else {}
        block, out = self.arrays["rule_block"], []
        for held in wanted:
            best = max((w for w in held if at[w] >= 0), key=lambda w: (len(w), w), default=None)
            out.append((best, bool(block[at[best]]) if best is not None else False))
        return out


def publish(spark: SparkSession, data: bytes) -> str:
    """Write the index to the shared folder and have Spark hand it to executors; returns its file name."""
    name = f"url-rules-{hashlib.sha256(data).hexdigest()[:32]}"
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        out = files.create(path, True)
        for at in range(0, len(data), 1 << 22):
            out.write(bytearray(data[at : at + (1 << 22)]))
        out.close()
        spark.sparkContext.addFile(place)
    return name


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict added (underscores in front of names already there)."""
    name = publish(pages.sparkSession, build(rules))
    default = DEFAULT

    @F.pandas_udf("rule string, block boolean")
    def matched(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        from pyspark import SparkFiles

        held = remembered()
        if ("rules", name) not in held:
            held["rules", name] = Digests(SparkFiles.get(name))
        return pd.DataFrame(held["rules", name].match(hosts.tolist(), paths.tolist()), columns=["rule", "block"])

    host, path, rule, verdict, got = fresh(pages, "host", "path", "rule", "verdict", "url_match")
    out = pages.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col))})
    out = out.withColumn(got, matched(host, path))
    return out.select(*pages.columns, host, path, F.col(got).getField("rule").alias(rule), F.when(
        F.col(got).getField("rule").isNull(), default).when(F.col(got).getField("block"), "block").otherwise("allow").alias(verdict))
