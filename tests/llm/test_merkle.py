import hashlib
import zlib

from pyspark.sql import functions as F

from factloom.llm import merkle as M

LOWER = {i: i + 32 for i in range(65, 91)}


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, text):
    return H(enc(row["doc_id"]), enc(row["source"]), enc(row["lang"]), enc(row["n_chars"]), enc(text))


def grow(nodes):
    """Root, and for every node the siblings of its path as (left, right)."""
    own, at, path = list(range(len(nodes))), nodes, [[] for _ in nodes]
    while len(at) > 1:
        for i, o in enumerate(own):
            lo = o // 8 * 8
            path[i].append(("".join(at[lo:o]), "".join(at[o + 1 : lo + 8])))
        at = [H(*at[i : i + 8]) for i in range(0, len(at), 8)]
        own = [o // 8 for o in own]
    return at[0], path


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, inner = [], {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        top, inner[g] = grow([leaf_of(r, r["text"]) for r in groups[g]])
        tops.append(top)
    root, above = grow(tops)
    out = []
    for g, top, up in zip(order, tops, above):
        for r, path in zip(groups[g], inner[g]):
            text, bad = r["text"], r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            fold = leaf_of(r, text.translate(LOWER) if bad and text is not None else text)
            for left, right in path + up:
                fold = H(left, fold, right)
            out.append((r["doc_id"], leaf_of(r, text), top, root, H(*[x for p in path + up for x in p]), fold, fold == root))
    return sorted(out, key=str)


def made(spark, rows):
    docs = spark.createDataFrame([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"], "x", 1, 2) for r in rows],
                                 "doc_id long, source string, lang string, n_chars long, text string, PATH string, h int, idx int")
    got = M.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    got = got.select("id", "leaf", "subroot", "root", F.sha2(M.siblings(F.col("path")), 256), M.folded(F.col("claimed"), F.col("path")).alias("f"))
    return sorted([(*r, r.f == r.root) for r in got.collect()], key=str)


def rows_of(rng, n, langs):
    out = []
    for i in range(n):
        text = rng.choice([None, "", "lower only", f"Text Ä {i}", f"UPPER É {i}"])
        out.append(dict(doc_id=rng.choice([i, i, 7, 2**60 + i]), source=rng.choice([None, "", "s"]), lang=rng.choice(langs),
                        n_chars=rng.choice([None, 4]), text=text))
    return out


def test_against_brute_force(spark, rng, monkeypatch):
    monkeypatch.setattr(M, "RANGE", 30)  # several range partitions, borders within groups and within equal ids
    rows = rows_of(rng, 320, ["en"] * 9 + ["de", None, "", "Zz", "é"]) + rows_of(rng, 9, [f"l{i}" for i in range(9)])
    rows += [dict(doc_id=None, source="s", lang="en", n_chars=1, text="Null Id")] * 2 + [dict(doc_id=11, source="s", lang="en", n_chars=3, text="Same")] * 70
    got = made(spark, rows)
    assert got == brute(rows)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_small_trees(spark):
    row = dict(doc_id=3, source=None, lang=None, n_chars=None, text=None)
    for n in (1, 2, 8, 9):
        rows = [row | {"doc_id": i} for i in range(n)]
        assert made(spark, rows) == brute(rows)


def test_one_leaf_is_the_root_and_empty_table(spark, make_docs):
    assert M.manifest(make_docs([])).count() == 0
    got = M.manifest(make_docs(["a" * 300_000])).first()
    assert got.leaf == got.subroot == got.root and got.path == [] and got.grp == "en"
