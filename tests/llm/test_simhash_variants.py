import random
import re
import string

import xxhash

from factloom.llm import simhash_variants as S
from llm_texts import prose


def plain(text, n=4):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, ids, radius=4):
    """Least id of each one's component, by comparing everything with everything."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        if x is not None:
            least[r] = min(x, least.get(r, x))
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprint_is_the_plain_one(monkeypatch):
    rng = random.Random(3)
    texts = ["", " \n", "one", "ONE two\x0bThree", "a b c d", "É é A\x1cB Straße x", "x y z x y z x y z " * 9, prose(rng, 700)]
    for t in texts:
        assert S.fingerprint(t.encode()) == plain(t)
    monkeypatch.setattr(S, "_PIECE", 50)
    for t in texts:
        assert S.fingerprint(t.encode()) == plain(t)


def test_one_segment_differs_by_at_most_one_bit():
    rng = random.Random(5)
    for radius in range(0, 9):
        cuts = S.segments(radius)
        assert sum(w for _, w in cuts) == 64
        for _ in range(300):
            bits = rng.sample(range(64), radius)
            assert any(sum(lo <= b < lo + w for b in bits) <= 1 for lo, w in cuts)


def family(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = rng.choice(["neu", "alt", "edit"]) + str(rng.randrange(50))
        out.append(" ".join(w))
    return out


def test_against_brute_force(make_docs, rng):
    texts = [None, "", "  ", "!!", "one", *[prose(rng, rng.randrange(1, 90)) for _ in range(80)],
             *family(rng, prose(rng, 400).split(), 60, 2), *family(rng, prose(rng, 150).split(), 60, 1), *["the same text"] * 20]
    ids = [None, 1, 1, *range(3, len(texts))]
    fps = [plain(t) for t in texts]
    wanted = sorted(zip(map(str, ids), fps, map(str, brute(fps, ids))))
    assert len({w for _, _, w in wanted}) < len(set(fps)) - 20
    for limit in (S.LIMIT, 6):  # a small limit sends the families through chunks and strangers
        rows = S.components(make_docs(texts, ids), limit=limit).collect()
        assert sorted((str(r.id), r.fp % (1 << 64), str(r.component_id)) for r in rows) == wanted


def test_dense_fingerprints_in_large_variants(spark, monkeypatch):
    """Thousands of fingerprints around few centres, with strangers that only chunk pairs can link."""
    rng = random.Random(7)
    fps = set()
    for centre in [rng.getrandbits(64) for _ in range(4)]:
        for _ in range(260):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(44, 64), rng.randrange(7))))
    fps = sorted(fps) + [0]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    monkeypatch.setattr(S, "fingerprints", lambda docs, *a: docs)
    rows = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "id long, fp long")
    got = S.components(rows, limit=40).collect()
    assert [r.component_id for r in sorted(got)] == brute(fps, range(len(fps)))


def test_empty_table_and_names(make_docs, spark):
    assert S.components(make_docs([])).count() == 0
    docs = spark.createDataFrame(
        [("x", "a b c d e", 1), (None, "a b c d e", 2), ("b", "A B c d e", 3)], "doc_id string, text string, fp int")
    assert [(r.id, r.component_id) for r in S.components(docs).orderBy("id").collect()] == [(None, "b"), ("b", "b"), ("x", "b")]
    only_null = spark.createDataFrame([(None, "a b c")], "doc_id long, text string")
    assert [tuple(r)[::2] for r in S.components(only_null).collect()] == [(None, None)]
