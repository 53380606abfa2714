import numpy as np
import pytest
from llm_texts import prose

from factloom.llm import quality, toxicity

BAD = ["grumblefut", "snarkwort", "blothead"]


@pytest.fixture
def corpus(make_docs, spark, rng):
    texts, toxic, good = [], [], []
    for i in range(160):
        t = prose(rng, rng.randrange(30, 120)).split()
        if i % 4 == 0:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(BAD)
        text = " ".join(t)
        if i % 5 == 0:
            text = " ".join([t[0]] * 60 + [t[1]] * 60)
        texts.append(text)
        toxic.append(int(i % 4 == 0 and i % 5 != 0))
        good.append(int(i % 5 != 0))
    texts += [None, "", prose(rng, 20_000), "sn4rkw0rt and b l o t h e a d, gruuuumblefut!", texts[1], texts[1]]
    labels = spark.createDataFrame([(i, g, t, "x") for i, (g, t) in enumerate(zip(good, toxic))] + [(None, 1, 1, "x"), (3, None, None, "x"), (7, good[7], toxic[7], "y")],
                                   "doc_id long, quality int, toxic int, text string")
    return make_docs(texts, [*range(160), None, 161, 162, 163, 164, 164]), labels, toxic, good


def test_toxicity(corpus):
    docs, labels, toxic, _ = corpus
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == [*docs.columns, "_score", "restored"]
    rows = out.collect()
    assert len(rows) == 166
    score = {r.doc_id: r["_score"] for r in rows}
    assert all(0 <= r["_score"] <= 1 for r in rows)
    assert np.mean([(score[i] >= 0.3) == bool(toxic[i]) for i in range(160)]) > 0.95
    assert score[163] >= 0.3 and score[None] < 0.3 and score[161] < 0.3
    read = {x.restored for r in rows if r.doc_id == 163 for x in r.restored}
    assert {"snarkwort", "grumblefut"} <= read and any("blothead" in x.split() for x in read)
    kept = toxicity.stage(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(x < 0.3 for x in [r["_score"] for r in rows])


def test_unseen_words_take_no_odds_of_others(corpus, make_docs):
    import itertools

    import xxhash

    wanted, strangers = {xxhash.xxh64_intdigest(w) % (1 << 20): w for w in BAD}, {}
    for letters in itertools.product("bcdfghjklmnpqrstvwxz", repeat=6):
        word = "".join(letters)
        at = xxhash.xxh64_intdigest(word) % (1 << 20)
        if at in wanted:
            strangers.setdefault(wanted[at], word)
            if len(strangers) == len(BAD):
                break
    docs, labels, _, _ = corpus
    model = toxicity.fit(docs, labels)
    assert not any(m in model.odds for w in strangers.values() for m in toxicity.marks_of(w)) and all(toxicity.marks_of(w)[0] in model.odds for w in BAD)
    rows = toxicity.score(make_docs([" ".join(["plain", *words, "text"]) for words in (strangers.values(), BAD, [])]), model).orderBy("doc_id").collect()
    assert rows[0]["_score"] < 0.3 <= rows[1]["_score"]
    assert abs(rows[0]["_score"] - rows[2]["_score"]) < 0.1


def test_toxicity_without_labels(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["_score"] for r in toxicity.score(make_docs(["a", None]), toxicity.fit(make_docs(["a", None]), none)).collect()] == [0.0, 0.0]
    empty = make_docs([])
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


def grams(words, counts):
    keys, held = toxicity.char_counts(words, np.array(counts))
    return toxicity.Grams(keys, held, float(held.sum()))


def test_counts_match_a_plain_count():
    g = grams(["abc", "ab", "é"], [2, 3, 1])
    assert g.of("a") == 5 and g.of("\x02a") == 5 and g.of("abc") == 2 and g.of("\x02abc") == 2 and g.of("b\x03") == 3
    assert g.of("ab", True) == 5 and g.of("\x02", True) == 6 and g.of("c", True) == 2 and g.of("zz") == 0
    assert toxicity.Grams(*toxicity.char_counts([], np.zeros(0)), 0.0).of("a") == 0


def test_the_character_model_grows_with_the_corpus(make_docs, rng, monkeypatch):
    import re
    from collections import Counter

    monkeypatch.setattr(toxicity, "GRAMS_HELD", 4000)
    sizes = []
    for n in (20, 2000):
        texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randrange(1, 9))) + " Shared" for _ in range(n)]
        docs = make_docs(texts + [None, ""])
        plain = Counter(w for t in texts for w in re.findall(r"\w+", t.lower()))
        held = docs.limit(1).mapInPandas(lambda batches, m=toxicity.char_model(docs): (
            __import__("pandas").DataFrame({"keys": [g.keys.tolist()], "counts": [g.counts.tolist()]}) for _ in batches for g in [m.load()]),
            "keys array<long>, counts array<double>").first()
        keys, counts = toxicity.char_counts(list(plain), np.array(list(plain.values())))
        assert held["keys"] == keys.tolist() and held["counts"] == counts.tolist()
        sizes.append(len(keys))
    assert sizes[1] > 10 * sizes[0]
    assert toxicity.char_model(make_docs([])).total == 0


def restorer():
    return toxicity.Restorer(grams(["stupid", "stop", "tip", "sit", "idiot", "moron", "letter", "sitting"], [5, 9, 2, 4, 6, 5, 7, 3]))


def test_viterbi_is_the_best_path():
    import itertools

    r = restorer()
    for token in ("st0p", "$tup1d", "s1t", "t!p", "s**p", "*!*t", "stuupiid"):
        def cost(choice):
            text, total, state = "".join(x for x, _ in choice) + "\x03", sum(c for _, c in choice), "\x02"
            for c in text:
                total, state = total + r.cost(state, c), (state + c)[-3:]
            return total
        best = min(itertools.product(*r.lattice(token)), key=cost)
        assert r.best(r.lattice(token)) == "".join(x for x, _ in best)


def test_nothing_is_lost_to_the_beam(monkeypatch):
    r = restorer()
    tokens = ["s**p", "m**0n", "**!**t", "st*p!d", "1d10t"]
    whole = [r._search(r.lattice(t), float("inf"), None) for t in tokens]
    for beam in (1, 5, 200):
        monkeypatch.setattr(toxicity, "BEAM", beam)
        assert [r.best(r.lattice(t)) for t in tokens] == [reading for _, reading, _ in whole]


def test_disguises_that_reach_the_lattice():
    r = restorer()
    read = {t: r.word(t) for t in ("iidioot", "stuupid", "stuuuupid", "st0p", "m0ron", "letter", "sitting", "stop", "1984")}
    assert read == {"iidioot": "idiot", "stuupid": "stupid", "stuuuupid": "stupid", "st0p": "stop", "m0ron": "moron",
                    "letter": "letter", "sitting": "sitting", "stop": "stop", "1984": "1984"}
    assert toxicity._EDGE.sub("", "a$$") == "a$$" and toxicity._EDGE.sub("", "$$a5!") == "a5"


def test_quality(corpus):
    docs, labels, _, good = corpus
    out = quality.score(docs, quality.fit(docs, labels))
    assert out.columns == [*docs.columns, "_score"]
    rows = out.collect()
    score = {r.doc_id: r["_score"] for r in rows}
    assert len(rows) == 166 and all(0 <= r["_score"] <= 1 for r in rows)
    held_out = [i for i in range(160) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(score[i] >= 0.3) == bool(good[i]) for i in held_out]) > 0.95


def test_quality_without_labels(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    docs = make_docs(["a b", None])
    assert [r["_score"] for r in quality.score(docs, quality.fit(docs, none)).collect()] == [0.0, 0.0]
    assert {r["_score"] for r in quality.score(docs, quality.fit(docs, one)).collect()} <= {0.0, 1.0}
    assert quality.score(make_docs([]), quality.fit(make_docs([]), none)).count() == 0


def test_discriminant_against_densities():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(size=(400, 3)) @ np.diag([1, 2, 0.5]), 1: rng.normal(size=(300, 3)) + 1}
    d = quality.Discriminant({y: (len(v), v.sum(axis=0), v.T @ v) for y, v in x.items()}, shrink=0.0, ridge=0.0)
    point = rng.normal(size=(5, 3))
    part = {y: 3 / (len(x[y]) + 3) for y in x}
    pooled = sum(np.cov(x[y].T) * (len(x[y]) - 1) for y in x) / 698
    log = {}
    for y, v in x.items():
        c = (1 - part[y]) * np.cov(v.T) + part[y] * pooled
        diff = point - v.mean(axis=0)
        log[y] = np.log(len(v) / 700) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(c), diff)
    assert np.allclose(d.score(point), 1 / (1 + np.exp(log[0] - log[1])))
