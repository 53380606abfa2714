import itertools
import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import spelling as S

LOWER = {i: i + 32 for i in range(65, 91)}


def counted(texts, ids):
    c = Counter()
    for i, text in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    around = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, xs in around.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(around[w]), words.get(form[w])))
    return sorted(out, key=str)


def columns(rows):
    return sorted([(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows], key=str)


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", min_size=7, max_size=14), st.integers(0, 30), st.sampled_from("abcdé"), st.integers(0, 2), st.randoms())
def test_near_words_meet_at_a_pivot(word, at, letter, kind, rng):
    at %= len(word)
    other = [word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]][kind]
    if other == word:
        return
    grams = sorted(set(S.bigrams(word) + S.bigrams(other) + ["ab", "bc"]))
    rng.shuffle(grams)  # any order of the bigrams will do
    order, weight = {g: i for i, g in enumerate(grams)}, [rng.randrange(9) for _ in grams]
    weight.sort()
    probes, entries = {}, {}
    for w in (word, other):
        prefix = S.prefix_of(w, order)
        pivots = S.pivots_of(prefix, weight)
        assert len(pivots) == 2 and abs(pivots[0][1] - pivots[1][1]) >= 2
        lightest = min(weight[a[0]] + weight[b[0]] for a, b in itertools.combinations(prefix, 2) if abs(a[1] - b[1]) >= 2)
        assert sum(weight[r] for r, _ in pivots) == lightest
        sides = lambda p: [("left", w[: p + 2]), ("right", w[p:])]  # noqa: B023, E731
        entries[w] = {(*side, len(w)) for _, p in prefix for side in sides(p)}
        probes[w] = {(*side, len(w) + d) for _, p in pivots for side in sides(p) for d in (0, 1, -1)}
    assert probes[word] & entries[other] or probes[other] & entries[word]


def test_all_edits_of_a_word(spark):
    """Every edit of short and long words is found, whichever side and half it lies in."""
    words = {"abcde", "abcdefghijk", "éabéabéab"}
    for w in list(words):
        for k in range(len(w) + 1):
            words |= {w[:k] + "x" + w[k:], w[:k] + "b" + w[k:], w[:k] + "y" + w[k + 1 :], w[:k] + w[k + 1 :]}
    words = sorted(w for w in words if len(w) >= 5)
    got = S.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long"))
    assert sorted((r.a, r.b) for r in got.collect()) == [(a, b) for a, b in itertools.combinations(words, 2) if near(a, b)]


def words_text(rng):
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 12))) for _ in range(25)]
    out = []
    for b in base:
        out += [b.upper() if rng.random() < 0.3 and b.isascii() else b] * rng.choice([2, 20, 300])
        for _ in range(6):
            k = rng.randrange(len(b))
            out += [rng.choice([b[:k] + b[k + 1 :], b[:k] + rng.choice("xyÿ") + b[k:], b[:k] + rng.choice("xyÀ") + b[k + 1 :]])] * rng.choice([1, 2, 21])
    rng.shuffle(out)
    return out


def test_against_brute_force(make_docs):
    rng = random.Random(2)
    pool = words_text(rng)
    texts = [None, "", "short wörds only", "x" * 5000 + " " + "x" * 5000, *[rng.choice([" ", "\n", "1", "—"]).join(pool[i : i + 60]) for i in range(0, len(pool), 60)]]
    texts += texts[4:6]
    ids = [None, 1, 1, None, *range(4, len(texts))]
    words = counted(texts, ids)
    wanted = brute(words)
    assert any(r[1] for r in wanted)
    vocabulary = S.vocabulary(make_docs(texts, ids))
    assert {r.word: r.n for r in vocabulary.collect()} == words
    for chunk in (S.CHUNK, 2):
        assert columns(S.variants(vocabulary, chunk=chunk).collect()) == wanted


def test_long_chain_and_empty_table(spark, make_docs):
    assert S.variants(S.vocabulary(make_docs([]))).count() == 0
    words = {"abcdefgh"[:8] + "zyxwvuts"[:i]: 10 ** (i + 1) for i in range(8)}
    got = columns(S.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect())
    assert got == brute(words) and {r[2] for r in got} == {"abcdefghzyxwvut"}
