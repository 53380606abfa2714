from collections import Counter, defaultdict

import numpy as np

from llm_texts import prose
from factloom.llm import ngram_join as J


def brute(texts, ids):
    """Links of each text's set with other sets, and the partition into classes."""
    sets = [frozenset(s.tolist()) for s in J.token_sets(texts, 5)]
    unit = [(s or ("", t or "")) for s, t in zip(sets, texts)]
    distinct = sorted(set(unit), key=repr)
    at = {u: i for i, u in enumerate(distinct)}
    links, root = Counter(), list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(distinct)):
        for b in range(a + 1, len(distinct)):
            x, y = distinct[a], distinct[b]
            if isinstance(x, frozenset) and isinstance(y, frozenset) and len(x & y) >= 0.8 * len(x | y):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    return [links[at[u]] for u in unit], [find(at[u]) for u in unit]


def family(rng, n, edits):
    base = prose(rng, 120).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(40))
        out.append(" ".join(w))
    return out


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_against_brute_force_with_split_nodes(make_docs, rng):
    texts = [None, "", "!!", "one", "two words", *[prose(rng, rng.randrange(3, 200)) for _ in range(60)], *family(rng, 120, 5), *family(rng, 30, 2),
             *["exact copy of a text that is here many times"] * 40, prose(rng, 30_000)]
    ids = [None, 1, 1, *range(3, len(texts))]
    docs = make_docs(texts, ids)
    links, classes = brute(texts, ids)
    by_text = defaultdict(set)
    # a small limit makes the family's nodes split and be compared in chunks
    rows = J.classes(docs, limit=16, recall=0.9999).collect()
    assert len(rows) == len(texts)
    found = {r.id: r for r in rows if r.id is not None and r.id > 1}
    order = [i for i in range(3, len(texts))]
    assert [found[i].n_links for i in order] == [links[i] for i in order]
    assert same_partition([found[i].class_key for i in order], [classes[i] for i in order])
    for r in rows:
        by_text[r.class_key].add(r.class_id)
    assert all(len(x) == 1 for x in by_text.values())
    assert max(r.n_copies for r in rows) == 40


def test_recall_of_production_parameters(make_docs, rng):
    texts = [t for _ in range(25) for t in family(rng, 8, 3)]
    links, classes = brute(texts, None)
    rows = {r.id: r for r in J.classes(make_docs(texts)).collect()}
    got = sum(rows[i].n_links for i in range(len(texts)))
    assert got >= 0.98 * sum(links) and all(rows[i].n_links <= links[i] for i in range(len(texts)))


def test_keep_one(make_docs, rng):
    a, b = prose(rng, 100), prose(rng, 100)
    docs = make_docs([a, a + " tail", b, b, None, "", "?!", "?"], [7, 3, 5, 5, None, 8, 9, 10])
    out = J.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None) in (
        [(3, a + " tail"), (5, b), (8, ""), (9, "?!"), (10, "?")], [(3, a + " tail"), (5, b), (9, "?!"), (10, "?")])
    assert out.count() == 5 and J.keep_one(make_docs([])).count() == 0


def test_runs_and_compare():
    assert J.runs_for(0.998, 0.8) == 5 and J.runs_for(0.5, 0.8) == 1
    s = [np.arange(10, dtype=np.uint32), np.arange(10, dtype=np.uint32), np.arange(1, 11, dtype=np.uint32), np.arange(50, 60, dtype=np.uint32)]
    none = [np.array([9])] * 4
    links, root = J.compare(np.array([1, 2, 3, 4]), s, none, 9, None, 0.8)
    assert links.tolist() == [2, 2, 2, 0] and root.tolist() == [1, 1, 1, 4]
    links, root = J.compare(np.array([1, 2, 3, 4]), s, [np.array([5, 9]), np.array([5, 9]), np.array([9]), np.array([9])], 9, None, 0.8)
    assert links.tolist() == [1, 1, 2, 0] and root.tolist() == [1, 1, 1, 4]
