from llm_texts import prose

from factloom.llm import decontaminate as D
from factloom.llm.common import shingles, text_words


def test_leaks_and_clean(make_docs, spark, rng):
    items = [prose(rng, rng.randrange(14, 60)) for _ in range(30)] + [None, "", "one", "two words", prose(rng, 400)]
    items.append(items[0])
    bench = spark.createDataFrame([(i if i != 33 else None, t, "x") for i, t in enumerate(items)], "item_id long, text string, similarity string")
    clean = [prose(rng, rng.randrange(1, 400)) for _ in range(40)] + [None, "", "!!!", prose(rng, 20_000)]
    dirty, want = [], set()
    for k in range(60):
        i = rng.randrange(30)
        w = items[i].split()
        if k % 3 == 1 and len(w) > 50:
            w[rng.randrange(len(w))] = "changed"
        if k % 3 == 2:
            w = [x.upper() + "," for x in w]
        cut = rng.randrange(5, 200)
        dirty.append(prose(rng, cut) + " " + " ".join(w) + " " + prose(rng, 30))
        want.add((100 + k, i))
    dirty += [items[34], items[34] + " " + items[2], items[5]]
    want |= {(160, 34), (161, 34), (161, 2), (162, 5)}
    want |= {(d, 35) for d, i in want if i == 0}  # an item that is there twice
    docs = make_docs(clean + dirty, [*range(len(clean)), *range(100, 100 + len(dirty))])
    got = D.leaks(docs, bench)
    rows = got.collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    # an edit in the middle of an item of more than 50 words leaves 0.8 and more
    assert want <= found, sorted(want - found)
    assert not {d for d, _ in found if d < 100}
    index = D.Index([35], [items[0]], 5, 0.8, D.RADIUS, D.BLOCKS)
    for r in rows:
        text = text_words([(clean + dirty)[len(clean) + r.doc_id - 100]])[0][r.first_word : r.first_word + r.words]
        if r.item_id == 0:
            own, it = shingles(text, 5).tolist(), shingles(index.words[0], 5).tolist()
            assert abs(len(set(own) & set(it)) / len(set(own) | set(it)) - r.similarity) < 1e-9
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(clean)))


def test_empty_tables_and_slices(make_docs, spark, rng, monkeypatch):
    bench = spark.createDataFrame([(i, prose(rng, 30)) for i in range(9)], "item_id long, text string")
    docs = make_docs([r.text for r in bench.collect()])
    assert D.leaks(make_docs([]), bench).count() == 0 and D.leaks(docs, bench.limit(0)).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == 9
    monkeypatch.setattr(D, "SLICE", 2)
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()} == {(i, i) for i in range(9)}


def test_blocks_find_everything_within_the_radius(rng):
    import numpy as np

    bits = np.random.default_rng(0)
    texts = [prose(rng, rng.choice([12, 30, 31, 90, 400])) for _ in range(60)]
    for radius, blocks in ((7, 4), (D.RADIUS, D.BLOCKS), (3, 5)):
        index = D.Index(list(range(60)), texts, 5, 0.8, radius, blocks)
        assert len(index.classes) >= 4
        for size, _, _, prints in index.classes:
            got = bits.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + bits.integers(0, 2, 3000, dtype=np.uint64)
            near = []
            for p in prints.tolist():
                for r in range(radius + 3):
                    x = p
                    for b in bits.choice(64, r, replace=False).tolist():
                        x ^= 1 << b
                    near.append(x)
            got = np.concatenate([got, np.array(near, dtype=np.uint64)])
            found = [(int(w), int(i)) for ws, js in index._near(got, size, prints) for w, i in zip(ws, js)]
            apart = np.bitwise_count(got[:, None] ^ prints[None, :])
            assert len(found) == len(set(found)) and set(found) == set(zip(*(x.tolist() for x in np.nonzero(apart <= radius))))
        # every class went through its lists, which are far from holding every item for every value
        assert set(index.lists) == {c[0] for c in index.classes}
        for size, _, _, prints in index.classes:
            assert sum(len(items) / (len(first) - 1) for _, first, items in index.lists[size]) < 0.12 * len(prints)


def test_leaks_equal_all_windows_against_all_items(rng, monkeypatch):
    import numpy as np

    items = [prose(rng, rng.choice([20, 40, 60])) for _ in range(25)]
    docs = [prose(rng, rng.randrange(0, 300)) for _ in range(20)]
    for k in range(40):
        w = items[k % 25].split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "other"
        docs.append(" ".join([prose(rng, rng.randrange(1, 60)), *w, prose(rng, rng.randrange(1, 60))]))
    docs += [" ".join(i.split()[: -k or None]) for k, i in enumerate(items[:6])]
    words = text_words(docs)
    by_lists = D.Index(list(range(25)), items, 5, 0.8, D.RADIUS, D.BLOCKS).hits(words)

    def every(self, got, size, prints):
        w, i = np.nonzero(np.bitwise_count(got[:, None] ^ prints[None, :]) <= self.radius)
        yield w, i

    monkeypatch.setattr(D.Index, "_near", every)
    assert by_lists == D.Index(list(range(25)), items, 5, 0.8, D.RADIUS, D.BLOCKS).hits(words)
    assert all(any(h[0] == k % 25 and h[1] == 1.0 for h in by_lists[20 + k]) for k in range(0, 40, 4))


def test_windows_start_anew_in_every_document(rng):
    sizes = [s for s in (20, 40, 58, 120, 500) for _ in range(3)]
    items = [prose(rng, s) for s in sizes]
    index = D.Index(list(range(len(items))), items, 5, 0.8, D.RADIUS, D.BLOCKS)
    docs = [(None, prose(rng, rng.randrange(3, 200))) for _ in range(60)]
    for i, (item, size) in enumerate(zip(items, sizes)):
        for more in range(round(size / D.STEP) + 1):
            before = rng.randrange(more + 1)
            docs.append((i, " ".join([prose(rng, before), item, prose(rng, more - before)]).strip()))
    for _ in range(3):
        rng.shuffle(docs)
        for at in range(0, len(docs), 64):
            part = docs[at : at + 64]
            for (i, _), found in zip(part, index.hits(text_words([t for _, t in part]))):
                assert i is None or any(h[0] == i and h[1] > 0.999 for h in found)


def test_grid_of_windows():
    import numpy as np

    got = D.grid(np.array([0, 7, 9, 9]), np.array([7, 2, 0, 5]), 4, 2)
    assert got.tolist() == [0, 2, 3, 9, 10]
    assert D.grid(np.array([0]), np.array([3]), 4, 2).tolist() == []


def test_copies_templates_and_slices_do_not_change_a_similarity(make_docs, spark, rng, monkeypatch):
    base, other, head = prose(rng, 60).split(), prose(rng, 60), prose(rng, 50).split()
    templated = [" ".join(head[:25] + [f"slot{i}"] + head[25:]) for i in range(8)]
    items = [" ".join(base)] * 10 + [other] + templated
    near = " ".join([*base[:30], "changed", *base[31:]])
    from_template = " ".join(head[:25] + ["slotx"] + head[25:])
    docs = make_docs([near, other, from_template])

    def found(rows):
        bench = spark.createDataFrame(list(enumerate(rows)), "item_id long, text string")
        return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in D.leaks(docs, bench).collect()}

    alone = found(items[9:11])
    got = found(items)
    plain = 51 / 61  # of 56 shingles five hold the changed word
    assert abs(alone[0, 0] - plain) < 1e-6
    assert got[1, 10] == 1.0 and all(got[0, i] == alone[0, 0] for i in range(10))
    assert all((2, 11 + i) in got and got[2, 11 + i] >= 0.8 for i in range(8))
    monkeypatch.setattr(D, "SLICE", 4)
    assert found(items) == got
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert D.clean(docs, bench).count() == 0
