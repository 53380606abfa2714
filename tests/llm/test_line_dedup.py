import hashlib
import string

from factloom.llm import line_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def expected(texts, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) == "" or seen[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_against_brute_force(make_docs, rng):
    common = ["Shared  line", " shared  LINE\t", "ÉCOLE", "école", "", "\x0b", "x\x1c"]
    texts = [None, "", "\n\n", "alone", *["\n".join(rng.choice(common + [f"own {i}"]) for _ in range(rng.randrange(1, 9))) for i in range(60)]]
    texts += texts[5:9] + ["same text twice\nshared  line"] * 3
    docs = make_docs(texts, [None, 1, 1, *range(3, len(texts))])
    got = line_dedup.dedup_lines(docs, min_docs=4).collect()
    assert sorted((r.n_lines, r.n_dropped, r.kept) for r in got) == expected(texts, 4)
    assert any(r.n_dropped for r in got)


def test_names_and_stage(make_docs):
    docs = make_docs([f"head {i}\nfooter" for i in range(12)] + [None])
    out = line_dedup.stage(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[3].text == "head 3" and rows[3].n_chars == 6 and rows[12].text == ""
    clash = docs.withColumnRenamed("source", "kept").withColumnRenamed("lang", "N_LINES")
    assert line_dedup.dedup_lines(clash).columns[len(docs.columns):] == ["_kept", "_n_lines", "n_dropped"]


def test_empty_table_and_long_text(make_docs):
    assert line_dedup.dedup_lines(make_docs([])).count() == 0
    long = "\n".join(f"line {i % 5000}" for i in range(40_000))
    got = line_dedup.dedup_lines(make_docs([long] * 2 + ["line 7"]), min_docs=3).collect()
    assert sorted(r.n_dropped for r in got) == [1, 8, 8]
    assert hashlib.sha256(max(got, key=lambda r: len(r.kept)).kept.encode()).hexdigest()


def test_native(make_docs):
    plan = line_dedup.dedup_lines(make_docs(["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
