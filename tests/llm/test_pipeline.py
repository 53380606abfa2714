import zlib

import corpus_pipeline
import pytest
from llm_texts import prose

from factloom.llm import decontaminate, ngram_join, packing, toxicity
from factloom.llm.queries import QUERIES, tokenizer

BAD = ["grumblefut", "snarkwort", "blothead"]


@pytest.fixture
def tables(make_docs, spark, rng, tmp_path):
    items = [prose(rng, 40) for _ in range(5)]
    texts = []
    for i in range(90):
        t = prose(rng, rng.randrange(30, 90))
        if i % 4 == 0:
            t += " " + " ".join(rng.choice(BAD) for _ in range(4))
        texts.append(t + ("\nsubscribe to our letter" if i % 3 == 0 else ""))
    texts += [texts[1], texts[2] + " end", prose(rng, 20) + " " + items[2], items[0], None, "", prose(rng, 5000)]
    docs = make_docs(texts, [*range(len(texts) - 3), None, 500, 501])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(60)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), texts, docs


def test_stages_against_plain_python(tables, spark):
    folder, texts, docs = tables
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    at = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, folder)
        if name != "best-fit packing":
            assert at.columns == docs.columns
        at.write.parquet(f"{folder}/stage-{len(seen)}")
        at = spark.read.parquet(f"{folder}/stage-{len(seen)}")
        seen.append({r.doc_id: r.text for r in at.collect()} if name != "best-fit packing" else at.collect())
    clean, lines, single, safe, packed = seen
    assert not {i for i in range(90) if i % 4 == 0} & clean.keys() and {i for i in range(90) if i % 4} <= clean.keys()
    keys = {}
    for t in clean.values():
        for k in {x.strip().lower() for x in (t or "").split("\n")}:
            keys[k] = keys.get(k, 0) + 1
    assert lines == {i: "\n".join(x for x in (t or "").split("\n") if not x.strip() or keys[x.strip().lower()] < 10) for i, t in clean.items()}
    assert any("subscribe" in (t or "") for t in clean.values()) and not any("subscribe" in t for t in lines.values())
    groups = {}
    for i, t in lines.items():
        s = ngram_join.token_sets([t], 5)[0]
        home = next((g for g in groups if len(s) and len(groups[g]) and len(set(s) & set(groups[g])) >= 0.8 * len(set(s) | set(groups[g]))), None)
        home = home if home is not None else next((g for g in groups if lines[g] == t), i)
        groups.setdefault(home, s)
    assert len(single) == len(groups)
    assert set(safe) == {i for i in single if i not in (92, 93)}
    wanted = sorted(len(packing._encoder(tokenizer()).encode(t or "")) // 4 + 1 for t in safe.values())
    by_doc = {}
    for r in packed:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
    assert sorted(by_doc.values()) == wanted
    assert corpus_pipeline.run(spark, folder).count() == len(packed)


def test_queries_read_whole_tables(tables, spark):
    folder, texts, _ = tables
    assert QUERIES["op1_ngram_join"](spark, folder).count() == len(texts)
    assert {r.doc_id for r in QUERIES["op7_decontamination"](spark, folder).collect()} == {92, 93}
    held = QUERIES["op5_toxicity"](spark, folder).collect()
    assert len(held) == len(texts) and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert toxicity.THRESHOLD == 0.3 and decontaminate.SIMILARITY == 0.8
