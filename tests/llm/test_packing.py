import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a  b \n\n c", "don't I'll x'tail", "tab\tand\x0bfeed", "é\u00a0ü ñandú über straße.", "中文 текст ελλ", "<|endoftext|> x",
         "!?.,;.. a.b,c  .", "\u2028x \x1c y", "Ends with blank ", "\n", "word " * 3000, "ab" * 5000, "1234 5.6e7 x1y2"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abZé'ñ. ,\n\t0!\u00a0ſK中")), max_size=40))
def test_ids_are_the_tokenizers(text):
    e = packing._encoder(PATH)
    assert np.frombuffer(e.encode(text), dtype="<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


def test_pack(make_docs, tokenizer, rng):
    texts = TEXTS + [" ".join(["lorem"] * rng.randrange(1, 900)) for _ in range(150)] + ["same"] * 5
    docs = make_docs(texts, [None, 5, 5, *range(3, len(texts))]).repartition(5)
    rows = packing.pack(docs, PATH, open_bins=8).collect()
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for t in texts]
    want = sorted((len(x), zlib.crc32(x[s:s + n].tobytes()), k, s, n) for x in ids for k, (s, n) in enumerate(packing.pieces_of(len(x), 2048)))
    totals = defaultdict(int)
    for r in rows:
        totals[r.doc_id, r.start + r.length] += r.length
    assert sorted((r.ids_crc32, r.piece, r.start, r.length) for r in rows) == sorted(w[1:] for w in want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.1 * sum(map(len, ids)) / 2048 + 2


def test_pieces():
    assert packing.pieces_of(2048, 2048) == [(0, 2048)]
    assert packing.pieces_of(4100, 2048) == [(0, 4), (4, 2048), (2052, 2048)]
    assert packing.pieces_of(4096, 2048) == [(0, 2048), (2048, 2048)]


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert fit.place(6) == (0, 0) and fit.place(7) == (1, 0)
    assert fit.place(3) == (1, 7)  # exactly full, closed
    assert fit.place(5) == (2, 0) and fit.place(8) == (3, 0)  # bin 0 holds six and closes
    assert fit.place(2) == (3, 8) and fit.place(4) == (2, 5) and fit.last() == {2: 9}


def test_empty_table(make_docs):
    assert packing.pack(make_docs([]), PATH).count() == 0
