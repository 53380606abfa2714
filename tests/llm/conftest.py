import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture
def make_docs(spark):
    """Documents with extra columns whose names operators might want for themselves."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", len(t) if t is not None else None, "x", 7, None) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, KEY int, line_t1 string")

    return make


@pytest.fixture
def rng():
    return random.Random(11)
