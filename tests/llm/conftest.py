import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, fp long, t string, hub long, item string, found string, start long, score double, part int"
WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "lé") for b in ("la", "mer", "nos", "pir", "tus", "x")]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(["", "", "a", "en", "st"]) + ("." if rng.random() < 0.1 else "") for _ in range(n)]
    return " ".join(w + ("\n" if rng.random() < 0.03 else "") for w in words)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Texts to documents, with columns whose names the operators use inside; pairs give their own id."""
    def make(texts):
        rows = []
        for i, x in enumerate(texts):
            doc_id, text = x if isinstance(x, tuple) else (i, x)
            rows.append((doc_id, text, "en", "s", len(text or ""), 7, "k", 7, "t", 7, "i", "f", 7, 7.0, 7))
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null and repeated ids, null, empty and long texts, repeated rows, ties."""
    long = prose(3000, 5)
    return [None, "", " ", "one", "Two words", (None, prose(120, 1)), (None, None), (7, prose(80, 2)), (7, prose(80, 2)), (7, prose(90, 3)),
            (90, long), (91, long), (92, prose(60, 4) + " " + long[:900]), (93, "x " * 500), (94, "ünï ¿cödé? 日本語 テスト。")]
