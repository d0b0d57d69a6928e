import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """docs of texts: ids from 0, or (id, text) pairs; with other columns whose names operators use themselves."""

    def docs(*texts, clash=True, source="s0", lang="en"):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, lang, source, len(t) if t else None) for i, t in pairs], SCHEMA)
        if clash:
            for name in ("host", "kept", "spans", "fp", "score", "component_id", "token_ids", "item_id", "n_tokens", "url", "path", "_gone", "cell"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return docs


@pytest.fixture(scope="session")
def prose():
    """Texts of random words."""

    def text(words, seed, vocabulary=3000):
        r = random.Random(seed)
        return " ".join(_word(r.randrange(vocabulary)) for _ in range(words))

    return text


def _word(n):
    r = random.Random(n)
    return "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 10)))
