import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, keys string, rep long, spans string, row long, cluster long, h string, c string, c_text string, token string, anchor long, label string, t1 long"


def corpus(n=220, seed=7):
    """Texts with copies, near copies, shared passages and lines, and the odd cases: null, empty, blank, tiny, very long, one word over and over."""
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "su", "ta", "vé", "ß") for b in ("n", "r", "st", "el", "", "ing", "ö", "x", "ro")]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, line = " ".join(words(70)), " ".join(words(14))
    texts = [None, "", "  \n\t ", "a", "A b", "a  b\n", "wow " * 300, "the same\n" * 40, "\x0b x\x0cy\rz ", "UPPER Case ÀÉ ß", " ".join(words(12_000)), "ー" * 50 + " 😀 " + "x" * 3000, "#### *** $$ " * 20]
    while len(texts) < n:
        kind = rng.random()
        body = [" ".join(words(rng.randrange(3, 30))) for _ in range(rng.randrange(1, 8))]
        if kind < 0.15 and len(texts) > 20:
            body = [rng.choice([t for t in texts if t]) if rng.random() < 0.9 else ""]
        elif kind < 0.45 and len(texts) > 20:
            w = rng.choice([t for t in texts if t and 20 < len(t) < 5000]).split(" ")
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            body = [" ".join(w)]
        elif kind < 0.6:
            body.insert(rng.randrange(len(body) + 1), passage)
        elif kind < 0.75:
            body.insert(rng.randrange(len(body) + 1), line)
        elif kind < 0.8:
            body.append("Licensed under the Apache License, Version 2.0.")
        texts.append("\n".join(body))
    order = list(range(n))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns beside them whose names operators use inside."""
    langs = ["en", "fr", None]
    rows = [(i, t, langs[i % 3], f"s{i % 4}" if i % 7 else None, len(t or ""), -1, "k", -1, "s", -1, -1, "h", "c", "ct", "t", -1, "l", -1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
