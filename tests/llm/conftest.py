import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from ``(doc_id, text)`` pairs, with columns whose names clash with the operators' own."""

    def make(rows, **extra):
        names = {"n_words": "bigint", "key": "string", "class": "string", "score": "double", "n": "string"}
        filled = [(i, t, "en", "s", len(t or ""), None, "k", "c", 0.5, "n") for i, t in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{k}` {v}" for k, v in names.items())
        return spark.createDataFrame(filled, schema)

    return make


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Pairs with exact and near copies, shared passages, repeats, long, empty and null texts."""
    import random

    rng = random.Random(11)
    base = words(rng, 300)
    passage = words(rng, 60)
    rows = [(i, words(rng, rng.choice([1, 2, 3, 5, 34, 35, 36, 80, 200]))) for i in range(60)]
    rows += [(100 + i, base) for i in range(8)]
    for i in range(30):
        w = base.split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, words(rng, 20) + "\n" + passage + "\t" + words(rng, 30)) for i in range(25)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "one"), (405, "One two three"), (406, "one TWO three"), (407, "to " * 200), (408, words(rng, 9000)), (409, "é ü " * 40), (410, "word" * 5000)]
    rows += [(500, passage), (500, passage), (501, base + " tail"), (None, words(rng, 50)), (None, base)]
    rng.shuffle(rows)
    return rows
