import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    out = []
    for k in range(words):
        w = "".join(rng.choice(["an", "the", "ou", "ß", "é", "tion", "X", "re"]) for _ in range(rng.randint(1, 3)))
        out.append((w if rng.random() < 0.7 else f"w{rng.randrange(vocabulary)}") + (rng.choice([".", ",", "!"]) if rng.random() < 0.1 else ""))
    return "".join(x + ("\n" if rng.random() < 0.05 else " ") for x in out).strip()


def edge_rows() -> list[tuple]:
    """Nulls, empty and long texts, copies, repeated rows, odd white space, control strings."""
    rng = random.Random(7)
    long = prose(rng, 6000)
    base = prose(rng, 120)
    words = base.split(" ")
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [(5, base), (3, base), (9, near), (1, None), (2, ""), (4, "   \n \t "), (8, long), (12, long + " tail"), (7, "one two"), (6, "One  two"), (7, "one two"), (11, "a\x1cb c<|endoftext|>d e"), (None, "no id " + base), (13, "x" * 5000), (10, "'s\t\tit's  \n\n don't́ Éá KK İ Σ ΑΣ"), (14, None)]
    rows += [(100 + k, prose(rng, rng.randint(1, 300))) for k in range(30)]
    return [(i, t, "en", None, None) for i, t in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3)
