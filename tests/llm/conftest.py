import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

#: Names that the operators use inside.
CLASHES = ["ids", "n", "band", "key", "score", "words", "gram", "root", "decoded", "shard", "stats", "host", "rule", "_words", "kept"]


def invented(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = ["".join(rng.choice("aeiounrst") for _ in range(2 + k % 7)) + str(k % 3 or "") for k in range(vocabulary)]
    out = [rng.choice(words) for _ in range(n)]
    return " ".join(w + ("." if i % 11 == 10 else "") + ("\n" if i % 29 == 28 else "") for i, w in enumerate(out))


def odd_rows() -> list[tuple]:
    """Ids and texts: null, empty, blank, short, very long, copies, near copies, repeated rows and ids."""
    rng = random.Random(4)
    base = [invented(rng, n) for n in (40, 80, 200, 700)]
    near = base[3].split(" ")
    near[100] = "changed"
    shared = invented(rng, 60)
    rows = [
        (0, None), (1, ""), (2, " \t\n\x0b "), (3, "one"), (4, "two words"), (5, base[0]), (6, base[1]), (7, base[1]),
        (8, base[2]), (9, base[3]), (10, " ".join(near)), (11, invented(rng, 30) + " " + shared + " " + invented(rng, 30)),
        (12, shared + " " + invented(rng, 50)), (13, "same same same " * 60), (14, "x" * 5000), (15, invented(rng, 30_000, 3000)),
        (16, "naïve café Ωmega 漢字 text\u00a0with\u2003spaces  and\n\n \nlines 😀"), (17, base[2]), (17, base[2]), (18, base[0]), (18, shared),
        (None, base[0]), (None, "no id"), (19, "mail a.b@c.example.com or +1 (487) 555-7209, 10.0.0.1, card 4111 1111 1111 1111."),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with further columns of clashing names."""
    rows = [(*r, "en", "s", len(r[1] or ""), *[None] * len(CLASHES)) for r in odd_rows()]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
