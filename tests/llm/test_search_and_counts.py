"""Hard negatives, token counts and ranked search against plain versions on odd rows."""

import random

import numpy as np
import pytest

import public_tokenizers

from pyspark.sql import functions as F
from skillmesh.llm import hard_negatives, lexical_search, registry, token_counts

from .conftest import CLASHES, invented, odd_rows


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Hard negatives


def vectors_of(n: int, seed: int = 5, hot: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 0.4) for _ in range(24)] for _ in range(5)]
    rows = []
    for i in range(n):
        label = rng.randrange(5)
        rows.append((i, label, [c + rng.gauss(0, 0.5) for c in centers[label]]))
    for i in range(hot):  # one vector on many rows, of two labels
        rows.append((n + i, i % 2, rows[7][2]))
    return rows


def odd_vectors() -> list[tuple]:
    nan, inf = float("nan"), float("inf")
    rows = vectors_of(260, hot=90)
    rows += [(400, None, rows[0][2]), (500, 1, None), (501, 1, [1.0, nan]), (502, 1, [inf] * 24), (503, 1, [1.0, None]), (None, 1, rows[3][2])]
    rows += [(600, 2, []), (601, 2, rows[9][2][:7]), (602, 0, rows[9][2] + [1.0, -2.0]), (700, 3, rows[9][2][:5])]
    rows += [rows[11], rows[11], rows[20], (20, 4, rows[21][2]), (800, 77, rows[13][2]), (-100, 2, rows[14][2])]
    return rows


def clashing(spark, rows):
    names = ["score", "rank", "ints", "anchor", "row_id", "summary", *CLASHES[:3]]
    schema = "vec_id bigint, label int, vector array<double>, " + ", ".join(f"`{c}` string" for c in names)
    return spark.createDataFrame([(*r, *[None] * len(names)) for r in rows], schema).repartition(4)


def expected(rows, every: int):
    whole = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, label, [int(np.floor(256 * x)) for x in v]))
    return hard_negatives.brute_force(whole, {i for i, *_ in whole if i % every == 0})


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_all_scores_on_odd_rows(spark, monkeypatch, small):
    if small:  # several blocks of anchors, runs of a few rows, pools settled often
        for name, value in (("BLOCK_BYTES", 4000), ("CELLS", 50), ("POOL", 20)):
            monkeypatch.setattr(hard_negatives, name, value)
    got = hard_negatives.hard_negatives(clashing(spark, odd_vectors()), F.col("vec_id") % 20 == 0)
    want = expected(odd_vectors(), 20)
    assert len(want) > 200 and rows_of(got) == sorted(want, key=repr)


def test_hard_negatives_of_an_empty_table(spark):
    got = hard_negatives.hard_negatives(clashing(spark, odd_vectors()).where("false"), F.col("vec_id") % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and not got.collect()


def test_summaries_bound_every_score():
    rng = np.random.default_rng(2)
    for length in (1, 3, 16, 50):
        ints = rng.integers(-300, 300, (40, length))
        exact = ints @ ints.T
        for mean, dev in hard_negatives.summaries(ints):
            middle, reach = mean @ mean.T, dev @ dev.T
            assert (exact <= middle + reach + 1e-6).all() and (exact >= middle - reach - 1e-6).all()


def test_finer_levels_leave_fewer_pairs():
    ints = np.array([[int(256 * x) for x in v] for _, _, v in vectors_of(200)])
    reach = [float((d @ d.T).mean()) for _, d in hard_negatives.summaries(ints)]
    assert reach == sorted(reach, reverse=True) and reach[-1] < 0.9 * reach[0]


def test_bounds_spare_exact_scores_of_smooth_vectors(monkeypatch):
    rng = np.random.default_rng(4)
    ints = np.repeat(rng.integers(-200, 200, (400, 4)), 8, axis=1) + rng.integers(-4, 5, (400, 32))
    flat = np.concatenate([np.concatenate(x, axis=1) for x in hard_negatives.summaries(ints)], axis=1).astype(np.float32)
    rows = hard_negatives.Rows(np.arange(400), np.arange(400) % 3, ints, flat)
    computed = []
    plain = hard_negatives.scores
    monkeypatch.setattr(hard_negatives, "scores", lambda a, b: computed.append(len(a) * len(b)) or plain(a, b))
    exact = ints[:4] @ ints.T
    low = np.array([[np.sort(own)[-20]] for own in exact])  # near the answer, as the anchors' own search leaves it
    best = hard_negatives.Best(low, np.full((4, 1), hard_negatives.FAR), 5)
    hard_negatives.search(rows.some(np.arange(4)), np.arange(4), rows, False, best)
    best.settle()
    assert sum(computed) < 0.5 * exact.size
    for a in range(4):
        order = sorted((-exact[a, r], r) for r in range(400) if r % 3 != a % 3)[:5]
        assert sorted(zip(-best.score[best.slot == a], best.row[best.slot == a], strict=True)) == order


def test_scores_beyond_doubles_are_exact():
    a = np.array([[2**30 + 1, 3]])
    assert hard_negatives.scores(a, a)[0, 0] == (2**30 + 1) ** 2 + 9


# Token counts


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        return file.read()


def plain_counts(vocabulary, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(vocabulary.decode())
    return sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 17), (500, 40)])
def test_counts_equal_the_library(spark, odd, vocabulary, sizes):
    assert rows_of(token_counts.counts(odd, vocabulary, *sizes)) == plain_counts(vocabulary, odd_rows())


def test_special_strings_and_limit(spark, vocabulary):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 30), (3, "x " * 1023 + "x"), (4, "x " * 1024 + "x"), (5, None)]
    got = token_counts.within_limit(spark.createDataFrame(rows, "doc_id bigint, text string"), vocabulary, 1024)
    found = {r.doc_id: (r.n_tokens, r.over_limit) for r in got.collect()}
    assert [(i, *r[1:]) for i, r in enumerate(plain_counts(vocabulary, rows[:4]))] and found[5] == (0, False)
    assert found[2][0] == 30 and {i: n for i, (n, _) in found.items()} == {i: n for i, _, n in plain_counts(vocabulary, rows)}
    assert all(over == (n > 1024) for n, over in found.values()) and {over for _, over in found.values()} == {True, False}


def test_pieces_are_safe(vocabulary):
    count, rng = token_counts.counter(vocabulary), random.Random(3)
    some = ["a", "bc", "1", "'s", "'", " ", "  ", "\n", "\t", "　", "\x85", "é", "漢", "<|endoftext|>", "!", "\x1c", "<|endof", "😀", " "]
    for _ in range(1500):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 40)))
        parts = list(token_counts.pieces(text.encode(), rng.randint(1, 9)))
        assert b"".join(parts) == text.encode()
        assert sum(count([p.decode() for p in parts])) == sum(count([text])), repr(text)


def test_only_files_with_the_proven_pattern_are_cut(vocabulary):
    assert token_counts.cuts_safely(vocabulary)
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as file:
            assert not token_counts.cuts_safely(file.read())


def test_counts_by_a_sentencepiece_model(spark, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as file:
        got = token_counts.counts(odd, file.read())
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=repr) == sorted(((i, len(model.encode(t or ""))) for i, t in odd_rows()), key=repr)


def test_counts_of_an_empty_table(nothing, vocabulary):
    assert token_counts.within_limit(nothing, vocabulary, 5).collect() == []


# Ranked search


def odd_items() -> list[tuple]:
    rng = random.Random(8)
    texts = [t for _, t in odd_rows() if t and t.split()]
    items = [(k, " ".join(rng.sample(rng.choice(texts).split(), 1) * rng.randint(1, 2) + invented(rng, 6).split())) for k in range(30)]
    return [*items, (90, None), (91, ""), (92, " .,!"), (93, "nowhere-at-all qqqqqq"), (None, texts[0][:40]), (94, "SAME same"), (94, "words two"), (94, "SAME same"), (95, "CAFÉ café naïve 漢字")]


@pytest.mark.parametrize("term_bytes", [lexical_search.TERM_BYTES, 700])
def test_ranks_equal_all_scores(spark, odd, term_bytes, monkeypatch):
    if term_bytes < 1000:  # several blocks of items, small matrices
        monkeypatch.setattr(lexical_search, "CELLS", 40)
        monkeypatch.setattr(lexical_search, "POOL", 30)
    schema = "item_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    items = spark.createDataFrame([(*r, *[None] * len(CLASHES)) for r in odd_items()], schema)
    got = lexical_search.rank_documents(odd, items, 10, term_bytes)
    assert rows_of(got) == sorted(lexical_search.brute_force(odd_rows(), odd_items()), key=repr)


def test_frequencies_do_not_depend_on_runs():
    texts = [t.encode() for _, t in odd_rows()[3:] if t] + [b"", b"a", b" a a-a "]
    terms = ["a", "same", "one", "é", "café", "x" * 5000]
    found = lexical_search.automaton(terms)
    whole = lexical_search.frequencies(iter(texts), found, len(terms), len(texts))
    for most in (1, 30, 5000):
        again = lexical_search.frequencies(iter(texts), found, len(terms), len(texts), most)
        assert all((a == b).all() for a, b in zip(whole, again, strict=True))
    assert whole[0][-3:].tolist() == [0, 1, 3]


def test_long_lengths_do_not_overflow():
    items = lexical_search.Items(np.array([1]), np.array([0]), np.array([0]), np.array([1]), 2**40, 2**50, np.array([5]))
    n = np.array([2**30])
    assert items.gains(n, np.array([3]), np.array([0]))[0] == items.weight[0] * (3 * 10**9 // (3000 + 8 * (25 + 75 * 2**30 * 2**40 // 2**50)))


def test_ranks_of_empty_tables(spark, odd, nothing):
    items = spark.createDataFrame(odd_items(), "item_id bigint, text string")
    for docs, own in ((nothing, items), (odd, items.where("false"))):
        got = lexical_search.rank_documents(docs, own)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == []


@pytest.mark.parametrize("key", ["op11_hard_negatives", "op13_lexical_search"])
def test_queries_equal_their_sql(spark, key):
    import duckdb

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("embeddings", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    got, want = registry.QUERIES[key](spark, folder), con.sql(registry.ORACLE_SQL[key])
    assert got.columns == want.columns and rows_of(got) == sorted(want.fetchall(), key=repr)
