"""The operators that SQL cannot express, against plain versions on odd rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import public_tokenizers

from skillmesh.llm import bagminhash, bpe, decontamination, pii, substring_dedup, token_output
from skillmesh.llm.common import WordHashes, split_words

from .conftest import invented, odd_rows


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_equals_the_library_and_decodes(spark, odd, ranks):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(odd, ranks, public_tokenizers.PATTERN, block_chars=3000), ranks)
    want = [(i, library.encode_ordinary(t or ""), bytearray((t or "").encode())) for i, t in odd_rows()]
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_bpe_of_parts_with_white_space_at_their_ends(ranks):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(12)
    texts = ["the end\n", "Title \nbar x", "x ", " \t", " ", "a \u00a0b", "a\x1c \x1cb ", "last x"]
    texts += ["".join(rng.choice(["a", "b1", " ", "\n", "\t", "'s", "\u3000"]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    block = bpe._Block(bpe.Merges(ranks), public_tokenizers.PATTERN)
    for i, text in enumerate(texts):
        block.add(i, text)
    assert block.rows().column(1).to_pylist() == [library.encode_ordinary(t) for t in texts]


def test_bpe_digests(odd, ranks):
    got = bpe.digests(bpe.decode(bpe.encode(odd, ranks, public_tokenizers.PATTERN), ranks)).where("doc_id = 0").first()
    assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())


def test_bpe_of_an_empty_table(nothing, ranks):
    assert bpe.decode(bpe.encode(nothing, ranks, public_tokenizers.PATTERN), ranks).count() == 0


def test_heap_and_fold_merge_alike(ranks):
    rng = random.Random(8)
    words = [bytes(rng.choice(b"abcthe \xc3\xa9") for _ in range(rng.randint(2, 40))) for _ in range(400)]
    ids, n = bpe.Merges(ranks).encode(words)
    ends = np.cumsum(n)
    for w, k, e in zip(words, n, ends, strict=True):
        assert ids[e - k : e].tolist() == ([ranks[w]] if w in ranks else bpe.merge_long(w, ranks))


# Token output


def test_blocks_are_patched_and_read_singly():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 127, 128, 129, 1000])
    ids = rng.integers(0, 300, counts.sum())
    ids[::17] = 49_000  # exceptions
    ids[-1] = 2**32 - 1
    indexes, payloads = token_output.pack(ids, counts)
    back, n = token_output.unpack_many(payloads, indexes)
    assert back.tolist() == ids.tolist() and n.tolist() == counts.tolist()
    starts = np.frombuffer(indexes[-1], "<u4")
    assert token_output.unpack_block(payloads[-1], int(starts[3])).tolist() == ids[-1000:][3 * 128 : 4 * 128].tolist()
    assert len(b"".join(payloads)) < 2 * counts.sum()


def test_written_ids_equal_the_library(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(file)
    path = str(tmp_path / "tokens")
    with open(file, encoding="utf-8") as f:
        token_output.write_tokens(odd, f.read(), path, shards=4)
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in odd_rows()]
    assert sorted(((r.doc_id, list(r.ids)) for r in token_output.read_ids(spark, path).collect()), key=repr) == sorted(want, key=repr)
    rows = token_output.digests(spark, path).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted(
        (str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want
    )
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)


def test_written_special_strings_are_the_library_s(spark, tmp_path):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(file)
    rows = [(1, "a <|endoftext|> b"), (2, "x<|startoftext|>y <|END|> <|endoftext|>")]
    with open(file, encoding="utf-8") as f:
        token_output.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), f.read(), str(tmp_path / "special"))
    got = {r.doc_id: list(r.ids) for r in token_output.read_ids(spark, str(tmp_path / "special")).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in rows} and got[1] == [320, 49407, 321, 1]


def test_words_of_plain_texts_are_the_library_s():
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        assert token_output.plain_file(vocabulary) and not token_output.plain_file(f.read())
    library, encoder = Tokenizer.from_str(vocabulary), token_output.WordEncoder(vocabulary)
    rng = random.Random(1)
    some = [chr(c) for c in range(33, 256)] + [*"ǅİſßẞΣςé́漢①²½  \n\t\r\x00\x02\x1c\x85\xa0", "'s", "'T", "'re", "<|endoftext|>", "<|", "É"]
    for size in (30, 4):
        texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, size))) for _ in range(4000)]
        ids, n = encoder.encode(texts, 1)
        want = [e.ids + [1] for e in library.encode_batch(texts, add_special_tokens=False)]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for own in want for i in own]


def test_rows_of_one_id_are_divided_among_shards(spark, tmp_path):
    rows = [(7 if i % 3 else i, f"text {i} of it " * (1 + i % 4)) for i in range(300)] + [(None, f"no id {i}") for i in range(150)]
    path = str(tmp_path / "hot")
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        token_output.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), f.read(), path, shards=9)
    shards = token_output.read_tokens(spark, path).groupBy("shard").count().collect()
    assert len(shards) > 6 and max(r["count"] for r in shards) < 150
    found = sorted(token_output.digests(spark, path).collect(), key=lambda r: r.start)
    assert len(found) == 450 and [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert ids == sorted(ids)


def test_written_empty_table(spark, nothing, tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        token_output.write_tokens(nothing, f.read(), str(tmp_path / "none"))
    assert token_output.digests(spark, str(tmp_path / "none")).count() == 0


# Substring dedup


@pytest.mark.parametrize("group", [2048, 1])
def test_substring_dedup_equals_a_dictionary_of_windows(odd, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    got = [tuple(r) for r in substring_dedup.digests(substring_dedup.dedup(odd)).collect()]
    rows = odd_rows()
    want = [(i, *x) for (i, _), x in zip(rows, substring_dedup.brute_force([t or "" for _, t in rows]), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[2] for r in got) > 500


def test_substring_dedup_of_an_empty_table(nothing):
    assert substring_dedup.dedup(nothing).count() == 0


def test_substring_dedup_of_many_equal_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text)] * 3000 + [(5, text)] * 1000 + [(6, "own words " * 30)]
    got = substring_dedup.digests(substring_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    want = substring_dedup.brute_force([text, text, rows[-1][1]])
    assert len(got) == 4001
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == {(i, *w) for i, w in zip((None, 5, 6), want, strict=True)}


# Near duplicates


def plain_classes(texts: dict[int, str]) -> dict[int, int]:
    """The least id of each class, from all pairs."""
    grams = {}
    for i, t in texts.items():
        w = t.split()
        k = min(5, len(w))
        grams[i] = collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else collections.Counter()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            if i < j:
                a, b = grams[i], grams[j]
                both, all_ = (a & b).total(), (a | b).total()
                if (both >= 0.8 * all_) if all_ else True:
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_near_duplicates_equal_all_pairs_on_odd_rows(odd):
    texts: dict[int, str] = {}
    for i, t in odd_rows():
        if i is not None:
            texts[i] = min(texts.get(i, t or ""), t or "")
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(odd).collect()}
    assert got == plain_classes(texts)


def test_near_duplicates_in_a_large_group(spark):
    rng = random.Random(3)
    base = invented(rng, 300).split()
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        texts[i] = " ".join(w)
    texts |= {1000 + i: invented(rng, 200) for i in range(50)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs).collect()}
    assert got == plain_classes(texts)


def test_near_duplicates_isolated_pairs_among_texts_of_one_template(spark):
    rng = random.Random(31)
    base = [f"w{k}" for k in range(300)]
    texts, want = {}, {}

    def changed(words, n):
        out = list(words)
        for k in rng.sample(range(10, 290), n):
            out[k] = f"own{rng.random()}"
        return out

    for i in range(1500):
        own = changed(base, 8)
        texts[i], want[i] = " ".join(own), i
        if i % 15 == 0:
            other = changed(own, 6)
            sets = [bagminhash.shingles(WordHashes().of([w.encode() for w in x])) for x in (own, other)]
            texts[5000 + i], want[5000 + i] = " ".join(other), i if bagminhash.overlap(*sets) >= 0.8 else 5000 + i
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert sum(want[i] != i for i in want) > 50
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs).collect()} == want


def kept_rows(rows: list[tuple]) -> list[tuple]:
    """Of all rows (id, text) one of each class, the least id's (none last), from all pairs."""
    nodes = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    classes = plain_classes({k: t for k, (_, t) in enumerate(nodes)})
    return [nodes[k] for k, root in classes.items() if k == root]


def test_keep_one_keeps_columns_and_one_row_of_each_class(odd):
    kept = bagminhash.keep_one(odd)
    assert kept.columns == odd.columns
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr)
    assert got == sorted(kept_rows(odd_rows()), key=repr)
    # The copy without an id goes, the text of its own stays.
    assert [t for i, t in got if i is None] == ["no id"]


def test_keep_one_compares_rows_not_ids(spark):
    a, b = (invented(random.Random(k), 60) for k in (1, 2))
    for rows in ([(1, a), (5, a), (5, b)], [(1, a), (2, a), (2, a), (3, b)], [(5, a), (5, a), (5, a)], [(None, a), (None, a), (None, b)]):
        kept = bagminhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted(kept_rows(rows), key=repr), rows


def test_near_duplicates_leave_no_scratch_behind(spark, odd):
    import os

    from skillmesh.session import checkpoint_dir

    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    bagminhash.near_duplicates(odd)
    assert [x for x in set(os.listdir(folder)) - before if "near-duplicates" in x] == []


def test_near_duplicates_of_an_empty_table(nothing):
    assert bagminhash.near_duplicates(nothing).count() == 0


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(0)
    items = np.unique(rng.integers(0, 2**62, 250).astype(np.uint64))
    w1 = rng.integers(1, 12, len(items))
    w2 = np.maximum(1, w1 + rng.integers(-3, 4, len(items)))
    exact = bagminhash.overlap((items, w1), (items, w2))
    shares = []
    for salt in range(60):
        own = items ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**63)
        a, b = bagminhash.signatures([(own, w1), (own, w2)])
        shares.append((a == b).mean())
    assert abs(np.mean(shares) - exact) < 0.025


# Benchmark decontamination


def edits(pattern: bytes, text: bytes) -> int:
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != d), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)


def test_decontamination_equals_alignment_of_all_segments(spark, odd):
    rng = random.Random(6)
    items = [(k, invented(rng, n, 60)) for k, n in enumerate((12, 20, 30, 45, 60))] + [(9, None), (10, ""), (11, "too short"), (None, "no id at all " * 9)]
    docs = [(100 + k, invented(rng, 30)) for k in range(6)]
    for k in range(24):
        text = list(rng.choice(items[:5])[1].upper())
        for _ in range(rng.randint(0, 14)):
            text[rng.randrange(len(text))] = rng.choice(["", "q", "zz", " ", "-"])
        docs.append((200 + k, invented(rng, 20) + "".join(text) + invented(rng, 20)))
    docs += [(200, docs[10][1]), (None, docs[11][1]), (300, None), (301, ""), (302, "a\0b " + items[2][1])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    index = decontamination.Index([(i, t or "") for i, t in items if i is not None])
    want = []
    for i, t in docs:
        text = decontamination.normalised([t or ""])[1:].tobytes()
        for item in range(5):
            found = [edits(index.bytes[s, : index.length[s]].tobytes(), text) for s in np.flatnonzero(index.item == item)]
            near = [e for s, e in zip(np.flatnonzero(index.item == item), found, strict=True) if e <= index.budget[s]]
            if near:
                want.append((i, item, len(near), min(near)))
    assert len(want) > 15
    assert sorted_rows(decontamination.find(frame, benchmark)) == sorted(want, key=repr)
    kept = {r.doc_id for r in decontamination.remove(frame, benchmark).collect()}
    assert kept == {i for i, _ in docs} - {w[0] for w in want} | ({None} if None not in {w[0] for w in want} else set())
    assert decontamination.remove(odd, benchmark).count() == odd.count()


def holding(items: list[str], texts: list[str]) -> set[tuple[int, int]]:
    return {(t, i) for t, i, *_ in decontamination.Index(list(enumerate(items))).search(texts)}


def test_decontamination_finds_short_items_between_word_borders():
    items = ["What is the capital of France?", "a b", "Yes", "capital", "the capital of France is here today"]
    texts = ["So: what is the CAPITAL of France", "yes", "eyes b a", "what is the capital of Frances", "x a, b", ""]
    assert holding(items, texts) == {(0, 0), (0, 3), (1, 2), (3, 3), (4, 1)}


def test_decontamination_finds_copies_with_replaced_words_and_verbatim_parts():
    rng = random.Random(21)
    items, texts = [], []
    for k in range(60):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(6 + k % 30)]
        items.append(" ".join(words))
        # One word of six letters in the middle, every eighth word in longer items, is another one.
        changed = ["zzzzzz" if i == len(words) // 2 % 8 + i // 8 * 8 and (i < 8 or len(words) > 17) else w for i, w in enumerate(words)]
        if len(words) < 10:
            changed = [*words[: len(words) // 2], words[len(words) // 2][:3] + "zzz", *words[len(words) // 2 + 1 :]]
        texts.append(invented(rng, 15) + " " + " ".join(changed) + " " + invented(rng, 15))
    long = [k for k in range(60) if len(items[k]) > 140]
    texts += [invented(rng, 15) + items[k][c : c + 64] + invented(rng, 15) for k in long for c in range(3, 70, 7)]
    want = {(k, k) for k in range(60)} | {(60 + i, k) for i, k in enumerate(k for k in long for _ in range(3, 70, 7))}
    got = holding(items, texts)
    assert got == want


def test_decontamination_aligns_no_item_across_two_texts():
    item = " ".join(f"word{k}" for k in range(30))
    assert holding([item[:60]], ["x " + item[:30], item[30:60]]) == set()


def test_repeated_items_count_once(spark, odd):
    items = [(1, odd_rows()[8][1][:300]), (1, odd_rows()[8][1][:300]), (2, "one")]
    once, thrice = (spark.createDataFrame(x, "item_id bigint, text string") for x in (items[1:], items * 3))
    assert sorted_rows(decontamination.find(odd, once)) == sorted_rows(decontamination.find(odd, thrice)) != []


def test_decontamination_in_blocks_and_on_empty_tables(spark, odd, nothing, monkeypatch):
    text = odd.where("doc_id = 9").first().text
    benchmark = spark.createDataFrame([(k, text[200 * k : 200 * k + 150]) for k in range(8)], "item_id bigint, text string")
    whole = sorted_rows(decontamination.find(odd, benchmark).select("doc_id", "item_id"))
    assert {i for _, i in whole} == set(range(8))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 300)
    assert sorted_rows(decontamination.find(odd, benchmark).select("doc_id", "item_id")) == whole
    assert decontamination.find(nothing, benchmark).count() == 0
    assert decontamination.find(odd, benchmark.where("false")).count() == 0


# Personal data


def plain_spans(text: str) -> dict:
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    find = lambda p, good: [m.span() for m in re.finditer(p, text) if good(m)]
    return {
        "email": find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": find(r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
        "phone": find(r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(6000):
        text = "".join(rng.choice("a.@1239+-( )%\n é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    card = "4111 1111 1111 1111"
    assert pii.base_spans(f"x {card} y")["card"] == [(2, 21)]


def test_base_spans_take_linear_time_on_long_runs():
    text = "a" * 300_000 + "1" * 300_000 + "@" + "." * 100
    assert pii.base_spans(text) == {k: [] for k in pii.KINDS}


@pytest.fixture(scope="module")
def tagger(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return pii.fit(docs, max_windows=1500, steps=150)


def test_tagger_adds_spans_and_keeps_base_ones(spark, odd, tagger):
    docs = spark.createDataFrame([(1, "the and of " * 4 + "call (487) 555-7209 now " + "of the and " * 5), (2, "plain words only")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pii.digests(pii.find(docs, tagger)).collect()}
    assert rows[1].n_phone == 0 and rows[1].spans.startswith("phone:") and rows[2].spans == ""
    for r in pii.find(odd, tagger).collect():
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    got = {r.doc_id: r for r in pii.digests(pii.find(odd, tagger)).collect()}
    text = dict(odd_rows())[19]
    base = plain_spans(text)
    want = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
    assert (got[19].n_email, got[19].n_ip, got[19].n_card, got[19].n_phone) == (1, 1, 1, 1)
    assert got[19].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_tags_do_not_depend_on_neighbouring_texts(tagger):
    texts = [t or "" for _, t in odd_rows()]
    together = tagger.tags_of(texts, group=7)
    for t, own in zip(texts, together, strict=True):
        alone = tagger.tags(t)
        assert (alone is None) == (own is None) and (own is None or (alone == own).all())


def test_tags_equal_enumerated_ones():
    """Decoding a window gives the best of all tag sequences."""
    import itertools

    tagger = pii.Tagger(hidden=3)
    rng = np.random.default_rng(5)
    tagger.p["t"] = rng.normal(size=tagger.p["t"].shape).astype(tagger.p["t"].dtype)
    x = rng.integers(0, pii.CLASSES, (3, 4))
    moves = tagger.p["t"] + tagger.allowed
    for row, got in zip(tagger.emissions(x)[0], tagger.decode(x), strict=True):

        def total(tags, row=row):
            return tagger.first[tags[0]] + sum(row[i, t] for i, t in enumerate(tags)) + sum(moves[a, b] for a, b in itertools.pairwise(tags))

        best = max(itertools.product(range(pii.TAGS), repeat=4), key=total)
        assert total(tuple(int(t) for t in got)) == pytest.approx(total(best), abs=1e-4)


def test_spans_take_linear_time_and_touch_no_base_span():
    import time

    text = "1.2.3.4 x " * 20_000
    base = pii.base_spans(text)
    tags = np.zeros(len(text), np.int64)
    tags[8::10] = 1
    began = time.process_time()
    spans = pii.all_spans(text, tags, base)
    assert time.process_time() - began < 10 and set(base["ip"]) <= set(spans["ip"])
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("1234.+- @ab") for _ in range(60))
        base, tags = pii.base_spans(text), np.array([rng.choice([0, 0, 1, 2, 2, 7, 8, 8]) for _ in text])
        got, taken = pii.all_spans(text, tags, base), [s for own in base.values() for s in own]
        for kind in pii.KINDS:
            assert got[kind] == sorted(got[kind]) and set(base[kind]) <= set(got[kind])
            for a, b in set(got[kind]) - set(base[kind]):
                assert not any(s < b and a < e for s, e in taken), text


def test_spelled_out_places_get_a_window():
    for text in ("write to ann AT corp DOT com now", "ann ( at ) corp ( dot ) com", "alexandra.maximiliana-longname at somewhere dot org"):
        assert pii.windows_of(text), text
    assert pii.windows_of("we met at the station at noon") == []


def test_training_sends_windows_not_texts():
    x, y, context = pii.text_windows("of the " * 200 + "call +1 (487) 555-7209 " * 300, 5)
    assert x.shape == y.shape == (pii.WINDOWS_A_TEXT, pii.WIDTH) and len(context) <= pii.CONTEXT_CHARS and y.max() > 0
    x, y, context = pii.text_windows("", 5)
    assert len(x) == 0 and context == ""


def test_gradients_agree_with_differences():
    tagger = pii.Tagger(hidden=4)
    rng = np.random.default_rng(0)
    x = rng.integers(0, pii.CLASSES, (2, 9))
    y = np.array([[0, 1, 2, 2, 0, 3, 4, 0, 0], [5, 6, 6, 0, 0, 0, 7, 8, 8]])
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    _, grads = tagger.gradients(x, y)
    for k in ("hf", "xb", "w", "t", "cb"):
        at = tuple(int(rng.integers(0, s)) for s in tagger.p[k].shape)
        if k == "xb":
            at = (int(x[0, 3]), at[1])
        was = tagger.p[k][at]
        tagger.p[k][at] = was + 1e-2
        up = tagger.gradients(x, y)[0]
        tagger.p[k][at] = was - 1e-2
        down = tagger.gradients(x, y)[0]
        tagger.p[k][at] = was
        assert abs((up - down) / 2e-2 - grads[k][at]) < 2e-3, k


def test_mask_replaces_the_data(odd, nothing, tagger):
    masked = pii.mask(odd, tagger)
    assert masked.columns == odd.columns
    rows = {r.doc_id: r.text for r in masked.collect()}
    assert rows[0] is None and rows[19].startswith("mail <email> or <phone>, <ip>, card <card>")
    assert rows[5] == dict((i, t) for i, t in odd_rows())[5]
    assert pii.find(nothing, tagger).count() == 0


def test_tagged_addresses_hold_an_at():
    for found in ("ann at host dot com", "ann(at)host.com", "ANN [AT] host dot org", "ann.12@host1.example.com", "ann_at_host.net"):
        assert pii._plausible("email", found), found
    for found in ("rsoro1 usnr1 soaauu2. oru", "patch.com", "at1 dot com"):
        assert not pii._plausible("email", found), found


# Word hashes


def test_word_hashes_stay_right_after_forgetting():
    few, many = WordHashes(most=3), WordHashes()
    words = [str(k % 7).encode() for k in range(100)]
    assert few.of(words).tolist() == many.of(words).tolist() and len(few) <= 3
    assert split_words("a\x0b\x0cb\u00a0c \r\n") == [b"a", "b\u00a0c".encode()]


def test_rank_file_is_read_whole(ranks):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        first = f.readline().split()
    assert ranks[base64.b64decode(first[0])] == int(first[1]) and len(ranks) == 50256


def test_leaving_out_thin_bands_loses_no_match():
    """Passages anywhere in a text, its ends too, are found in one run of texts as in a run of each."""
    rng = random.Random(4)
    items = [(i, "".join(rng.choice("abcdefgh ") for _ in range(60 + 9 * i))) for i in range(30)]
    index = decontamination.Index(items)
    texts = []
    for i, t in items:
        texts += [t, t[:30] + "z" + t[31:], "x" * (i * 7) + " " + t, t + " " + items[i - 1][1]]
    found = {(n, i) for n, i, _, _ in index.search(texts)}
    for i, _ in items:
        assert {(4 * i + k, i) for k in range(4)} <= found and (4 * i + 3, (i - 1) % 30) in found
    alone = {(n, i) for n, t in enumerate(texts) for _, i, _, _ in index.search([t])}
    assert alone == found
