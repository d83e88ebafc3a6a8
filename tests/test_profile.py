"""Skill profile (Q1) and summary (Q1b): decisions D1, D3-D5, D6, D8, D10, D17."""

import itertools
from collections import Counter

import pytest

from conftest import make_postings
from skillmesh.operators.profile import profile_summary, skill_frequency, skill_profile


def rows(df):
    return [tuple(r) for r in df.collect()]


def rule_profile(postings_rows, title, country, k):
    """Independent statement of the profile rules in plain Python."""
    tl, cl = title.lower(), country.lower()
    tokens = []
    jobs = 0
    for t, c, s in postings_rows:
        if t is None or c is None or tl not in t.lower() or cl not in c.lower():
            continue
        jobs += 1
        if s is None:
            continue
        import re

        for x in re.split(r",[ \t\n\x0b\f\r]*", s.strip(" ")):
            x = x.strip(" ")
            if x:
                tokens.append(x)
    freq = Counter(tokens)
    total = sum(freq.values())
    ranked = sorted(freq.items(), key=lambda kv: (-kv[1], kv[0].encode()))[:k]
    shares = [round(f / total * 100, 2) for _, f in ranked]
    listed = [[i + 1, s, f, p] for i, ((s, f), p) in enumerate(zip(ranked, shares))]
    rest = total - sum(f for _, f in ranked)
    other_share = round(100 - seq_sum(shares), 2)
    if rest > 0 and other_share > 0:
        listed.append([len(listed) + 1, "Other Skills", rest, other_share])
    listed_sum = seq_sum(r[3] for r in listed)
    if listed and listed_sum != 100:
        top = max(range(len(listed)), key=lambda i: (listed[i][3], -i))
        listed[top][3] = round(listed[top][3] + (100 - listed_sum), 2)
    return [tuple(r) for r in listed], (jobs, len(freq), total, seq_sum(r[3] for r in listed))


def seq_sum(values):
    """Left-to-right float sum (``sum()`` before Python 3.12; 3.12+ compensates)."""
    return list(itertools.accumulate(values, initial=0))[-1]


EDGE = [
    ("Dev A", "VN", "x, y, z"),
    ("Dev A", "VN", "x, y, z"),
    ("Dev B", "VN", "a, b,"),
    ("Dev B", "VN", " A ,a,  a "),
    ("Dev C", "VN", None),
    ("Dev C", "VN", ""),
    ("Dev D", "Vietnam", "q"),
    ("Ops", "VN", "x"),
]


@pytest.mark.parametrize(
    "title,country,k",
    [("dev a", "vn", 5), ("dev", "VN", 2), ("dev", "vn", 0), ("dev c", "vn", 3), ("dev", "viet", 1), ("nope", "vn", 3)],
)
def test_profile_matches_rule_on_edge_rows(spark, title, country, k):
    df = make_postings(spark, EDGE)
    expect, (jobs, uniq, total, pct) = rule_profile(EDGE, title, country, k)
    assert rows(skill_profile(df, title, country, k)) == expect
    summ = rows(profile_summary(df, title, country, k))[0]
    assert summ == (jobs, uniq, total, pct, abs(pct - 100) < 0.01)


def test_three_equal_skills_split_33_34(spark):
    df = make_postings(spark, [("t", "c", "a, b, c")])
    got = rows(skill_profile(df, "t", "c", 10))
    assert [r[3] for r in got] == [33.34, 33.33, 33.33]


def test_binary_ties_round_like_python(spark):
    # 1/32 of 100 is exactly 3.125 in binary: Python rounds it to 3.12.
    skills = ", ".join(["a"] * 31 + ["b"])
    df = make_postings(spark, [("t", "c", skills)])
    got = rows(skill_profile(df, "t", "c", 5))
    assert got == [(1, "a", 31, 96.88), (2, "b", 1, 3.12)]


def test_single_skill_is_100(spark):
    df = make_postings(spark, [("t", "c", "a"), ("t", "c", "a")])
    assert rows(skill_profile(df, "t", "c", 5)) == [(1, "a", 2, 100.0)]


def test_k_zero_gives_other_100(spark):
    df = make_postings(spark, [("t", "c", "a, b")])
    assert rows(skill_profile(df, "t", "c", 0)) == [(1, "Other Skills", 2, 100.0)]


def test_no_skills_empty_and_flag_false(spark):
    df = make_postings(spark, [("t", "c", None), ("t", "c", ", ")])
    assert rows(skill_profile(df, "t", "c", 5)) == []
    assert rows(profile_summary(df, "t", "c", 5)) == [(2, 0, 0, 0.0, False)]


def test_no_match_summary_zero(spark):
    df = make_postings(spark, [("t", "c", "a")])
    assert rows(profile_summary(df, "zzz", "c", 5)) == [(0, 0, 0, 0.0, False)]


def test_case_kept_and_blanks_dropped(spark):
    df = make_postings(spark, [("t", "c", " A ,a,  a "), ("t", "c", "a, b,")])
    got = dict((s, f) for s, f in rows(skill_frequency(df, "t", "c")))
    assert got == {"A": 1, "a": 3, "b": 1}


def test_limit_validation(spark):
    df = make_postings(spark, [("t", "c", "a")])
    with pytest.raises(ValueError):
        skill_profile(df, "t", "c", -1)
    with pytest.raises(ValueError):
        skill_profile(df, "t", "c", "ten")
    assert rows(skill_profile(df, "t", "c", "3")) == [(1, "a", 1, 100.0)]


@pytest.mark.parametrize(
    "title,country,k", [("household", "NATION_1", 15), ("urgent", "nation_2", 5), ("a", "n", 40), ("LOW", "NATION_24", 3)]
)
def test_fixture_profiles_match_rule(spark, postings, title, country, k):
    raw = [(r.job_title, r.search_country, r.job_skills) for r in postings.collect()]
    expect, (jobs, uniq, total, pct) = rule_profile(raw, title, country, k)
    got = rows(skill_profile(postings, title, country, k))
    assert got == expect
    assert abs(sum(r[3] for r in got) - 100) < 0.01
    summ = rows(profile_summary(postings, title, country, k))[0]
    assert summ == (jobs, uniq, total, pct, True)


def test_random_profiles_match_rule(spark):
    import random

    rnd = random.Random(11)
    rows_all = []
    cases = []
    for case in range(40):
        n_skills = rnd.randint(1, 12)
        title = f"case{case:02d}"
        for _ in range(rnd.randint(1, 30)):
            picks = [f"s{rnd.randint(0, n_skills)}" for _ in range(rnd.randint(0, 6))]
            rows_all.append((title, "c", ", ".join(picks) if picks else None))
        cases.append((title, rnd.randint(0, 8)))
    df = make_postings(spark, rows_all).cache()
    for title, k in cases:
        expect, (jobs, uniq, total, pct) = rule_profile(rows_all, title, "c", k)
        assert rows(skill_profile(df, title, "c", k)) == expect, (title, k)
        assert rows(profile_summary(df, title, "c", k))[0] == (jobs, uniq, total, pct, abs(pct - 100) < 0.01)


def test_large_k_path_without_broadcast(spark, postings, monkeypatch):
    from skillmesh.operators import profile as prof

    expect = rows(skill_profile(postings, "household", "NATION_1", 15))
    monkeypatch.setattr(prof, "TOPK_BROADCAST_ROWS", 1)
    q = skill_profile(postings, "household", "NATION_1", 15)
    assert rows(q) == expect
