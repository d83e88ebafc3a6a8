"""Map free-text job titles to profession names.

Scoring of a cleaned title ``T`` against a keyword ``K`` (lower-cased,
stripped, longer than two characters):

* ``K`` is a substring of ``T`` → ``len(K) / len(T) * 2`` (no threshold);
* otherwise, unless ``K`` is a single token shorter than four characters,
  each token of ``K`` earns 1 if it equals a token of ``T``, else 0.7 if
  it has at least four characters and contains, or is contained in, some
  token of ``T``; the sum divided by the token count, times 1.2 when
  ``K`` has several tokens and the sum is at least 2, counts only when it
  reaches ``threshold``.

The best keyword wins; ties go to the earlier profession, then the earlier
keyword.  Scores are doubles evaluated in that order.

Scale: no title × keyword cross product, nor all pairs that share a token.
Of keywords with the same text the earliest wins, so each text is matched
once.  A text can win a title in three ways:

* ``K`` is a substring of ``T``: the two meet under a prefix of ``K`` at
  least half as long as ``K`` (``substring_keys``);
* two or more tokens of ``K`` match: they meet under a pair of matched tokens
  (``pair_keys``);
* one token matches: the score is then the same for all texts with that token
  and the same number of tokens, so that a title meets only the earliest of
  them (``token_groups``).  Where more tokens match, this score is too low and
  the pair of tokens gives the right one.

The earliest text of a token may be a substring of the title and score less
as such than the others of its group would; and a title may match a great
many tokens.  Such titles meet every keyword that can score
(``candidate_pairs``): ``K``'s first trigram occurs in ``T``, a token of
``K`` equals a token of ``T``, a long token of ``K`` has its first trigram in
``T``, or a token of ``T`` is a substring of a long token of ``K``.  Titles
emit their trigrams and tokens as probe keys, keywords emit the matching
keys.  A pair that shares several keys is scored under its rarest key by the
number of keywords that have it (a keyword's keys are kept in that order, so
a pair goes on if none of the keys before the one it met under is the
title's too).

Keys travel as 64-bit hashes: a collision adds a pair that scores nothing.
Distinct titles are scored once and joined back; the best match of a title is
the maximum of a number that holds score and positions
(``functions/packing.py``), and names come back by the positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillmesh import schemas
from skillmesh.fixed import (
    DEFAULT_THRESHOLD,
    EXACT_MATCH_FACTOR,
    MAX_IGNORED_KEYWORD_LENGTH,
    MIN_PARTIAL_TOKEN_LENGTH,
    MULTI_TOKEN_BONUS,
    MULTI_TOKEN_BONUS_MIN_MATCHES,
    PARTIAL_MATCH_SCORE,
    UNKNOWN_PROFESSION,
)
from skillmesh.functions.packing import keyword_id, kid_of, match_code, score_of
from skillmesh.functions.text import clean_title, strip_ws, ws_tokens

UNKNOWN = UNKNOWN_PROFESSION
# The probe and keyword tables are broadcast when they have at most this
# many rows; larger dictionaries are shuffle-joined.
DICTIONARY_BROADCAST_ROWS = 500_000
# The title → profession mapping is broadcast back onto the input when it
# has at most this many distinct titles (about 100 bytes each).
MAPPING_BROADCAST_ROWS = 2_000_000
# ... and when these, at the length of the longest title, have at most this many bytes.
MAPPING_BROADCAST_BYTES = 512 << 20
# A title that matches more distinct keyword tokens than this meets its keywords
# without pairs of tokens, whose number grows with the square.
MAX_PAIRED_TOKENS = 64


# --- dictionary -----------------------------------------------------------------


def merge_keywords(english: DataFrame, vietnamese: DataFrame) -> DataFrame:
    """Long-form merged dictionary.

    Professions and their order come from the English list; each gets the
    Vietnamese keywords of the profession with the same name (the last such
    entry when a name repeats), placed after its English keywords.  An entry
    without keywords is one row with a NULL ``kw_pos`` and ``keyword``: an
    English one keeps its profession, a last Vietnamese one gives none.
    """
    en = english.select("prof_pos", "kw_pos", "profession", "keyword")
    offsets = en.groupBy("prof_pos", "profession").agg(F.coalesce(F.max("kw_pos") + 1, F.lit(0)).alias("offset"))
    last_vn = vietnamese.groupBy("profession").agg(F.max("prof_pos").alias("vn_pos"))
    vn = vietnamese.join(last_vn, "profession").filter(F.col("prof_pos") == F.col("vn_pos"))
    vn = offsets.join(vn.select("profession", F.col("kw_pos").alias("vn_kw"), "keyword"), "profession")
    vn, en = vn.filter(F.col("keyword").isNotNull()), en.filter(F.col("keyword").isNotNull())
    return en.select(
        F.col("prof_pos").cast("int"),
        F.col("kw_pos").cast("int"),
        "profession",
        F.lit("english").alias("language"),
        "keyword",
    ).unionByName(
        vn.select(
            F.col("prof_pos").cast("int"),
            (F.col("offset") + F.col("vn_kw")).cast("int").alias("kw_pos"),
            "profession",
            F.lit("vietnamese").alias("language"),
            "keyword",
        )
    )


def keywords_from_lists(spark: SparkSession, english: list[dict], vietnamese: list[dict]) -> DataFrame:
    """Build the merged dictionary from ``[{"name": ..., "keywords": [...]}]`` lists."""

    def rows(lst):
        return [
            (p, k, item["name"], kw)
            for p, item in enumerate(lst)
            for k, kw in (list(enumerate(item.get("keywords") or [])) or [(None, None)])
        ]

    en = spark.createDataFrame(rows(english), schemas.LANGUAGE_KEYWORDS)
    vn = spark.createDataFrame(rows(vietnamese), schemas.LANGUAGE_KEYWORDS)
    return merge_keywords(en, vn)


def read_keywords(spark: SparkSession, path, fmt: str = "json") -> DataFrame:
    """A merged long-form dictionary from a file, with its declared schema."""
    reader = spark.read.schema(schemas.PROFESSION_KEYWORDS)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def prepare_keywords(keywords: DataFrame, language: str = "both") -> DataFrame:
    """Keywords in play for ``language`` with their normalised text.

    Columns: ``kid, prof_pos, kw_pos, profession, keyword, K, KT``.  The
    positions tell keywords apart, as in the lists they come from.
    """
    kw = keywords
    if language == "english":
        kw = kw.filter(F.col("language") == "english")
    elif language == "vietnamese":
        kw = kw.filter(F.col("language") == "vietnamese")
    kw = kw.filter(F.length(strip_ws("keyword")) > MAX_IGNORED_KEYWORD_LENGTH)
    kw = kw.select(
        keyword_id().alias("kid"),
        "prof_pos",
        "kw_pos",
        "profession",
        "keyword",
        strip_ws(F.lower("keyword")).alias("K"),
    )
    return kw.withColumn("KT", ws_tokens("K"))


def keyword_probes(prepared: DataFrame) -> DataFrame:
    """``key, kid``: the join keys under which a keyword can meet a title."""
    whole = prepared.filter(F.length("K") >= 3).select(
        F.concat(F.lit("g:"), F.substring("K", 1, 3)).alias("key"), "kid"
    )
    tok = prepared.select("kid", F.explode(F.array_distinct("KT")).alias("t"))
    equal = tok.select(F.concat(F.lit("w:"), "t").alias("key"), "kid")
    long_tok = tok.filter(F.length("t") >= MIN_PARTIAL_TOKEN_LENGTH)
    inside = long_tok.select(F.concat(F.lit("g:"), F.substring("t", 1, 3)).alias("key"), "kid")
    around = long_tok.select(
        F.explode(
            F.expr(
                "array_distinct(flatten(transform(sequence(1, length(t)), "
                "i -> transform(sequence(1, length(t) - i + 1), j -> concat('w:', substring(t, i, j))))))"
            )
        ).alias("key"),
        "kid",
    )
    return whole.unionByName(equal).unionByName(inside).unionByName(around).distinct()


def distinct_texts(prepared: DataFrame) -> DataFrame:
    """``kid, K, KT``: each keyword text once, with the earliest keyword that has it."""
    texts = prepared.filter(F.col("kid").isNotNull()).groupBy("K").agg(F.min("kid").alias("kid"))
    return texts.select("kid", "K", ws_tokens("K").alias("KT"))


def token_keys(texts: DataFrame) -> DataFrame:
    """``key, tok``: the hashed keys under which a keyword token can meet a title token."""
    tokens = texts.select(F.explode("KT").alias("tok")).distinct()
    around = F.expr("flatten(transform(sequence(1, length(tok)), i -> transform(sequence(1, length(tok) - i + 1), j -> concat('w:', substring(tok, i, j)))))")
    partial = F.array_append(around, F.concat(F.lit("g:"), F.substring("tok", 1, 3)))
    keys = F.when(F.length("tok") >= MIN_PARTIAL_TOKEN_LENGTH, F.array_distinct(partial)).otherwise(F.array(F.concat(F.lit("w:"), "tok")))
    return tokens.select(F.explode(F.transform(keys, lambda x: F.xxhash64(x))).alias("key"), "tok")


def token_groups(texts: DataFrame) -> DataFrame:
    """``tok, size, kid, K``: the earliest text with a token among those of ``size`` tokens."""
    tokens = texts.select("kid", F.size("KT").alias("size"), F.explode(F.array_distinct("KT")).alias("tok"))
    scoring = (F.col("size") > 1) | (F.length("tok") >= MIN_PARTIAL_TOKEN_LENGTH)
    first = tokens.where(scoring).groupBy("tok", "size").agg(F.min("kid").alias("kid")).join(texts, "kid")
    # Positions given twice lead to several texts.
    return first.where((F.size("KT") == F.col("size")) & F.array_contains("KT", F.col("tok"))).select("tok", "size", "kid", "K")


def text_keys(texts: DataFrame) -> DataFrame:
    """``key, kid``: the hashed keys under which a text meets the titles that hold it or match two of its tokens."""
    prefix = F.expr("xxhash64(concat('s:', substring(K, 1, shiftleft(1, length(bin(length(K))) - 1))))")
    return texts.select(F.explode(F.array_distinct(F.array_append(pair_keys("KT", 1), prefix))).alias("key"), "kid")


def pair_keys(tokens: str, apart: int) -> Column:
    """Hashed keys of the pairs of tokens in an array; ``apart`` = 0 also pairs a token with itself."""
    pairs = f"transform(slice(o, i + {apart}, size(o)), b -> xxhash64('p:', o[i - 1], b))"
    return F.expr(f"flatten(transform(array(array_sort({tokens})), o -> CASE WHEN size(o) > {apart} THEN flatten(transform(sequence(1, size(o) - {apart}), i -> {pairs})) ELSE array() END))")


# --- titles -----------------------------------------------------------------------


def clean_titles(titles: DataFrame, title_col: str = "title") -> DataFrame:
    """Adds ``clean_title``."""
    return titles.withColumn("clean_title", clean_title(title_col))


def ranked_keys(prepared: DataFrame) -> DataFrame:
    """``kid, KK``: the hashed probe keys of each keyword, the rarest in the
    dictionary first."""
    keys = keyword_probes(prepared).select(F.xxhash64("key").alias("key"), "kid")
    rarity = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ranked = keys.join(rarity, "key").groupBy("kid").agg(F.array_sort(F.collect_set(F.struct("n", "key"))).alias("ranked"))
    return ranked.select("kid", F.col("ranked.key").alias("KK"))


def _with_keys(titles: DataFrame) -> DataFrame:
    """Adds ``TT``, the tokens of ``T``, and ``TK``, the hashed keys of its trigrams and tokens."""
    tri = F.expr(
        "CASE WHEN length(T) >= 3 THEN transform(sequence(1, length(T) - 2), "
        "i -> xxhash64(concat('g:', substring(T, i, 3)))) ELSE array() END"
    )
    words = F.transform("TT", lambda x: F.xxhash64(F.concat(F.lit("w:"), x)))
    return titles.withColumn("TT", ws_tokens("T")).withColumn("TK", F.array_distinct(F.concat(tri, words)))


_SCORE = f"""
CASE
  WHEN contains(T, K) THEN length(K) / length(T) * {EXACT_MATCH_FACTOR}
  WHEN size(KT) = 0 OR (size(KT) = 1 AND length(KT[0]) < {MIN_PARTIAL_TOKEN_LENGTH}) THEN NULL
  ELSE (CASE WHEN size(KT) > 1 AND mc >= {MULTI_TOKEN_BONUS_MIN_MATCHES}
             THEN mc / size(KT) * {MULTI_TOKEN_BONUS!r}D ELSE mc / size(KT) END)
END
"""

_MATCH_COUNT = f"""
aggregate(KT, 0D, (acc, t) -> acc + CASE
    WHEN array_contains(TT, t) THEN 1D
    WHEN length(t) >= {MIN_PARTIAL_TOKEN_LENGTH} AND exists(TT, n -> contains(n, t) OR contains(t, n))
         THEN {PARTIAL_MATCH_SCORE!r}D
    ELSE 0D END)
"""


def _dictionary_is_small(prepared: DataFrame) -> bool:
    """One small job over the dictionary: keyword count and upper bounds on
    its probe rows (tokens of four or more characters emit all their
    substrings, all tokens their pairs) and on the bytes of probes and keywords."""
    probes = F.aggregate(
        "KT",
        F.lit(2).cast("long"),
        lambda acc, t: acc + 2 + F.when(F.length(t) >= MIN_PARTIAL_TOKEN_LENGTH, F.length(t) * (F.length(t) + 1) / 2).otherwise(0).cast("long"),
    )
    probes = probes + (F.size("KT") * (F.size("KT") - 1) / 2).cast("long")
    texts = F.octet_length("K") + F.octet_length("keyword") + F.coalesce(F.octet_length("profession"), F.lit(0))
    n_kw, n_probes, n_bytes = (
        prepared.select(probes.alias("p"), texts.cast("long").alias("b"))
        .agg(F.count(F.lit(1)), F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum((F.col("p") + 2) * (F.col("b") + 100)), F.lit(0)))
        .first()
    )
    return max(n_kw, n_probes) <= DICTIONARY_BROADCAST_ROWS and n_bytes <= MAPPING_BROADCAST_BYTES


def _dealt(titles: DataFrame, col: str) -> DataFrame:
    """Distinct titles over all shuffle partitions: a title is short but takes long to clean and to
    meet its keywords, and sizes in bytes would put all into a few tasks.  It also keeps Spark from
    merging this distinct with a later one, which would clean every input row."""
    return titles.repartition(int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions")), col)


def candidate_pairs(cleaned_titles: DataFrame, prepared: DataFrame, small: bool) -> DataFrame:
    """Each distinct pair of a cleaned title (``T, TT``) and a prepared
    keyword that share a probe key, once (J3).

    ``small`` dictionaries are broadcast, slim probes (key, kid, pos) first
    and keyword details by a second join.  For others the details are
    attached on the dictionary side, so that the pairs come out of one shuffle join
    on the probe key (AQE splits a hot key) that moves only a title and a key; the title's
    own keys are made again behind it.

    ``explode_outer``, as for ``explode`` Spark tests the size of the keys first, and
    that test moves through the distinct down to every input row, where it cleans the title
    anew for each trigram.  Titles without keys meet nothing in the join, nor does
    the empty text for NULL, which spares a NULL test on the input rows.
    """
    keys = ranked_keys(prepared)
    probes = keys.select("kid", F.posexplode("KK").alias("pos", "key"))
    info = prepared.join(keys, "kid")
    titles = _dealt(cleaned_titles.select(F.coalesce("clean_title", F.lit("")).alias("T")).distinct(), "T")
    exploded = _with_keys(titles).withColumn("key", F.explode_outer("TK"))
    if small:
        met = exploded.join(F.broadcast(probes), "key").join(F.broadcast(info), "kid")
    else:
        met = _with_keys(exploded.select("T", "key").join(probes.join(info, "kid"), "key"))
    first = (F.col("pos") == 0) | ~F.arrays_overlap(F.slice("KK", F.lit(1), F.col("pos")), "TK")
    return met.where(first).select("T", "TT", *prepared.columns)


def _token_matches(titles: DataFrame, texts: DataFrame, small: bool, threshold: float) -> DataFrame:
    """``T, code, tokens, shadowed`` for each title that matches a keyword token: its best match by one
    token, the keyword tokens it matches, and whether the earliest text of a token hides others that
    may win: it is a substring of the title and scores less as such.  On equal scores it is the earlier."""
    held = F.broadcast if small else (lambda df: df)
    tri = F.expr("CASE WHEN length(n) >= 3 THEN transform(sequence(1, length(n) - 2), i -> xxhash64(concat('g:', substring(n, i, 3)))) ELSE array() END")
    words = titles.select("T", F.explode_outer(F.array_distinct(ws_tokens("T"))).alias("n"))
    words = words.withColumn("key", F.explode_outer(F.array_distinct(F.array_append(tri, F.xxhash64(F.concat(F.lit("w:"), "n"))))))
    weight = f"""CASE WHEN n = tok THEN 1D
        WHEN length(tok) >= {MIN_PARTIAL_TOKEN_LENGTH} AND (contains(n, tok) OR contains(tok, n)) THEN {PARTIAL_MATCH_SCORE!r}D END"""
    hits = words.join(held(token_keys(texts)), "key").withColumn("w", F.expr(weight)).where("w IS NOT NULL")
    met = hits.join(held(token_groups(texts)), "tok").withColumn("score", F.expr("w / size"))
    inside = F.expr("contains(T, K)")
    passes = F.col("score") >= F.lit(float(threshold))
    whole = F.expr(f"length(K) / length(T) * {EXACT_MATCH_FACTOR}")
    return met.groupBy("T").agg(
        F.max(F.when(passes & ~inside, match_code("score", "kid"))).alias("code"),
        F.collect_set("tok").alias("tokens"),
        F.max(passes & inside & (whole < F.col("score"))).alias("shadowed"),
    )


def _meet(titles: DataFrame, tokens: DataFrame, texts: DataFrame, small: bool) -> DataFrame:
    """Pairs of a title and a text that it holds or two of whose tokens it matches; a pair may come
    more than once."""
    pieces = F.expr("""CASE WHEN length(T) >= 1 THEN flatten(transform(sequence(0, length(bin(length(T))) - 1),
        c -> transform(sequence(1, length(T) - shiftleft(1, c) + 1), i -> xxhash64(concat('s:', substring(T, i, shiftleft(1, c)))))))
        ELSE array() END""")
    held = titles.select("T", F.explode_outer(F.array_distinct(pieces)).alias("key"))
    paired = tokens.where(F.size("tokens") <= MAX_PAIRED_TOKENS).select("T", F.explode(pair_keys("tokens", 0)).alias("key"))
    probes = held.unionByName(paired)
    if small:
        met = probes.join(F.broadcast(text_keys(texts)), "key").join(F.broadcast(texts), "kid")
    else:
        met = probes.join(text_keys(texts).join(texts, "kid"), "key")
    return met.select("T", ws_tokens("T").alias("TT"), *texts.columns)


def best_matches(
    cleaned_titles: DataFrame,
    keywords: DataFrame,
    language: str = "both",
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """``T, score, profession, keyword`` for each distinct cleaned title that
    has a match (J3, N3-N6).

    Join strategy: the dictionary side is broadcast when a size check
    proves it small, else both sides are shuffled on the probe key.
    """
    prepared = prepare_keywords(keywords, language)
    small = _dictionary_is_small(prepared)
    texts = distinct_texts(prepared)
    titles = _dealt(cleaned_titles.select(F.coalesce("clean_title", F.lit("")).alias("T")).distinct(), "T")
    tokens = _token_matches(titles, texts, small, threshold)
    rest = tokens.where(F.col("shadowed") | (F.size("tokens") > MAX_PAIRED_TOKENS)).select(F.col("T").alias("clean_title"))
    pairs = _meet(titles, tokens, texts, small).unionByName(candidate_pairs(rest, texts, small))
    codes = _passing(pairs, threshold).select("T", match_code("score", "kid").alias("code"))
    best = codes.unionByName(tokens.where("code IS NOT NULL").select("T", "code")).groupBy("T").agg(F.max("code").alias("code"))
    best = best.select("T", kid_of("code").alias("kid"), score_of("code").alias("score"))
    names = prepared.select("kid", "profession", "keyword")
    return best.join(F.broadcast(names) if small else names, "kid").select("T", "score", "profession", "keyword")


def _passing(pairs: DataFrame, threshold: float) -> DataFrame:
    """Scores ``T``/``TT`` × ``K``/``KT`` pairs and keeps those that can win."""
    scored = pairs.withColumn("mc", F.expr(_MATCH_COUNT)).withColumn("score", F.expr(_SCORE))
    return scored.filter(
        F.col("score").isNotNull()
        & (F.col("score") > 0)
        & (F.expr("contains(T, K)") | (F.col("score") >= F.lit(float(threshold))))
    )


def best_match_of(
    title: str, keywords: DataFrame, language: str = "both", threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """At most one row ``score, profession, keyword`` for a single request
    title.  The cleaned title is a constant column over the dictionary scan
    (Catalyst folds it), so there is no join: one pass over the keywords, of
    which each task sends its best one."""
    t = F.lit(title).cast("string")
    pairs = prepare_keywords(keywords, language).withColumn("T", clean_title(t)).withColumn("TT", ws_tokens("T"))
    best = _passing(pairs, threshold).orderBy(F.desc("score"), "prof_pos", "kw_pos").limit(1)
    return best.select("score", "profession", "keyword")


def normalize_titles(
    titles: DataFrame,
    keywords: DataFrame,
    title_col: str = "title",
    language: str = "both",
    threshold: float = DEFAULT_THRESHOLD,
    broadcast_max_titles: int = MAPPING_BROADCAST_ROWS,
) -> DataFrame:
    """Input rows plus ``profession`` (``Unknown`` when nothing matches),
    ``score`` (capped at 1) and ``matched_keyword`` (N7).

    Join back to the input: one small job first estimates the number of
    distinct titles (``approx_count_distinct`` over the title column only:
    a columnar scan with per-partition sketches, no shuffle of rows).
    Within ``broadcast_max_titles`` the title → profession mapping is
    broadcast, so the input rows are never shuffled; above it both sides
    are shuffled on the title and AQE splits a skewed title.
    """
    distinct = _dealt(titles.select(F.col(title_col).alias("_title")).distinct(), "_title")
    distinct = distinct.withColumn("clean_title", clean_title("_title"))
    best = best_matches(distinct, keywords, language, threshold)
    mapping = distinct.join(best, distinct.clean_title == best.T, "left").select(
        "_title",
        F.coalesce("profession", F.lit(UNKNOWN)).alias("profession"),
        F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)).alias("score"),
        F.col("keyword").alias("matched_keyword"),
    )
    n_titles, n_bytes = titles.select(
        F.approx_count_distinct(title_col, rsd=0.02), F.max(F.octet_length(title_col))
    ).first()
    # The estimate's error is about 2 %; keep a margin below the bound.  The
    # longest title bounds the bytes.
    if n_titles * 1.1 <= broadcast_max_titles and n_titles * 1.1 * ((n_bytes or 0) + 100) <= MAPPING_BROADCAST_BYTES:
        mapping = F.broadcast(mapping)
    out = titles.join(mapping, titles[title_col] == mapping["_title"], "left").drop("_title")
    return out.withColumn("profession", F.coalesce("profession", F.lit(UNKNOWN))).withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )


def profession_of_title(titles: DataFrame, keywords: DataFrame, title_col: str = "title") -> DataFrame:
    """Input rows plus ``profession`` only, language both, threshold 0.8."""
    return normalize_titles(titles, keywords, title_col).drop("score", "matched_keyword")


def resolve_title(spark: SparkSession, title: str, keywords: DataFrame) -> str:
    """The profession name for one request title, or the title itself when
    nothing matches (an empty title resolves to ``Unknown``)."""
    best = best_match_of(title, keywords).first() if title else None
    prof = best.profession if best is not None else UNKNOWN
    return title if (prof == UNKNOWN and title) else prof
