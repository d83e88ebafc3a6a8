"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a name and a Boolean column that is true where a text is rejected.
``order_rules`` estimates on a sample how many rows each rule rejects and
how long it takes, and puts the rules in order of rejections per second;
``cascade`` joins them in one ``CASE`` expression, whose later branches are
not evaluated for a text that an earlier one has rejected.  The order only
decides the work: a text is kept when no rule rejects it, in any order.

Null texts count as empty: no words, so ``few_words`` rejects them.  Rows are
judged one by one, so ties and repeated rows each get their own result, an
empty table gives an empty result, and further columns are not touched, but for those
with the name of a measure or verdict, which are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, fresh, whole_text

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

Rule = tuple[str, Column]


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_lines``, ``n_repeat_words``.

    All of a text's repeated three-word windows are found inside its row:
    the windows with their positions are sorted, equal neighbours are repeats,
    and the words they cover are counted from the sorted positions.  This is
    n log n in the words of one text and needs no shuffle.
    """
    text = whole_text(text_col)
    words, lines, grams, places = fresh(docs, "_words", "_lines", "_grams", "_places")
    out = docs.withColumn(words, F.array_remove(F.split(text, SPACE_RUN), ""))
    out = out.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    out = out.withColumn(
        grams,
        F.sort_array(
            F.transform(
                starts,
                lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("gram"), i.alias("at")),
            )
        ),
    )

    def repeated(x: Column, i: Column) -> Column:
        return (x["gram"] == F.get(grams, i - 1)["gram"]) | (x["gram"] == F.get(grams, i + 1)["gram"])

    out = out.withColumn(places, F.sort_array(F.transform(F.filter(grams, repeated), lambda x: x["at"])))
    covered = F.transform(places, lambda at, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - at, F.lit(3))))
    measures = {
        "n_words": F.size(words).cast("long"),
        "n_repeat_words": F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE_RUN, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }
    return out.withColumns(measures).drop(words, lines, grams, places)


def base_rules() -> list[Rule]:
    """Too few words; more than half of the words in repeated three-word windows."""
    return [
        ("few_words", F.col("n_words") < 50),
        ("repeated_words", 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    ]


def further_rules(text_col: str = "text") -> list[Rule]:
    """Rules beyond the base: symbols, shouting, repeated lines, odd word lengths."""
    text = whole_text(text_col)
    shouts = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    return [
        ("symbols", 100 * F.col("n_symbols") > 8 * F.col("word_chars")),
        ("shouting", 100 * shouts > 10 * F.col("word_chars")),
        ("repeated_lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        ("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    ]


#: Times that a rule goes over the sample while it is timed, and runs of which the fastest counts.
REPEATS, RUNS = 40, 3


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 500) -> list[Rule]:
    """The rules, most rejections per second first, estimated on ``sample_rows`` rows.

    ``docs`` has the columns that the rules read.  The sample is fetched once (the first
    rows, read only as far as needed) and kept in memory.  One job counts
    each rule's rejections; each rule is then timed over ``REPEATS`` copies of the sample,
    less the time of a rule that tests nothing.  On an empty sample the given order stays.
    """
    spark = docs.sparkSession
    rows = docs.take(sample_rows)
    if not rows:
        return list(rules)
    sample = spark.createDataFrame(rows, docs.schema).coalesce(1).cache()
    counts = sample.agg(*[F.count_if(c).alias(f"r{i}") for i, (_, c) in enumerate(rules)]).first()
    copy, = fresh(docs, "_copy")
    copies = sample.withColumn(copy, F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(c: Column) -> float:
        spent = []
        for _ in range(RUNS):
            began = time.perf_counter()
            copies.agg(F.count_if(c)).first()
            spent.append(time.perf_counter() - began)
        return min(spent)

    nothing = seconds(F.col(copy) < 0)
    # Differences below a tenth of an empty pass are noise.
    spent = [max(seconds(c) - nothing, nothing / 10) for _, c in rules]
    sample.unpersist()
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -counts[i] / spent[i])]


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects the row, else null."""
    out = F.lit(None).cast("string")
    for name, c in reversed(rules):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


def judge(docs: DataFrame, text_col: str = "text", sample_rows: int = 500) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``rejected_by`` and ``kept``."""
    measured = with_measures(docs, text_col)
    read = ["n_words", "n_repeat_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    own = measured.select(F.col(text_col).alias("text"), *read) if text_col not in read else measured
    ordered = [name for name, _ in order_rules(own, [*base_rules(), *further_rules("text")], sample_rows)]
    rules = {name: c for name, c in [*base_rules(), *further_rules(text_col)]}
    base = base_rules()
    return (
        measured.withColumn("base_failed", base[0][1] | base[1][1])
        .withColumn("rejected_by", cascade([(name, rules[name]) for name in ordered]))
        .withColumn("kept", F.col("rejected_by").isNull())
    )
