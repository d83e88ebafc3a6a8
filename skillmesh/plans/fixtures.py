"""Views of the driver's TPC-H-style tables shaped like the job data.

Each view has a Spark builder and the equivalent DuckDB SQL text, so a
registered query and its oracle start from the same rows.

* ``postings``: one posting per order.  Title = market segment + priority
  text, country = customer's nation, skills = the order's part names
  (upper-cased on even line numbers), a trailing ``", "`` on orders
  divisible by ten, NULL skills for orders without lines.
* ``raw_titles``: ``p_name (p_brand) - p_type`` per part: brackets, a
  hyphen tail and digits for the title cleaner to strip.
* ``test_taxonomy``: a small profession dictionary of our own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillmesh import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")

    skills = (
        lineitem.join(part, lineitem.l_partkey == part.p_partkey)
        .select(
            "l_orderkey",
            F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name"))
            .otherwise(F.col("p_name"))
            .alias("sk"),
        )
        .groupBy("l_orderkey")
        .agg(F.array_join(F.sort_array(F.collect_list("sk")), ", ").alias("job_skills"))
    )
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(skills, orders.o_orderkey == skills.l_orderkey, "left")
        .select(
            F.col("o_orderkey").alias("posting_id"),
            F.concat_ws(" ", "c_mktsegment", F.substring("o_orderpriority", 3, 1 << 20)).alias(
                "job_title"
            ),
            F.col("n_name").alias("search_country"),
            F.concat(
                "job_skills",
                F.when(F.col("o_orderkey") % 10 == 0, F.lit(", ")).otherwise(F.lit("")),
            ).alias("job_skills"),
            F.date_format("o_orderdate", "yyyy-MM").alias("month_year"),
        )
    )


POSTINGS_SQL = """
SELECT o_orderkey AS posting_id,
       c_mktsegment || ' ' || substr(o_orderpriority, 3) AS job_title,
       n_name AS search_country,
       js.job_skills || CASE WHEN o_orderkey % 10 = 0 THEN ', ' ELSE '' END AS job_skills,
       strftime(o_orderdate, '%Y-%m') AS month_year
FROM orders
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT l_orderkey, string_agg(sk, ', ' ORDER BY sk) AS job_skills
           FROM (SELECT l_orderkey,
                        CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS sk
                 FROM lineitem JOIN part ON l_partkey = p_partkey) x
           GROUP BY l_orderkey) js ON js.l_orderkey = o_orderkey
"""


def raw_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("title_id"),
        F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") - "), "p_type").alias("title"),
    )


RAW_TITLES_SQL = """
SELECT p_partkey AS title_id, p_name || ' (' || p_brand || ') - ' || p_type AS title FROM part
"""

# Test taxonomy (ours): profession, language, keyword; positions follow list order.
TEST_TAXONOMY = [
    (0, 0, "Ring Maker", "english", "Ring"),
    (0, 1, "Ring Maker", "english", "small hoops rings"),
    (1, 0, "Widget Operator", "english", "hot widgets"),
    (1, 1, "Widget Operator", "vietnamese", "ẩm thực"),
    (2, 0, "Gear Cutter", "english", "gear cutting large"),
    (2, 1, "Gear Cutter", "english", "IT"),
    (3, 0, "Rod Welder", "english", "roddy"),
    (4, 0, "Blue Specialist", "english", "blue anvil bolt"),
    (5, 0, "Red Specialist", "english", "redd"),
    (6, 0, "Triple", "english", "small small rodder"),
]


def test_taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEST_TAXONOMY, schemas.PROFESSION_KEYWORDS)


def taxonomy_sql() -> str:
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    rows = ",\n  ".join(
        f"({p}, {k}, {q(n)}, {q(lang)}, {q(kw)})" for p, k, n, lang, kw in TEST_TAXONOMY
    )
    return (
        "SELECT * FROM (VALUES\n  " + rows + "\n) AS t(prof_pos, kw_pos, profession, language, keyword)"
    )


def part_dictionary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A two-language dictionary derived from ``part``: one profession per
    part type; English keywords are the part names of that type, the second
    language's keywords are its brands.  Grows with the ``part`` table."""
    part = table(spark, sf_dir, "part").select(F.initcap("p_type").alias("profession"), "p_name", "p_brand")
    # Numbering the distinct part types (a handful of rows) in one window.
    prof = part.select("profession").distinct().withColumn(
        "prof_pos", (F.dense_rank().over(Window.orderBy("profession")) - 1).cast("int")
    )

    def language(col: str) -> DataFrame:
        kws = part.select("profession", F.col(col).alias("keyword")).distinct()
        by_prof = Window.partitionBy("profession").orderBy("keyword")
        return kws.join(prof, "profession").select(
            "prof_pos",
            (F.row_number().over(by_prof) - 1).cast("int").alias("kw_pos"),
            "profession",
            "keyword",
        )

    return language("p_name"), language("p_brand")


PART_DICTIONARY_SQL = {
    "english": """
SELECT CAST(dense_rank() OVER (ORDER BY profession) - 1 AS INTEGER) AS prof_pos,
       CAST(row_number() OVER (PARTITION BY profession ORDER BY keyword) - 1 AS INTEGER) AS kw_pos,
       profession, keyword
FROM (SELECT DISTINCT upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS profession,
                      p_name AS keyword FROM part)
""",
    "vietnamese": """
SELECT CAST(dense_rank() OVER (ORDER BY profession) - 1 AS INTEGER) AS prof_pos,
       CAST(row_number() OVER (PARTITION BY profession ORDER BY keyword) - 1 AS INTEGER) AS kw_pos,
       profession, keyword
FROM (SELECT DISTINCT upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS profession,
                      p_brand AS keyword FROM part)
""",
}

# Plain vowels and the accented letters that stand for them (ours).
PLAIN_VOWELS, ACCENTED_VOWELS = "aeiou", "áêịơữ"


def two_language_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text titles from ``part`` in five shapes: type before name, the
    name's words turned round and in the plural, accented with the brand,
    accented in capitals, and with brackets and a hyphen tail."""
    part = table(spark, sf_dir, "part")
    accented = F.translate("p_name", PLAIN_VOWELS, ACCENTED_VOWELS)
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    shape = F.col("p_partkey") % 5
    title = (
        F.when(shape == 0, F.concat("p_type", F.lit(" "), "p_name"))
        .when(shape == 1, F.concat(second, F.lit(" "), first, F.lit("s")))
        .when(shape == 2, F.concat(accented, F.lit(" "), "p_brand"))
        .when(shape == 3, F.upper(accented))
        .otherwise(F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" ("), "p_brand", F.lit(") - x")))
    )
    return part.select(F.col("p_partkey").alias("title_id"), title.alias("title"))


TWO_LANGUAGE_TITLES_SQL = f"""
SELECT p_partkey AS title_id, CASE p_partkey % 5
    WHEN 0 THEN p_type || ' ' || p_name
    WHEN 1 THEN split_part(p_name, ' ', -1) || ' ' || split_part(p_name, ' ', 1) || 's'
    WHEN 2 THEN translate(p_name, '{PLAIN_VOWELS}', '{ACCENTED_VOWELS}') || ' ' || p_brand
    WHEN 3 THEN upper(translate(p_name, '{PLAIN_VOWELS}', '{ACCENTED_VOWELS}'))
    ELSE p_name || ' ' || lower(p_type) || ' (' || p_brand || ') - x' END AS title
FROM part
"""


def accented_dictionary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """As ``part_dictionary``, with accented part names as the second
    language's keywords (their order is that of the plain names)."""
    english, _ = part_dictionary(spark, sf_dir)
    return english, english.withColumn("keyword", F.translate("keyword", PLAIN_VOWELS, ACCENTED_VOWELS))


ACCENTED_DICTIONARY_SQL = {
    "english": PART_DICTIONARY_SQL["english"],
    "vietnamese": f"""
SELECT prof_pos, kw_pos, profession, translate(keyword, '{PLAIN_VOWELS}', '{ACCENTED_VOWELS}') AS keyword
FROM ({PART_DICTIONARY_SQL["english"]})
""",
}
