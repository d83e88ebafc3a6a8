"""The driver contract: entry(), queries() and oracle_sql() agree."""

import os

import duckdb

from conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def test_keys_and_entry_schema(spark):
    import __spark_entry__ as entry

    queries, sqls = set(entry.queries()), set(entry.oracle_sql())
    # Only operators on training text may lack SQL (their tests compare them with plain versions).
    assert sqls <= queries and all(k.startswith("op") or k == "pipeline" for k in queries - sqls)
    df = entry.entry(spark)
    assert df.schema.simpleString() == "struct<rank:int,skill:string,frequency:bigint,percentage:double>"


def test_column_names_match_oracle(spark):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES.split():
        path = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    sqls = entry.oracle_sql()
    for key, fn in entry.queries().items():
        if key not in sqls:
            continue
        oracle_cols = [r[0] for r in con.execute(f"DESCRIBE {sqls[key]}").fetchall()]
        assert sorted(fn(spark, SF_SMALL).columns) == sorted(oracle_cols), key
