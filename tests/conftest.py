import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .appName("skillmesh-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def postings(spark):
    from skillmesh.plans import fixtures

    return fixtures.postings(spark, SF_SMALL).cache()


def make_postings(spark, rows):
    """rows: (job_title, search_country, job_skills) tuples."""
    from skillmesh import schemas

    return spark.createDataFrame([r + (None,) for r in rows], schemas.POSTINGS)
