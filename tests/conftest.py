import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def run_oracles(spark, folder, queries, oracles):
    """Names of the queries whose rows differ from their SQL over the tables of folder."""
    import glob

    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        cell = lambda v: "~" if pd.isna(v) else f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        return sorted(tuple(cell(v) for v in r) for r in frame.astype(object).itertuples(index=False))

    bad = []
    for name, sql in oracles.items():
        mine, theirs = queries[name](spark, folder).toPandas(), con.execute(sql).df()
        if sorted(mine.columns) != sorted(theirs.columns) or rows(mine) != rows(theirs):
            bad.append(name)
    return bad
