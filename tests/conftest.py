import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("shared").as_uri())
        .config("spark.sql.warehouse.dir", tmp_path_factory.mktemp("warehouse").as_uri())
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.01"


class Parity:
    """Compares a query with its SQL over the same tables."""

    def __init__(self, spark, sf_dir):
        import duckdb

        self.spark, self.sf_dir, self.db = spark, sf_dir, duckdb.connect()
        for f in Path(sf_dir).glob("*.parquet"):
            self.db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")

    def rows(self, df, names):
        plain = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else int(v) if hasattr(v, "bit_count") and not isinstance(v, bool) else v
        return sorted(repr([plain(r[n]) for n in names]) for r in df)

    def check(self, query, sql):
        got = [r.asDict() for r in query(self.spark, self.sf_dir).collect()]
        cursor = self.db.execute(sql)
        names = sorted(d[0] for d in cursor.description)
        want = [dict(zip([d[0] for d in cursor.description], r, strict=True)) for r in cursor.fetchall()]
        assert not got or sorted(got[0]) == names
        assert self.rows(got, names) == self.rows(want, names)


@pytest.fixture(scope="session")
def parity(spark, sf_dir):
    return Parity(spark, sf_dir)
