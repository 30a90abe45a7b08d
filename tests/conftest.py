import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    home = tempfile.mkdtemp(prefix="spark-")
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", f"{home}/shared").config("spark.sql.warehouse.dir", f"{home}/warehouse").config("spark.driver.memory", "4g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def same(spark_rows, duck_rows):
    """Both as sorted lists of plain values."""

    def plain(rows):
        return sorted(tuple("NULL" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)

    return plain(spark_rows) == plain(duck_rows)


def against_sql(spark, sf, query, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, sf)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert same([tuple(r) for r in df.select(*names).collect()], want)
