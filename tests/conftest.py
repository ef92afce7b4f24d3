import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from lexweave.session import get_spark

    return get_spark("local[4]", partitions=4)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same():
    def check(spark_frame, duck_frame):
        frames = []
        for f in (spark_frame, duck_frame):
            columns = sorted(f.columns)
            # whole numbers with nulls come as floats from one side and as nullable integers from the other
            frames.append(f[columns].convert_dtypes().astype(str).sort_values(columns).reset_index(drop=True))
        assert list(frames[0].columns) == list(frames[1].columns)
        assert len(frames[0]) == len(frames[1])
        assert frames[0].equals(frames[1])

    return check
