"""Every query against its SQL twin in DuckDB, and the driver's contract."""

import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

from gleaner.plans import catalog

ROOT = pathlib.Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in pathlib.Path(DATA).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    return connection


def plain(v):
    if isinstance(v, float | np.floating):
        return None if v != v else round(float(v), 5)
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    return v.item() if isinstance(v, np.generic) else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    if name in catalog.oracle_sql():
        want = duck.sql(catalog.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


@pytest.fixture(scope="module")
def many_members(tmp_path_factory):
    """A category of 10,500 members, the oldest 500 of which point elsewhere, and one of 50."""
    folder = tmp_path_factory.mktemp("members")
    for name in ("region", "nation", "supplier"):
        shutil.copy(f"{DATA}/{name}.parquet", folder)
    made = "SELECT i AS vec_id, CASE WHEN i < 1000 THEN [0, 30] WHEN i < 21000 THEN [1, (i % 7) / 10] ELSE [0.2, -1] END::FLOAT[] AS embedding, CASE WHEN i < 21000 THEN 3 ELSE 4 END::INT AS label FROM range(21100) AS t(i)"
    duckdb.sql(f"COPY ({made}) TO '{folder}/embeddings.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["nearest_centroid", "category_centroids", "classify_uncategorized", "centroids_after_changes"])
def test_centroids_of_all_members(spark, many_members, name):
    """A centroid is the mean of all members, not of the newest 10,000."""
    connection = duckdb.connect()
    for path in pathlib.Path(many_members).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, want = catalog.queries()[name](spark, many_members).toPandas(), connection.sql(catalog.oracle_sql()[name]).df()
    assert len(want) and rows(got) == rows(want)


def test_without_training_operators(tmp_path):
    """The library and its entry still import where the folder of training-data operators is gone."""
    for name in ("gleaner", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_stats' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})
