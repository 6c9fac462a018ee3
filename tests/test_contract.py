import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidewright.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1] / "tidewright"


def test_the_core_stands_without_the_subpackage():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"tidewright\.llm|from \.+llm|import llm", path.read_text()), path


def test_every_twin_has_its_query():
    assert not set(entry.oracle_sql()) - set(entry.queries())


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() > 0


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    own = duck.execute(catalog.ORACLE[name])
    columns = [c[0] for c in own.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(_norm, r)) for r in own.fetchall()), key=repr)
    got = sorted((tuple(_norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_twin_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
