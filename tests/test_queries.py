"""Every registered query of the library against its DuckDB counterpart on the smallest tables."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tessera import plans

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 9) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.skipif(not DATA.exists(), reason="needs the supplied tables")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, str(DATA))
    want = duck.execute(plans.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    rows = lambda found, names: sorted((tuple(plain(r[names.index(c)]) for c in sorted(columns)) for r in found), key=repr)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), columns)


@pytest.mark.skipif(not DATA.exists(), reason="needs the supplied tables")
def test_reading_order_has_every_region(spark):
    """Each line of lineitem has a place, and an image's places are 0, 1, 2 and so on."""
    want, places = Counter(), {}
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_linenumber").collect():
        want[tuple(r)] += 1
    got = plans.QUERIES["reading_order"](spark, str(DATA)).collect()
    assert Counter((r.image, r.ord) for r in got) == want
    for r in got:
        places.setdefault(r.image, []).append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_library_without_training_operators():
    """Nothing outside the training-data subpackage may import it."""
    root = Path(__file__).parents[1] / "tessera"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tessera.llm" not in p.read_text(), p
