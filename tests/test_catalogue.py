"""Every query against its SQL, and those that SQL can't express against brute force."""

import duckdb
import pandas as pd
import pytest

from quillspark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v != v:
        return None
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, small, db, name):
    df = catalogue.queries()[name](spark, small)
    cur = db.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = [[_plain(r[columns.index(c)]) for c in sorted(columns)] for r in cur.fetchall()]
    got = [[_plain(r[c]) for c in sorted(columns)] for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_effort_by_brute_force(spark, small):
    got = {r.id: r.effort for r in catalogue.queries()["effort_score"](spark, small).collect()}
    c = pd.read_parquet(f"{small}/conversations.parquet")
    for i, g in c[c.role == "assistant"].sort_values("turn").groupby("conv_id"):
        if len(g) == 1:
            assert got[i] is None
        else:
            a, b = (" ".join(x.split(" ")).strip() for x in (g.text.iloc[0], g.text.iloc[-1]))
            if len(a) * len(b) < 400_000:
                assert abs(got[i] - _distance(a, b) / len(b)) < 0.02


def test_prompt_budget(spark, small):
    rows = catalogue.queries()["prompt_budget"](spark, small).collect()
    assert rows and all(r.tokens <= 3196 or r.dropped == 2 for r in rows)
