"""Compare a query with its SQL on a table folder."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(rows):
    clean = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(map(clean, r)) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(spark, query, sql, folder):
    got = query(spark, folder)
    names = sorted(got.columns)
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(path := f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    want = con.sql(sql)
    assert sorted(want.columns) == names, (sorted(want.columns), names)
    a = rows_of([tuple(r[n] for n in names) for r in got.collect()])
    b = rows_of(want.select(*[f'"{n}"' for n in names]).fetchall())
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, (len(bad), names, bad[:3])
    return len(a)
