"""Compare a registered query with its SQL oracle, values included."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return float(f"{float(v):.10g}")
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want_cols, want = canonical(names, cur.fetchall())
    got_cols, got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if want_cols != got_cols:
        return [f"columns: spark {got_cols} oracle {want_cols}"]
    if len(want) != len(got):
        extra = [r for r in got if r not in want][:2] if len(got) < 5000 else []
        lack = [r for r in want if r not in got][:2] if len(want) < 5000 else []
        return [f"rows: spark {len(got)} oracle {len(want)} extra {extra} lack {lack}"]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    types = []
    if got and not bad:
        for i, c in enumerate(got_cols):
            a = {type(r[i]).__name__ for r in got if r[i] is not None}
            b = {type(r[i]).__name__ for r in want if r[i] is not None}
            if a != b:
                types.append(f"type of {c}: spark {a} oracle {b}")
    return [f"row: spark {g}\n     oracle {w}" for g, w in bad[:2]] + ([f"{len(bad)} bad of {len(got)}"] if bad else []) + types
