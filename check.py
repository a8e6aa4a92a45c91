"""Run registered queries next to their SQL and compare: ``check.py [sf_dir] [id prefix ...]``."""

from __future__ import annotations

import importlib
import sys
import time
import traceback

import duckdb
import pandas as pd

from tonemark.plans.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True) if len(frame) else frame


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = canonical(got), canonical(want)
    for name in got.columns:
        a, b = got[name], want[name]
        if a.dtype != b.dtype and not (a.dtype == object or b.dtype == object):
            return f"type of {name}: {a.dtype} != {b.dtype}"
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = same.idxmin()
            return f"{(~same).sum()} of {len(same)} differ in {name}: {a[at]!r:.120} != {b[at]!r:.120}"
    return "ok"


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session("check")
    parts = [a[1:] for a in args if a.startswith("@")]
    if parts:
        checks = {}
        for part in parts:
            checks.update(importlib.import_module(f"tonemark.queries.{part}").QUERIES)
    else:
        from tonemark.queries import all_checks

        checks = all_checks()
    wanted = [a for a in args if not a.startswith("@")]
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    bad = 0
    for key, check in checks.items():
        if wanted and key not in wanted:
            continue
        start = time.time()
        try:
            got = check.run(spark, sf).toPandas()
            spent = time.time() - start
            if check.sql is None:
                verdict = "ok (no SQL)"
            else:
                verdict = compare(got, db.sql(check.sql).df())
            verdict += "" if len(got) else " EMPTY"
        except Exception as error:  # noqa: BLE001
            spent, verdict = time.time() - start, f"{type(error).__name__}: {error}"[:1500]
            if wanted:
                traceback.print_exc()
        bad += not verdict.startswith("ok")
        print(f"{key:16s} {spent:6.2f}s {len(got) if verdict.startswith('ok') else 0:6d} rows  {verdict}", flush=True)
    print(f"{bad} failed")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
