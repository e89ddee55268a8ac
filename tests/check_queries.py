"""python -m tests.check_queries [sf] [name …] — compare registered queries with their SQL."""

import sys
import time

import __spark_entry__ as entry
from gitloom.session import local_session, release
from tests.oracle import compare, duck


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), duck(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name, plan in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = plan(spark, sf)
            if name in oracles:
                answer = compare(con, frame, oracles[name]) or "ok"
            else:
                answer = f"ok, {frame.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            answer = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        bad += not answer.startswith("ok")
        print(f"{time.time() - start:6.2f}s {name}: {answer}", flush=True)
    release(spark)
    print("all equal" if not bad else f"{bad} differ")


if __name__ == "__main__":
    main()
