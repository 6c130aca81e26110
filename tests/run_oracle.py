"""python tests/run_oracle.py <sf_dir> [name part ...]: compare registered queries with SQL."""

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import oracle  # noqa: E402
from conftest import make_session  # noqa: E402

from checks import ORACLE, QUERIES  # noqa: E402


def main():
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), oracle.connect(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in ORACLE:
                problem = oracle.differences(spark, con, sf_dir, fn, ORACLE[name])
            else:
                problem = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s", flush=True)
        if problem:
            print("    " + problem, flush=True)
    print("failed:", failed, "of", len(QUERIES))


if __name__ == "__main__":
    main()
