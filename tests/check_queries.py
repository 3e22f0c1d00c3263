"""Command line: compare queries with their SQL twins. ``python tests/check_queries.py SF_DIR [name ...]``"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, connect, type_differences  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from corpusmill.session import get_session  # noqa: E402


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = get_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, con, failed = entry.queries(), entry.oracle_sql(), connect(sf_dir), 0
    for name, fn in queries.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                df = fn(spark, sf_dir)
                problem, types = compare(df, con, oracles[name]), type_differences(df, con, oracles[name])
                note = f"ok {'; '.join(types)}" if problem is None else f"DIFF {problem}"
            else:
                note = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            note = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        failed += note.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - start:6.1f}s  {note}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
