"""python -m lakeplan --tables FOLDER [--data FOLDER] < script.sql"""

from __future__ import annotations

import argparse
import sys

from .session import session
from .sql_engine import SqlEngine


def main() -> int:
    parser = argparse.ArgumentParser(prog="lakeplan")
    parser.add_argument("--tables", help="folder of tables that statements may change")
    parser.add_argument("--data", help="folder of <name>.parquet tables")
    parser.add_argument("--master", default="local[*]")
    options = parser.parse_args()
    engine = SqlEngine(session(options.master), options.tables, options.data)
    for result in engine.script(sys.stdin.read()):
        print("|".join(result.columns))
        for row in result.toLocalIterator():
            print("|".join("NULL" if v is None else str(v) for v in row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
