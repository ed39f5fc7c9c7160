"""Store a CSV log without ids as a table partitioned by step."""

from __future__ import annotations

import argparse

from riskloom.plans.session import session
from riskloom.sources.transactions import import_csv


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--csv", required=True)
    parser.add_argument("--table", required=True, help="new folder; read <table>/by_step later")
    args = parser.parse_args()
    import_csv(session("ingest"), args.csv, args.table)


if __name__ == "__main__":
    main()
