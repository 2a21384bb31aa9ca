"""Command line: ``python -m cohortlens {convert,merge} ...`` (run through spark-submit on a cluster).

  convert  --src DIR --out DIR [--tables t1,t2]   typed CSV/Parquet tables -> Parquet, status table printed
  merge    --src DIR --out PATH [--subjects N]     study cohort (rules, subject sample, study join) -> Parquet
"""

from __future__ import annotations

import argparse
import sys

from cohortlens.plans.study import STUDY_TABLES, load_study_tables, study_cohort
from cohortlens.session import get_spark
from cohortlens.sources import sinks


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="cohortlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("convert", help="convert tables to Parquet")
    c.add_argument("--src", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--tables", default=",".join(STUDY_TABLES))
    m = sub.add_parser("merge", help="build the merged study table")
    m.add_argument("--src", required=True)
    m.add_argument("--out", required=True)
    m.add_argument("--subjects", type=int, default=None)
    ap.add_argument("--master", default=None, help="e.g. local[8]; omit under spark-submit")
    args = ap.parse_args(argv)

    spark = get_spark(args.master)
    if args.cmd == "convert":
        status = sinks.convert_tables(spark, args.src, [t for t in args.tables.split(",") if t], args.out)
        status.show(truncate=False)
        return 0 if status.where("status <> 'ok'").isEmpty() else 1
    merged = study_cohort(load_study_tables(spark, args.src), n_subjects=args.subjects)
    sinks.save_parquet(merged, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
