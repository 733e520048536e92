"""Job entry point (for ``spark-submit`` or ``python -m snapplan``).

    python -m snapplan run --roots "/data/a;/data/b" --store /backup/store \\
        --state /backup/state --work /backup/work [--ignore "*.tmp,node_modules"] \\
        [--ignore-file rules.txt] [--mode safe|fast] [--dry-run] [--job name] [--depth 3]

Plain job arguments; settings files are not parsed here (layered settings
arrive as a table, see ``operators.overlay``).  Inline rules (split on
``,``/``;``) and rule-file lines (trimmed, comments dropped) are unioned.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .plans.run import run_snapshot
from .session import build_session
from .sources import rules as RU

def _rules(spark, inline: str | None, rule_file: str | None) -> list[str]:
    sources = []
    if inline:
        df = spark.createDataFrame([(inline,)], "v string")
        sources.append(RU.explode_list(df, "v", "pattern").select(F.col("pos").cast("long").alias("ord"), "pattern"))
    if rule_file:
        sources.append(RU.read_rules(spark, rule_file).select(F.col("ord").cast("long"), "pattern"))
    if not sources:
        return []
    rules = RU.union_rules(*sources)
    return [r.pattern for r in rules.orderBy("source", "ord").collect()]


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="snapplan")
    sub = ap.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run", help="scan, plan, copy, manifest, state")
    r.add_argument("--roots", required=True)
    r.add_argument("--store", required=True)
    r.add_argument("--state", required=True)
    r.add_argument("--work", required=True)
    r.add_argument("--ignore")
    r.add_argument("--ignore-file")
    r.add_argument("--mode", choices=["safe", "fast"], default="fast")
    r.add_argument("--dry-run", action="store_true")
    r.add_argument("--job", default="job")
    r.add_argument("--depth", type=int, default=3)
    a = ap.parse_args(argv)

    spark = build_session()
    roots = [x.strip() for x in a.roots.replace(";", ",").split(",") if x.strip()]
    ignore = _rules(spark, a.ignore, a.ignore_file)
    summary = run_snapshot(spark, roots, a.store, a.state, a.work, ignore=ignore, mode=a.mode,
                           dry_run=a.dry_run, job=a.job, depth=a.depth).first().asDict()
    print(json.dumps(summary))
    return 0


if __name__ == "__main__":
    sys.exit(main())
