"""``python -m threadloom <mode> <input>``: prints the mode's JSON.

The driver's output is the result of a report; for large inputs call ``plans.modes.run`` and write its table.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans import modes
from .sources.readers import read_pagerank, read_traffic


def _write(out, objects) -> None:
    """A JSON array, an object at a time."""
    out.write("[")
    for k, x in enumerate(objects):
        out.write(",\n" if k else "\n")
        json.dump(x, out, ensure_ascii=False, indent=1)
    out.write("\n]")


def main(args: list[str] | None = None, out=sys.stdout) -> int:
    p = argparse.ArgumentParser(prog="threadloom")
    p.add_argument("mode", choices=modes.MODES)
    p.add_argument("input")
    p.add_argument("--ndocs", type=int, default=-1)
    p.add_argument("--save_not_news", action="store_true")
    p.add_argument("--languages", nargs="+", default=["ru", "en"])
    p.add_argument("--window_size", type=int, default=28800)
    p.add_argument("--print_top_debug_info", action="store_true")
    p.add_argument("--pagerank", help="lines of rating and host")
    p.add_argument("--traffic", help="JSON of hosts with ratings and country shares")
    o = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = modes.run(
        spark, o.mode, o.input, None if o.ndocs < 0 else o.ndocs, tuple(o.languages), o.save_not_news, o.window_size, o.print_top_debug_info,
        read_pagerank(spark, o.pagerank) if o.pagerank else None, read_traffic(spark, o.traffic) if o.traffic else None,
    )
    if o.mode == "news":
        json.dump(rows.first().asDict(), out, ensure_ascii=False, indent=1)
    elif o.mode == "json":
        _write(out, (json.loads(r["json"]) for r in rows.toLocalIterator()))
    elif o.mode == "top":
        _write(out, ({"category": r["category"], "threads": [json.loads(x) for x in r["threads"]]} for r in modes.nested(rows).toLocalIterator()))
    else:
        _write(out, ({k: v for k, v in r.asDict().items() if k != "thread_id"} for r in rows.toLocalIterator()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
