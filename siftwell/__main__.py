"""python -m siftwell --input PATH [PATH ...] --output ROOT: builds an index.  Exit codes: 0, 1 (failed), 2 (usage)."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import Observation, SparkSession

from .engine import build_index
from .sources import read_corpus


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siftwell")
    p.add_argument("--input", nargs="+", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--no-stemming", action="store_true")
    p.add_argument("--title-boost", type=float, default=3.0)
    p.add_argument("--max-body", type=int, default=0)
    p.add_argument("--skip-errors", action="store_true")
    p.add_argument("--any-order", action="store_true", help="leave out the sort by file name, which shuffles all texts")
    o = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    counters, start = Observation(), time.monotonic()
    try:
        docs = read_corpus(spark, o.input, on_bad="skip" if o.skip_errors else "fail", max_body=o.max_body, ordered=not o.any_order, counters=counters)
        made = build_index(docs, o.output, stemming=not o.no_stemming, title_boost=o.title_boost, empty=False)
    except Exception as e:  # the reason, without a trace
        print(f"error: {e}", file=sys.stderr)
        if "bad input" in str(e):
            print("hint: --skip-errors keeps what stands before a bad place", file=sys.stderr)
        return 1
    print(f"{made['documents']:,} documents, {made['terms']:,} terms, {made['words']:,} words, {made['bytes']:,} bytes in {time.monotonic() - start:.1f} s")
    for name, what in (("empty", "documents without text"), ("bad", "files that end at a bad place")):
        if counters.get[name]:
            print(f"left out: {counters.get[name]:,} {what}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
