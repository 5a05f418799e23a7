"""python -m subsumer -input FILE [-output FILE] [-format auto|obo|owl] [-pretty] [-classify]"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .classify import classify
from .operators.export import write_classified, write_json
from .sources import detect_format, read_ontology


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("subsumer")
    p.add_argument("-input", required=True)
    p.add_argument("-output")
    p.add_argument("-format", default="auto")
    p.add_argument("-pretty", action="store_true")
    p.add_argument("-classify", action="store_true")
    a = p.parse_args(argv)
    try:
        kind = detect_format(a.input, a.format)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("subsumer").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    start = time.monotonic()
    try:
        ontology = read_ontology(spark, a.input, kind)
        n = ontology.terms.count()
    except Exception as e:  # whatever stops the parse is the user's message
        print(f"Error parsing: {e}", file=sys.stderr)
        return 1
    took = time.monotonic() - start
    print(f"Parsed {n} terms in {took:.2f} s", file=sys.stderr)
    out = a.output or sys.stdout
    if a.classify:
        found = classify(ontology, parse_ms=round(1000 * took))
        write_classified(found.hierarchy, found.stats, out)
    else:
        write_json(ontology, out, pretty=a.pretty)
    return 0


if __name__ == "__main__":
    sys.exit(main())
