"""python -m gneiss pack|inspect|verify|unpack|demo|measure: archives from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException

from gneiss.plans import archive, corpus, report
from gneiss.session import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gneiss")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("pack")
    p.add_argument("sources", nargs="+")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--average", type=int, default=65536)
    p.add_argument("--mode", choices=[*archive.POLICIES, "auto"], default="auto")
    p.add_argument("--codecs", choices=["auto", "stdlib"], default="auto", help="both mean raw, zlib and LZMA: external audio coders are no part of the engine")
    p.add_argument("--allow-growth", action="store_true")
    p.add_argument("--work-dir")
    for name in ("inspect", "verify", "unpack"):
        commands.add_parser(name).add_argument("archive")
    commands.choices["verify"].add_argument("--work-dir", help="taken for compatibility: nothing is written by verifying")
    commands.choices["unpack"].add_argument("-o", "--output", required=True)
    for name, what in (("demo", "five related files in a new folder: packed, verified, unpacked and compared"), ("measure", "the same for 17 groups of generated files, as a table")):
        commands.add_parser(name, help=what).add_argument("-o", "--output", required=True)
    a = parser.parse_args(argv)
    spark = session()
    try:
        if a.command == "measure":
            print(report.make_report(corpus.measured(spark, a.output, corpus.groups())), end="")
            return 0
        if a.command == "demo":
            result = corpus.demo(spark, a.output)
        elif a.command == "pack":
            result = archive.pack(spark, a.sources, a.output, average=a.average, mode=a.mode, allow_growth=a.allow_growth, work_dir=a.work_dir)
        elif a.command == "inspect":
            result = archive.inspect_archive(spark, a.archive)
        elif a.command == "verify":
            result = archive.verify(spark, a.archive)
        else:
            result = archive.unpack(spark, a.archive, a.output)
    except (ValueError, OSError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(json.dumps(result, indent=2, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
