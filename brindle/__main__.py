"""The requests of ``EvidenceService`` from a command line: a report as JSON on standard output.

    python -m brindle <folder> <request> [--query ...] [--symbols A B] [--ref HEAD~1] ...
    python -m brindle summary <saved run>

Arguments are those of the request's method.  The exit code is 2 for requests
that are out of bounds.
"""

from __future__ import annotations

import argparse
import inspect
import json
import sys
import typing

from pyspark.sql import SparkSession

from .plans.investigate import investigate
from .plans.service import EvidenceService, load_summary

#: What stands in a method's place where it passes its arguments on.
SIGNATURES = {"investigate": investigate}
OWN = ("self", "spark", "root", "notes", "clock", "units_at")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m brindle", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("folder", help="the source tree")
    verbs = top.add_subparsers(dest="verb", required=True)
    for name in EvidenceService.VERBS:
        verb = verbs.add_parser(name)
        method = SIGNATURES.get(name, getattr(EvidenceService, name))
        kinds = typing.get_type_hints(method)
        for p in inspect.signature(method).parameters.values():
            if p.name in OWN:
                continue
            kind = next(k for k in (int, float, list, str) if k in (kinds[p.name], *(typing.get_origin(k) or k for k in typing.get_args(kinds[p.name]))))
            many = {"nargs": "+"} if list in (typing.get_origin(kinds[p.name]), *(typing.get_origin(k) for k in typing.get_args(kinds[p.name]))) else {"type": kind}
            verb.add_argument(f"--{p.name.replace('_', '-')}", required=p.default is p.empty, default=argparse.SUPPRESS, **many)
        verb.add_argument("--detail", default="compact", help="compact or full")
        verb.add_argument("--notes-at", help="folder of the lessons")
        verb.add_argument("--units-at", help="folder of stored units")
    return top


def main(args: list[str], spark: SparkSession | None = None) -> int:
    try:
        if args[:1] == ["summary"] and len(args) == 2:
            report = load_summary(args[1])
        else:
            given = vars(parser().parse_args(args))
            own = {k: given.pop(k) for k in ("folder", "verb", "detail", "notes_at", "units_at")}
            spark = spark or SparkSession.builder.appName("brindle").config("spark.sql.session.timeZone", "UTC").getOrCreate()
            report = EvidenceService(spark, own["folder"], own["notes_at"], own["units_at"]).tool(own["verb"], own["detail"], **given)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(json.dumps(report, indent=2, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
