"""Command line: ``python -m sievemill.plans.cli search "..." --root DIR``."""

from __future__ import annotations

import argparse

from ..session import get_spark
from ..sources import repo
from . import planner


def settings(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="sievemill")
    parser.add_argument("verb", choices=["search", "symbol", "dependency", "tests", "status", "index"])
    parser.add_argument("text", nargs="?", default="")
    parser.add_argument("--root", default=".")
    parser.add_argument("--budget", type=int, default=planner.BUDGET)
    parser.add_argument("--max-results", type=int, default=planner.MAX_RESULTS)
    parser.add_argument("--direction", default="callers")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--index", default=None, help="folder of stored index tables: written by the verb index, read by the others")
    parser.add_argument("--debug", action="store_true", help="print the plan of the result first")
    return parser.parse_args(argv)


def open_index(spark, a: argparse.Namespace) -> planner.Index:
    if a.index and a.verb != "index":
        return planner.load_index(spark, a.index)
    return planner.build_index(repo.parseable(repo.scan(spark, a.root, ignore_files=True)))


def main(argv: list[str] | None = None) -> None:
    a = settings(argv)
    spark = get_spark()
    ix = open_index(spark, a)
    if a.verb == "index":
        ix = planner.store_index(ix, a.index or f"{a.root.rstrip('/')}/.sievemill/index")
    options = {"max_results": a.max_results}
    if a.verb in ("status", "index"):
        out = planner.status(ix)
    elif a.verb == "dependency":
        out = planner.dependency(ix, a.text, a.direction, **options)
    elif a.verb == "search" and not a.json:
        print(planner.search_pack(ix, a.text, budget=a.budget, **options).first().markdown)
        return
    else:
        out = {"search": planner.search, "symbol": planner.symbol, "tests": planner.tests}[a.verb](ix, a.text, **options)
    if a.debug:
        out.explain("formatted")
    for line in out.toJSON().toLocalIterator():
        print(line)


if __name__ == "__main__":
    main()
