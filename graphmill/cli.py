"""python -m graphmill.cli plan | run | backup | viewer ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from .plans import pipeline


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphmill")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("plan", "run"):
        q = sub.add_parser(name)
        q.add_argument("what", nargs="?", default="all", help="all, a stage, or from:<stage>")
        q.add_argument("--only", help="stages, apart by commas")
        q.add_argument("--config", help="a JSON or TOML file of settings")
        q.add_argument("--out")
        q.add_argument("--layouts", help="layouts, apart by commas")
        q.add_argument("--count", type=int)
        q.add_argument("--seed", type=int)
        q.add_argument("--parallel-layouts", type=int, help="taken and not needed: all layouts run in one pass over the cluster")
    q = sub.add_parser("backup")
    q.add_argument("table")
    q.add_argument("to")
    q = sub.add_parser("viewer")
    q.add_argument("drawings")
    q.add_argument("page")
    return p


def settings(a: argparse.Namespace) -> pipeline.Config:
    values: dict[str, object] = {}
    if a.config:
        if a.config.endswith(".toml"):
            import tomllib

            with open(a.config, "rb") as f:
                values = tomllib.load(f)
        else:
            with open(a.config) as f:
                values = json.load(f)
    if a.out:
        values["out"] = a.out
    config = pipeline.Config.of(values)
    over = {k: v for k, v in (("count", a.count), ("seed", a.seed), ("layouts", tuple(a.layouts.split(",")) if a.layouts else None)) if v is not None}
    return replace(config, **over)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "plan":
        print("\n".join(pipeline.plan(a.what, a.only.split(",") if a.only else None)))
        return 0
    from .session import session

    spark = session()
    if a.command == "run":
        done = pipeline.run(pipeline.Context(spark, settings(a)), a.what, a.only.split(",") if a.only else None)
        print("ran", *done)
    elif a.command == "backup":
        from .sources.sinks import Versioned

        print(Versioned(spark, a.table).backup(a.to))
    else:
        from .sources import readers, sinks

        print("listed", sinks.write_index(readers.list_drawings(spark, a.drawings), a.page))
    return 0


if __name__ == "__main__":
    sys.exit(main())
