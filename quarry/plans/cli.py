"""Command line: python -m quarry.plans.cli [--verb=ARG ...] ROOT."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.relations import naive_cost
from . import ledger
from .incremental import open_index
from .render import render
from .verbs import choose_verb, run_verb

HELP = """usage: quarry [verb] [options] ROOT
verbs: (none) ranked map | --grep=TEXT | --callers=SYM | --callees=SYM | --for=TASK | --uses=SYM | --at=FILE:LINE
       --expand=SYM | --impact=SYM [--depth=N] | --from-trace=FILE | gain
options: --no-cache  --no-gain-log  --gain-log=PATH
SYM is a name or FILE:NAME."""


def parse(args: list[str]) -> tuple[dict[str, str | None], str]:
    """(flags, root): the last plain argument is the root."""
    flags: dict[str, str | None] = {}
    root = "."
    for a in args:
        if a == "gain":
            flags["gain"] = ""
        elif a.startswith("--"):
            name, _, value = a[2:].partition("=")
            flags[name] = value
        else:
            root = a
    return flags, root


def main(args: list[str]) -> str:
    if any(a in ("-h", "--help", "help") for a in args):
        return HELP
    flags, root = parse(args)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    path = ledger.ledger_path(flags.get("gain-log") or None)
    if choose_verb(flags) == "gain":
        return ledger.report(spark, path)
    if flags.get("from-trace"):
        with open(flags["from-trace"]) as f:
            flags["from-trace"] = f.read()
    began = time.time()
    opened = open_index(spark, root, use_saved="no-cache" not in flags)
    verb, answer = run_verb(opened.index, flags)
    doc = render(verb, opened.index, answer, root)
    if "no-gain-log" not in flags:
        tokens = answer[0]
        files = naive_cost(tokens.select(F.col("path")), opened.index.files).first()["naive_tokens"] if "path" in tokens.columns else None
        ledger.log_run(spark, path, root, verb, int(len(doc.encode()) / 3.8 + 0.5), int((time.time() - began) * 1000), files)
    return doc


if __name__ == "__main__":
    print(main(sys.argv[1:]))
