"""``python -m refrain [options] PATH...``: detect, report, and leave an exit code."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from refrain import engine
from refrain.operators import baseline
from refrain.reports import rows, writers
from refrain.sources import formats, options


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("refrain")
    p.add_argument("paths", nargs="*")
    p.add_argument("--config")
    for name, kind in (("min-tokens", int), ("min-lines", int), ("max-lines", int), ("max-size", str), ("mode", str), ("output", str), ("pattern", str), ("threshold", float), ("exit-code", int)):
        p.add_argument(f"--{name}", type=kind)
    for name in ("formats", "ignore", "ignore-pattern", "reporters"):
        p.add_argument(f"--{name}", type=lambda s: s.split(","))
    p.add_argument("--formats-exts", type=options.parse_mappings)
    p.add_argument("--formats-names", type=options.parse_mappings)
    p.add_argument("--cross-formats", type=options.parse_groups)
    p.add_argument("--skip-isolated", type=options.parse_isolation)
    for name in ("ignore-case", "skip-local", "absolute", "summary", "lossy"):
        p.add_argument(f"--{name}", action="store_true", default=None)
    p.add_argument("--no-gitignore", dest="gitignore", action="store_false", default=None)
    p.add_argument("--skip-comments", dest="mode", action="store_const", const="weak", help="as --mode weak")
    p.add_argument("--silent", dest="reporters", action="store_const", const=["silent"])
    for name, kind in (("store", str), ("store-path", str), ("baseline", str), ("summary-top", int), ("summary-by", str), ("sarif-error-tokens", int)):
        p.add_argument(f"--{name}", type=kind)
    p.add_argument("--update-baseline", action="store_true", help="write --baseline anew and tell what changed")
    p.add_argument("--baseline-from", help="compare with another snapshot of the paths, one tree: a checkout of a reference")
    p.add_argument("--fail-on-new-clones", type=int, nargs="?", const=0)
    p.add_argument("--list", action="store_true", help="list formats and leave")
    p.add_argument("--debug", action="store_true", help="print the options and leave")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = vars(parser().parse_args(argv))
    if given.pop("list"):
        print("\n".join(formats.list_formats()))
        return 0
    debug, config = given.pop("debug"), given.pop("config")
    update, snapshot, allowed = given.pop("update_baseline"), given.pop("baseline_from"), given.pop("fail_on_new_clones")
    given["paths"] = given["paths"] or None
    chosen, warnings = options.load(given, config)
    for w in warnings:
        print(w, file=sys.stderr)
    if debug:
        print(chosen)
        return 0
    spark = spark or SparkSession.builder.appName("refrain").getOrCreate()
    accepted = None
    if snapshot:
        accepted = engine.baseline_from(spark, replace(chosen, paths=[snapshot]))
    elif chosen.baseline and not (update and not os.path.exists(chosen.baseline)):
        accepted = baseline.load(spark, chosen.baseline)
    result = engine.run(spark, chosen, accepted=accepted)
    if chosen.baseline and update:
        now = baseline.build(baseline.fingerprints(result.clones.drop("fingerprint", "is_new"), result.arrays))
        change = baseline.diff(accepted if accepted is not None else now.limit(0), now).first()
        baseline.save(now, chosen.baseline)
        print(f"baseline: {change.added} added, {change.removed} removed, {change.total} in all")
    screen = {"console", "console-full", "ai", "xcode", "silent"}
    kinds = [{"full": "console-full", "consoleFull": "console-full"}.get(k, k) for k in chosen.reporters if k != "threshold"]
    told = rows.with_fragments(result.clones, result.sources) if {"json", "xml", "console-full"} & set(kinds) else result.clones
    for kind in kinds:
        if kind in screen:
            print(writers.report(kind, told, result.statistics))
    writers.write([k for k in kinds if k not in screen], told, result.statistics, chosen.output, chosen.sarif_error_tokens)
    if chosen.summary:
        print(writers.summary_block(*result.summary(chosen.summary_by, chosen.summary_top), chosen.summary_by))
    return result.exit_code(chosen, None if update else allowed)


if __name__ == "__main__":
    sys.exit(main())
