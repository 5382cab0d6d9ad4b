"""Command line: train, infer, validate, package."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from kinlink.operators import validate
from kinlink.plans import inference
from kinlink.profiles import PROFILES
from kinlink.sources import sinks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kinlink", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("train", "infer"):
        sub = commands.add_parser(name)
        for s in ("source1", "source2", "source3"):
            sub.add_argument(f"--{s}", required=True)
        sub.add_argument("--model-path", required=True)
        sub.add_argument("--profile", choices=sorted(PROFILES), default="package")
        sub.add_argument("--folds", type=int, default=5)
        if name == "train":
            sub.add_argument("--truth", required=True)
            sub.add_argument("--trees", type=int, default=1000)
        else:
            sub.add_argument("--out", required=True)
            sub.add_argument("--threshold", type=float)
    commands.add_parser("validate", add_help=False)
    sub = commands.add_parser("package")
    sub.add_argument("--source1", required=True)
    sub.add_argument("--matching", required=True)
    sub.add_argument("--candidates", required=True)
    sub.add_argument("--code", required=True)
    sub.add_argument("--document")
    sub.add_argument("--out", required=True)
    args, rest = parser.parse_known_args(argv)
    if args.command == "validate":
        return validate.main(rest)
    if rest:
        parser.error(f"unknown arguments: {' '.join(rest)}")
    spark = SparkSession.builder.appName("kinlink").getOrCreate()
    sources = lambda: (args.source1, args.source2, args.source3)
    if args.command == "train":
        print("threshold", inference.train(spark, *sources(), args.truth, args.model_path, PROFILES[args.profile], args.folds, args.trees))
    elif args.command == "infer":
        inference.infer(spark, *sources(), args.model_path, args.out, PROFILES[args.profile], args.threshold, args.folds)
    else:
        report = validate.validate(spark, args.source1, args.matching, args.candidates)
        if report.exit_code:
            print(*report.errors, sep="\n")
            return report.exit_code
        print(*sinks.write_archive(args.out, [args.matching, args.candidates], args.code, document=args.document), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
