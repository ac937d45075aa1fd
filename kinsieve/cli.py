"""Command line: ``python -m kinsieve split --input IN.fasta`` and ``python -m kinsieve audit --dir FOLDER``."""

from __future__ import annotations

import argparse
from dataclasses import fields

from kinsieve.config import CHOICES, FLAGS, SplitConfig

#: Options of lists, and what they are made of.
_LISTS = {"kmer_sizes": int, "lsh_rows": int, "verification_metrics": str, "metric_weights": float}
_AUDIT = ("kmer_sizes", "seed", "diagnostics_sample_size")


def _list_of(kind: type):
    def parse(text: str) -> tuple:
        try:
            out = tuple(kind(x.strip()) for x in text.split(",") if x.strip())
        except ValueError as e:
            raise argparse.ArgumentTypeError(f"{text!r} is not a list of {kind.__name__}") from e
        if not out and kind is not str:
            raise argparse.ArgumentTypeError("an empty list")
        if kind is int and any(x < 1 for x in out):
            raise argparse.ArgumentTypeError("integers of 1 or more, separated by commas")
        return out

    return parse


def _options(parser: argparse.ArgumentParser, names: tuple[str, ...]) -> None:
    for f in fields(SplitConfig):
        if f.name not in names:
            continue
        flag = "--" + f.name.replace("_", "-")
        if f.name in FLAGS:
            parser.add_argument(flag, action="store_true")
        elif f.name in _LISTS:
            parser.add_argument(flag, type=_list_of(_LISTS[f.name]), default=f.default)
        elif f.name in CHOICES:
            parser.add_argument(flag, choices=CHOICES[f.name], default=f.default)
        else:
            parser.add_argument(flag, type=str if f.default is None else type(f.default), default=f.default)


def build_parser() -> argparse.ArgumentParser:
    """One option for each field of SplitConfig."""
    parser = argparse.ArgumentParser(prog="kinsieve", description="Leakage-aware splits of sequences, and audits of splits.")
    commands = parser.add_subparsers(dest="command", required=True)
    split = commands.add_parser("split", help="split a FASTA file")
    split.add_argument("--input", required=True)
    _options(split, tuple(f.name for f in fields(SplitConfig)))
    check = commands.add_parser("audit", help="audit train, val and test files")
    check.add_argument("--dir", required=True)
    _options(check, _AUDIT)
    for p in (split, check):
        p.add_argument("--output-dir", default="kinsieve_out")
        p.add_argument("--master", default=None, help="Spark master; else as the environment sets it")
    return parser


def main(argv: list[str] | None = None) -> int:
    from pyspark.errors import AnalysisException

    parser = build_parser()
    args = parser.parse_args(argv)
    try:
        config = SplitConfig(**{f.name: getattr(args, f.name) for f in fields(SplitConfig) if hasattr(args, f.name)})
        from pyspark.sql import SparkSession

        from kinsieve.plans import run

        builder = SparkSession.builder.appName("kinsieve")
        spark = (builder.master(args.master) if args.master else builder).getOrCreate()
        if args.command == "split":
            run.run_split(spark, args.input, args.output_dir, config)
        else:
            run.run_audit(spark, args.dir, args.output_dir, config)
    except (OSError, ValueError, AnalysisException) as e:  # the last for a path that Spark does not find
        parser.error(str(e))
    return 0
