"""Command line: inspect, list-ops, list-configs, validate-config, convert and verify.

Exit codes: 0 fine, 1 a verification with findings, 2 an error of the library, 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import architectures, config
from .errors import LoomError
from .operators import registry
from .operators.quant import BITS, GROUPS
from .plans import convert, planner, selection, verify
from .sources import gguf


def bits(raw: str) -> str | int:
    if raw == "auto":
        return raw
    if raw.isdigit() and int(raw) in BITS:
        return int(raw)
    raise argparse.ArgumentTypeError(f"must be auto or one of {BITS}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [x := sub.add_parser(name), *[x.add_argument(a) for a in args]][0]
    add("inspect", "model")
    add("list-ops")
    for p in (add("list-configs"), add("validate-config", "config"), c := add("convert", "model", "output"), v := add("verify", "model", "output")):
        p.add_argument("--configs", action="append", default=[], help="folder with configurations; may be repeated")
    for p in (c, v):
        p.add_argument("--config", help="name or path; found by the model's architecture if left out")
        p.add_argument("--source-config", help="reference configuration in JSON")
        p.add_argument("--group-size", type=int, choices=GROUPS)
        p.add_argument("--code-books", help="code books in JSON, for types whose values are points of one")
    c.add_argument("--bits", type=bits, default="auto")
    c.add_argument("--no-quantize", action="store_true")
    c.add_argument("--quant-profile")
    c.add_argument("--tokenizer-source")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--report", help="where to write the report in JSON")
    v.add_argument("--bits", type=int, choices=BITS)
    v.add_argument("--tolerance", type=float)
    v.add_argument("--sampled", action="store_true")
    return top


def _planned(spark: SparkSession, args: argparse.Namespace, profile: config.Profile | None = None):
    model = gguf.open_model(spark, args.model, args.code_books)
    c = config.resolve_config(args.configs, args.config, model.header.arch)
    if profile:
        c, changed, idle = config.overlay(c, profile)
        for p in idle:
            print(f"warning: no quantized rule's dest has {p!r}", file=sys.stderr)
    reference = json.loads(Path(args.source_config).read_text("utf-8")) if args.source_config else None
    return planner.plan(spark, c, gguf.catalogue(spark, model.header), model.header.metadata, reference, model.header.arch), model


def inspect(spark: SparkSession, args: argparse.Namespace) -> int:
    header = gguf.read_header(args.model)
    print(f"{header.path}: {header.arch}, {len(header.metadata)} metadata keys")
    for r in selection.summary(gguf.catalogue(spark, header)).orderBy("qtype").collect():
        print(f"{r.qtype or 'all':>8} {r.n:>6} tensors {r.bytes / 2**20:>12.1f} MiB")
    return 0


def run_convert(spark: SparkSession, args: argparse.Namespace) -> int:
    profile = config.load_profile(args.quant_profile) if args.quant_profile else None
    plan, model = _planned(spark, args, profile)
    asked = config.conversion_setting(args.bits, profile and profile.bits, "--bits")
    group = config.conversion_setting(args.group_size, profile and profile.group_size, "--group-size") or 64
    decision = selection.select(spark, plan, None if args.no_quantize else asked)
    if decision.advice:
        print(f"warning: {decision.advice}", file=sys.stderr)
    print("\n".join(plan.summary()))
    if args.dry_run:
        return 0
    report = convert.convert(spark, plan, model, args.output, decision, group, args.tokenizer_source, args.overwrite)
    print(report.json())
    if args.report:
        Path(args.report).write_text(report.json(), "utf-8")
    return 0


def run_verify(spark: SparkSession, args: argparse.Namespace) -> int:
    plan, model = _planned(spark, args)
    report = verify.verify(spark, plan, model, args.output, args.bits, args.group_size, tol=args.tolerance, sample=args.sampled)
    print(f"{report.numeric} compared, {report.shapes} outputs, {report.finite} checked for finite values")
    for f in report.failures:
        print(f"FAIL {f}")
    return 0 if report.ok else 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    session = lambda: spark or SparkSession.builder.appName("sparkloom").getOrCreate()
    try:
        if args.command == "list-ops":
            for name in registry.all_ops():
                print(f"{name} ({registry.get_op(name).kind})")
        elif args.command == "list-configs":
            found = {k: "built in" for k in architectures.BUILT_IN} | {k: str(p) for k, p in config.discover(args.configs).items()}
            for name, where in found.items():
                print(f"{name}: {where}")
        elif args.command == "validate-config":
            c = config.resolve_config(args.configs, args.config)
            print(f"{c.id}: {len(c.rules)} rules, {len(c.dims)} dimensions")
        else:
            return {"inspect": inspect, "convert": run_convert, "verify": run_verify}[args.command](session(), args)
        return 0
    except LoomError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
