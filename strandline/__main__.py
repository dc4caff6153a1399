"""Command line: ``python -m strandline COMMAND ...``; results go to the file ``-o`` or standard output, inputs may be ``-``."""

from __future__ import annotations

import argparse
import sys

from . import api


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline")
    top.add_argument("--bedtools-compatible", action="store_true", help="empty rows count as one base")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *, pair: bool = False, one: bool = False, genome: bool | None = None):
        p = sub.add_parser(name)
        if pair:
            p.add_argument("-a", required=True)
            p.add_argument("-b", required=True)
        if one:
            p.add_argument("-i", "--input", required=True)
        if genome is not None:
            p.add_argument("-g", "--genome", required=genome)
        p.add_argument("-o", "--output")
        p.add_argument("--assume-sorted", action="store_true", help="accepted; no command needs sorted input")
        p.add_argument("--allow-unsorted", action="store_true", help="accepted; no command needs sorted input")
        p.add_argument("--strict-sorted", action="store_true", help="fail if the input is not sorted")
        p.add_argument("--streaming", action="store_true", help="accepted; memory is bounded in any case")
        p.add_argument("--stats", action="store_true", help="print numbers of rows to standard error")
        if pair:
            p.add_argument("--same-strand", dest="strand_rule", action="store_const", const="same")
            p.add_argument("--opposite-strand", dest="strand_rule", action="store_const", const="opposite")
        return p

    flag = {"action": "store_true"}
    p = command("sort", one=True, genome=False)
    for name, mode in (("--sizeA", "size_asc"), ("--sizeD", "size_desc"), ("--chrThenSizeA", "chrom"), ("--natural", "natural")):
        p.add_argument(name, dest="mode", action="store_const", const=mode, default="default")
    p.add_argument("-r", "--reverse", **flag)
    p = command("merge", one=True)
    p.add_argument("-d", "--distance", type=int, default=0)
    p.add_argument("-s", "--strand", **flag)
    p.add_argument("-c", "--count", **flag)
    p = command("intersect", pair=True)
    for name in ("--wa", "--wb"):
        p.add_argument(name, f"-{name.strip('-')}", **flag)
    p.add_argument("-u", "--unique", **flag)
    p.add_argument("-v", "--no-overlap", **flag)
    p.add_argument("-c", "--count", **flag)
    p.add_argument("-f", "--fraction", type=float)
    p.add_argument("-F", "--fraction-b", type=float)
    p.add_argument("-r", "--reciprocal", **flag)
    p = command("subtract", pair=True)
    p.add_argument("-A", "--remove-entire", **flag)
    p.add_argument("-f", "--fraction", type=float)
    p.add_argument("-r", "--reciprocal", **flag)
    p = command("closest", pair=True)
    p.add_argument("-d", "--distance", **flag)
    p.add_argument("-t", "--tie", choices=("all", "first", "last"), default="all")
    p.add_argument("--io", "-io", **flag)
    p.add_argument("--iu", "-iu", **flag)
    p.add_argument("--id", "-id", **flag)
    p.add_argument("-D", "--max-distance", type=int)
    p = command("window", pair=True)
    p.add_argument("-w", "--window", type=int, default=1000)
    p.add_argument("-l", "--left", type=int)
    p.add_argument("-r", "--right", type=int)
    p.add_argument("-c", "--count", **flag)
    p.add_argument("-v", "--no-overlap", **flag)
    p = command("coverage", pair=True)
    p.add_argument("--hist", **flag)
    p.add_argument("-d", "--per-base", **flag)
    p.add_argument("--mean", **flag)
    p = command("slop", one=True, genome=True)
    p.add_argument("-b", "--both", type=float, default=0)
    p.add_argument("-l", "--left", type=float)
    p.add_argument("-r", "--right", type=float)
    p.add_argument("-s", "--strand", **flag)
    p.add_argument("--pct", **flag)
    command("complement", one=True, genome=True)
    p = command("genomecov", one=True, genome=True)
    p.add_argument("-d", "--per-base", **flag)
    p.add_argument("--bg", "-bg", **flag)
    p.add_argument("--bga", "-bga", **flag)
    p.add_argument("--scale", type=float, default=1.0)
    p.add_argument("--strand", choices=("+", "-"), dest="only_strand")
    command("jaccard", pair=True)
    p = command("multiinter")
    p.add_argument("-i", "--inputs", nargs="+", required=True)
    p.add_argument("--cluster", **flag)
    p.add_argument("--header", **flag)
    p = sub.add_parser("generate")
    p.add_argument("output")
    p.add_argument("--a", default="1M")
    p.add_argument("--b")
    p.add_argument("--mode", default="balanced")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--len-min", type=int, default=50)
    p.add_argument("--len-max", type=int, default=1000)
    return top


def run(args: argparse.Namespace) -> None:
    a = vars(args)
    strict = {"strict_sorted": a.get("strict_sorted", False)}
    rows: dict[str, object] = {}

    def read(path: str):
        if not (args.bedtools_compatible or a.get("stats")) and path != "-":
            return path
        df = api._slim(path, zero_length=args.bedtools_compatible)
        if a.get("stats"):
            df = api.counted(df, rows, f"rows of {path}")
        return df

    out, strand = a.get("output") or "-", a.get("strand_rule")
    match args.command:
        case "sort":
            api.sort(args.input, out, args.genome, args.mode, args.reverse)
        case "merge":
            api.merge(read(args.input), out, args.distance, args.strand, args.count, **strict)
        case "intersect":
            api.intersect(read(args.a), read(args.b), out, args.wa, args.wb, args.fraction, args.reciprocal, args.count, args.unique, args.no_overlap, args.fraction_b, strand, **strict)
        case "subtract":
            api.subtract(read(args.a), read(args.b), out, args.remove_entire, args.fraction, args.reciprocal, strand=strand, **strict)
        case "closest":
            api.closest(read(args.a), read(args.b), out, args.distance, args.tie, args.io, args.iu, args.id, args.max_distance, strand=strand, **strict)
        case "window":
            api.window(read(args.a), read(args.b), out, args.window, args.left, args.right, args.count, args.no_overlap, strand=strand, **strict)
        case "coverage":
            api.coverage(read(args.a), read(args.b), out, args.hist, args.mean, args.per_base, strand=strand, **strict)
        case "slop":
            api.slop(read(args.input), args.genome, out, args.both, args.left, args.right, args.strand, args.pct)
        case "complement":
            api.complement(read(args.input), args.genome, out)
        case "genomecov":
            api.genomecov(read(args.input), args.genome, out, args.bg, args.bga, args.per_base, args.scale, args.only_strand)
        case "jaccard":
            api.jaccard(read(args.a), read(args.b), out, strand)
        case "multiinter":
            api.multiinter([read(i) for i in args.inputs], out, args.cluster, args.header)
        case "generate":
            api.generate(f"{args.output}/A.bed", f"{args.output}/B.bed", args.a, args.b, args.mode, args.seed, len_min=args.len_min, len_max=args.len_max)
    for name, seen in rows.items():
        print(f"{name}: {seen.get['rows']}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        run(args)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
