"""Commands: count, filtercount, dump, optimize, histogram, diff, gainloss and check.

    python -m seqloom count --fastq a.fq.gz b.fq.gz --out counter -k 27 --rcmode max --value count 512

A file named - is standard input. Options of a hash table (page size, fill, walks and such) are
accepted, resolved and written beside the counter, but have no effect on its rows.
"""

import argparse
import sys

from .operators import compare, counters, statistics
from .session import scratch_path
from .sources import sequences, tables

# The hash table's options in the order of --parameters, and their defaults.
PHYSICAL = {"nobjects": 10_000_000, "type": "default", "hashfunctions": "random", "pagesize": 6, "fill": 0.9}


def resolve_parameters(positional: list[str] | None, singles: dict) -> dict:
    """Defaults, then the positional values (_ keeps what is there), then options given by name. type may end in :a or :u, for aligned or not."""
    found = {**PHYSICAL, "aligned": False}
    if len(positional or ()) > len(PHYSICAL):
        raise ValueError(f"at most {len(PHYSICAL)} parameters, not {len(positional)}")
    for (name, default), value in zip(PHYSICAL.items(), positional or ()):
        if value == "_":
            continue
        if name == "type":
            value, colon, aligned = value.partition(":")
            found["aligned"] = aligned.lower() == "a" if colon else found["aligned"]
        found[name] = type(default)(value)
    return found | {k: v for k, v in singles.items() if v is not None}


def _hash_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--parameters", "-P", nargs="+", metavar="VALUE", help=f"{', '.join(PHYSICAL)}, in this order; _ keeps a default")
    p.add_argument("--nobjects", "-n", type=int)
    p.add_argument("--type")
    p.add_argument("--aligned", action="store_const", const=True)
    p.add_argument("--unaligned", action="store_const", const=False, dest="aligned")
    p.add_argument("--hashfunctions", "--functions")
    p.add_argument("--pagesize", "-p", type=int)
    p.add_argument("--fill", type=float)
    for name in ("--nfingerprints", "--maxwalk", "--maxfailures", "--walkseed", "--shortcutbits", "--subtables"):
        p.add_argument(name, *(["-S"] if name == "--shortcutbits" else []), type=int, help="no effect")
    p.add_argument("--nostatistics", "--nostats", action="store_true", help="show no histogram at the end")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqloom", description=__doc__.split("\n")[0])
    commands = top.add_subparsers(dest="command", required=True)

    def counting(name: str, about: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=about)
        files = p.add_mutually_exclusive_group(required=True)
        files.add_argument("--fastq", "-q", nargs="+", metavar="FILE")
        files.add_argument("--fasta", "-f", nargs="+", metavar="FILE")
        files.add_argument("--paired", nargs="+", metavar="FILE", help="FASTQ files with _R1 in their names, whose _R2 is read too")
        p.add_argument("--out", "-o", required=True, help="folder of the counter")
        p.add_argument("--value", "-v", nargs="+", default=["count", "32"], metavar="ARG", help="value set and its arguments (count N)")
        p.add_argument("--kmersize", "-k", type=int, default=27)
        p.add_argument("--rcmode", choices=("f", "r", "both", "min", "max"), default="max")
        p.add_argument("--subsample", type=int, default=1, help="use every so many-th read of a file")
        _hash_options(p)
        return p

    counting("count", "count k-mers")
    filtered = counting("filtercount", "count k-mers that are seen often enough")
    filtered.add_argument("--filter", nargs="+", metavar="FILE", help="files that decide on the k-mers (default: the counted ones)")
    filtered.add_argument("--sightings", type=int, default=1, help="k-mers must be seen more often than this")

    dump = commands.add_parser("dump", help="write a counter as CSV or Parquet")
    dump.add_argument("--index", "-i", required=True)
    dump.add_argument("--out", "-o", required=True)
    dump.add_argument("--text", action="store_true", help="CSV with codes as letters")
    dump.add_argument("--values", nargs="+", help="such as 1,3-5 or 1 3-5")

    optimize = commands.add_parser("optimize", help="rewrite a counter in fewer, sorted files")
    optimize.add_argument("--index", "-i", required=True)
    optimize.add_argument("--out", "-o", required=True)
    optimize.add_argument("--partitions", "-p", type=int, default=1)

    histogram = commands.add_parser("histogram", help="value histogram of a counter and its solid threshold")
    histogram.add_argument("--index", "-i", required=True)
    histogram.add_argument("--out", "-o", help="folder for a CSV; shown if not given")

    diff = commands.add_parser("diff", help="codes that are frequent in one counter and rare in the other, both ways")
    diff.add_argument("first")
    diff.add_argument("second")
    diff.add_argument("--out", "-o", required=True, help="folder; first and second are CSVs in it")
    diff.add_argument("--mincount", type=int, nargs=2, metavar="N", help="least value in each counter (default: as many codes as the other has)")
    diff.add_argument("--below", type=int, default=2, help="values in the other counter are less than this")

    gainloss = commands.add_parser("gainloss", help="lost and gained codes of a case and a control counter")
    for name in ("case", "control", "bait", "genomic"):
        gainloss.add_argument(f"--{name}", required=True)
    gainloss.add_argument("--out", "-o", required=True)

    check = commands.add_parser("check", help="validate FASTQ files")
    check.add_argument("fastq", nargs="+")
    return top


def run(args: argparse.Namespace, spark) -> int:
    if args.command == "check":
        report = sequences.fastq_report(spark, args.fastq)
        report.show(1000, False)
        return int(not report.filter("malformed > 0").isEmpty())
    if args.command == "dump":
        table, info = tables.load_counter(spark, args.index)
        table = counters.select_values(table, ",".join(args.values)) if args.values else table
        tables.write_dump(table, args.out, info.k, "csv" if args.text else "parquet")
        return 0
    if args.command == "optimize":
        table, info = tables.load_counter(spark, args.index)
        tables.save_counter(table, args.out, info, args.partitions)
        return 0
    if args.command == "histogram":
        table, _ = tables.load_counter(spark, args.index)
        found = statistics.value_histogram(table).orderBy("value")
        if args.out:
            found.coalesce(1).write.mode("overwrite").csv(args.out, header=True)
        else:
            found.show(1 << 20, False)
        statistics.solid_threshold(found).show()
        return 0
    if args.command == "diff":
        (a, info), (b, other) = tables.load_counter(spark, args.first), tables.load_counter(spark, args.second)
        counters.check_same(info, other)
        for name, x, y, least in (("first", a, b, 0), ("second", b, a, 1)):
            least = args.mincount[least] if args.mincount else compare.default_mincount(x, y).first()[0]
            found = compare.difference(x, y, least, args.below)
            found.withColumn("code", counters.dna.text("code", info.k)).write.mode("overwrite").csv(f"{args.out}/{name}", header=True)
        return 0
    if args.command == "gainloss":
        loaded = [tables.load_counter(spark, getattr(args, n)) for n in ("case", "control", "bait", "genomic")]
        counters.check_same(*[info for _, info in loaded])
        found = compare.gain_loss(*[t for t, _ in loaded], compare.is_loss(), compare.is_gain())
        found.write.mode("overwrite").option("sep", " ").csv(args.out)
        return 0
    if args.value[0] != "count":
        raise SystemExit(f"value set {args.value[0]!r} cannot count reads; use count N")
    info = counters.Parameters(args.kmersize, args.rcmode, int((args.value[1:] or ["32"])[0]))

    def reads(paths):
        paths, fasta = [_standard_input(spark) if p == "-" else p for p in paths], paths is args.fasta
        if fasta:
            return sequences.read_fasta(spark, paths)
        from .operators.kmers import subsample

        return subsample(sequences.read_fastq(spark, paths, dirty=True), args.subsample)

    pairs = sequences.resolve_fastq(paired=args.paired) if args.paired else []
    own = reads(args.fasta or args.fastq or [p for pair in pairs for p in pair])
    if args.command == "count":
        table = counters.count(own, info.k, info.mode, info.nvalues)
    else:
        table = counters.filtered_count(own, info.k, args.sightings, reads(args.filter) if args.filter else None, info.mode, info.nvalues)
    singles = {n: getattr(args, n) for n in (*PHYSICAL, "aligned")}
    tables.save_counter(table, args.out, info, physical=resolve_parameters(args.parameters, singles))
    if not args.nostatistics:
        statistics.value_histogram(tables.load_counter(spark, args.out)[0]).orderBy("value").show(info.nvalues, False)
    return 0


def _standard_input(spark) -> str:
    """Standard input as a file that executors can read."""
    from pyarrow import fs

    path = scratch_path(spark, "stdin") + "/input"
    files, place = fs.FileSystem.from_uri(path)
    with files.open_output_stream(place, compression=None) as out:
        while data := sys.stdin.buffer.read(1 << 20):
            out.write(data)
    return path


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    return run(args, SparkSession.builder.appName("seqloom").getOrCreate())


if __name__ == "__main__":
    sys.exit(main())
