"""FASTA, FASTQ and text files as DataFrames. Paths may be lists, folders or globs; .gz is read by extension."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

EXTENSIONS = {"fasta": r"\.(fa|fna|fasta)(\.gz|\.gzip)?$", "fastq": r"\.(fq|fastq)(\.gz|\.gzip)?$"}


def read_text(spark: SparkSession, paths) -> DataFrame:
    """file, line."""
    return spark.read.text(paths).select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def read_fasta(spark: SparkSession, paths) -> DataFrame:
    """file, name, header, seq of each record.

    Records are split by the reader itself at a > that begins a line. Blank lines, comments (;)
    and white space are dropped; text before the first header is ignored, an empty record is kept.
    """
    whole = spark.read.option("lineSep", "\n>").text(paths).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r", "").alias("r"))
    first = F.col("r").startswith(">")
    body = F.when(first, F.substring("r", 2, 1 << 30)).otherwise(F.col("r"))
    # A file's first piece without > has no header, unless the split took it.
    lines = F.split(body, "\n")
    rows = whole.select("file", F.regexp_replace(F.element_at(lines, 1), r"\s+$", "").alias("header"), F.slice(lines, 2, 1 << 30).alias("lines"))
    rows = rows.filter("header <> '' OR size(lines) > 1").filter(~F.col("header").startswith(";"))
    sequence = F.regexp_replace(F.array_join(F.filter("lines", lambda x: ~F.ltrim(x).startswith(";")), ""), r"\s", "")
    return rows.select("file", text.first_word("header").alias("name"), "header", sequence.alias("seq"))


def with_values(records: DataFrame, value: Column, skip=None) -> DataFrame:
    """Adds value1, a function of the record's name; records with the skipped value are dropped."""
    out = records.withColumn("value1", value)
    return out if skip is None else out.filter(F.col("value1") != F.lit(skip))


def _numbered_lines(spark: SparkSession, paths) -> DataFrame:
    """file, n (from 0), line. Offsets count the lines of each file's partitions before, by two cheap passes.

    Both passes are planned from the same files and settings, so a row has the same id in each, also
    when a task is run again.
    """
    lines = spark.read.text(paths).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r$", "").alias("line"), F.monotonically_increasing_id().alias("id"))
    lines = lines.withColumn("part", F.shiftrightunsigned("id", 33))
    starts = lines.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("file", "part", "first", before.alias("before"))
    return lines.join(starts, ["file", "part"]).select("file", (F.col("id") - F.col("first") + F.col("before")).alias("n"), "line")


def _fastq_records(spark: SparkSession, paths) -> DataFrame:
    """file, read_id, h, seq, p, qual: the four lines of each record; missing ones are null."""
    lines = _numbered_lines(spark, paths).withColumn("read_id", F.floor(F.col("n") / 4)).withColumn("i", F.col("n") % 4)
    pick = lambda i: F.max(F.when(F.col("i") == i, F.col("line")))
    rows = lines.groupBy("file", "read_id").agg(pick(0).alias("h"), pick(1).alias("seq"), pick(2).alias("p"), pick(3).alias("qual"))
    return rows.filter("NOT (trim(h) = '' AND seq IS NULL)")


def _well_formed() -> Column:
    after = lambda c: F.substring(c, 2, 1 << 30)
    good = F.col("h").startswith("@") & F.col("p").startswith("+") & F.col("qual").isNotNull() & ((F.length("p") == 1) | (after("p") == after("h")))
    return F.coalesce(good, F.lit(False))


def read_fastq(spark: SparkSession, paths, dirty: bool = False) -> DataFrame:
    """file, read_id (in the file, from 0), header, seq, qual of each record of four lines.

    Unless dirty, a header without @, a third line without + or with another name, or a cut-off
    record is an error. A last record without final newline is kept.
    """
    rows = _fastq_records(spark, paths)
    if not dirty:
        error = F.raise_error(F.concat(F.lit("malformed FASTQ record "), F.col("read_id").cast("string"), F.lit(" in "), F.col("file")))
        rows = rows.withColumn("h", F.when(_well_formed(), F.col("h")).otherwise(error))
    return rows.select("file", "read_id", F.substring("h", 2, 1 << 30).alias("header"), "seq", "qual")


def fastq_report(spark: SparkSession, paths) -> DataFrame:
    """file, records, malformed: a validation report of FASTQ files."""
    return _fastq_records(spark, paths).groupBy("file").agg(F.count("*").alias("records"), F.count_if(~_well_formed()).alias("malformed"))


def pair_reads(first: DataFrame, second: DataFrame) -> DataFrame:
    """read_id, header1, seq1, header2, seq2 of two files read in step."""
    side = lambda df, i: df.select("read_id", F.col("header").alias(f"header{i}"), F.col("seq").alias(f"seq{i}"))
    return side(first, 1).join(side(second, 2), "read_id")


def check_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """The read_ids whose headers differ in their first word or that only one file has."""
    side = lambda df, i: df.select("read_id", F.regexp_replace(text.first_word("header"), "/[12]$", "").alias(f"name{i}"))
    return side(first, 1).join(side(second, 2), "read_id", "full").filter("NOT (name1 <=> name2)").select("read_id")


def read_sequences(spark: SparkSession, paths: list[str], kind: str | None = None, group: Column | None = None) -> DataFrame:
    """header, seq, group of FASTA and FASTQ files together, told apart by extension unless kind is given."""
    import re

    parts = []
    for name, reader in (("fasta", read_fasta), ("fastq", read_fastq)):
        own = [p for p in paths if kind == name or (kind is None and re.search(EXTENSIONS[name], p))]
        if own:
            parts.append(reader(spark, own).select("file", "header", "seq"))
    if not parts:
        raise ValueError("no FASTA or FASTQ file")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("group", F.lit("all") if group is None else group)


def write_fasta(records: DataFrame, path: str, width: int = 60) -> None:
    """Records (header, seq) as FASTA with lines of `width` letters."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    records.select(F.concat(F.lit(">"), "header", F.lit("\n"), body)).write.mode("overwrite").text(path)


def write_fastq(reads: DataFrame, path: str) -> None:
    """Reads (header, seq, qual) as FASTQ."""
    reads.select(F.concat(F.lit("@"), "header", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")).write.mode("overwrite").text(path)


def resolve_fastq(single: list[str] | None = None, paired: list[str] | None = None) -> list[tuple[str, str | None]]:
    """(file, mate or None) of each input; a paired one needs _R1, whose rightmost gives its mate's name."""
    out: list[tuple[str, str | None]] = [(path, None) for path in single or []]
    for path in paired or []:
        head, mark, end = path.rpartition("_R1")
        if not mark:
            raise ValueError(f"{path} has no _R1")
        out.append((path, f"{head}_R2{end}"))
    if len({p for pair in out for p in pair if p}) < sum(1 + (b is not None) for _, b in out):
        raise ValueError("a file is given twice")
    return out
