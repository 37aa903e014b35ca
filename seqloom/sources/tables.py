"""Region, BED, protein, gene and candidate files, thresholds, and stored counters."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators.counters import Parameters, marked

BED = "acc string, start0 bigint, end0 bigint, what string, dot string, strand string, refseq string, region string, dot2 string, extra string"
PROTEINS = "ch string, acc string, start bigint, stop bigint, strand string, geneid string, locus string, tag string, product string, length bigint, pname string"


def read_bed(spark: SparkSession, paths) -> DataFrame:
    return spark.read.csv(paths, sep="\t", schema=BED)


def read_proteins(spark: SparkSession, paths) -> DataFrame:
    """Rows of chromosomes and the mitochondrion; # lines are comments."""
    rows = spark.read.csv(paths, schema=PROTEINS, comment="#")
    return rows.filter(F.lower("ch").rlike("chromosome|mitochondri"))


def read_regions(spark: SparkSession, paths, exons: bool = False) -> DataFrame:
    """region, gene (and exons, an array) of lines `region gene [n exon1 .. exonn]`."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(paths).filter("trim(value) <> '' AND NOT startswith(trim(value), '#')").select(words.alias("w"))
    base = rows.select(F.element_at("w", 1).alias("region"), F.element_at("w", 2).alias("gene"), "w")
    if exons:
        base = base.withColumn("exons", F.slice("w", 4, F.element_at("w", 3).cast("int")))
    return base.drop("w")


def read_gene_table(spark: SparkSession, paths) -> DataFrame:
    """rank, rate1, rate2, gene, region, length, nloss, nv of a tab-separated gene table."""
    c = F.split("value", "\t")
    part = lambda i: F.element_at(c, i)
    number = lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("bigint")
    rows = spark.read.text(paths).filter("trim(value) <> ''")
    return rows.select(number(part(1)).alias("rank"), number(part(2)).alias("rate1"), number(part(3)).alias("rate2"), part(4).alias("gene"), part(5).alias("region"), number(part(6)).alias("length"), number(part(7)).alias("nloss"), number(part(8)).alias("nv"))


def write_gene_table(table: DataFrame, path: str) -> None:
    """The ranked losses table as tab-separated text."""
    line = F.concat_ws("\t", "rank", F.concat("rate1", F.lit(" lost/Mbp")), F.concat("rate2", F.lit(" var/Mbp")), "gene", "region", F.concat(F.lit("length="), "length"), F.concat(F.lit("nloss="), "n1"), F.concat(F.lit("nv="), "n2"))
    table.orderBy("rank").select(line).write.mode("overwrite").text(path)


def read_candidates(spark: SparkSession, paths) -> DataFrame:
    """code, vo, vm, vb, vg, type of candidate lines; a loss must have vb 2 and vg 1, a gain 0 and 0."""
    w = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(paths).filter("trim(value) <> ''").select(*[F.element_at(w, i + 1).cast("bigint").alias(n) for i, n in enumerate(("code", "vo", "vm", "vb", "vg"))], F.element_at(w, 6).alias("type"))
    good = (F.col("type").endswith("loss") & (F.col("vb") == 2) & (F.col("vg") == 1)) | (F.col("type").endswith("gain") & (F.col("vb") == 0) & (F.col("vg") == 0))
    return rows.withColumn("type", F.when(good, F.col("type")).otherwise(F.raise_error(F.lit("a candidate does not fit its type"))))


def read_thresholds(spark: SparkSession, paths) -> DataFrame:
    """sample (the file's stem), threshold (the file's first number)."""
    rows = spark.read.text(paths, wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("sample"), F.regexp_extract("value", r"^\s*(\d+)", 1).cast("bigint").alias("threshold"))


def read_samples(spark: SparkSession, paths, exclude: str | None = None) -> DataFrame:
    """sample, unit, fq1, fq2 of a tab-separated list with # comments."""
    rows = spark.read.csv(paths, sep="\t", comment="#", schema="sample string, unit string, fq1 string, fq2 string").filter("sample <> 'sample'")
    return rows if exclude is None else rows.filter(~F.col("fq1").contains(exclude))


def read_value_statistics(spark: SparkSession, path: str) -> DataFrame:
    """value, freq of the "Value statistics:" block of a log, which a blank line ends."""
    log = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)Value statistics:\s*\n(.*?)(\n\s*\n|$)", 1).alias("b"))
    line = log.select(F.explode(F.regexp_extract_all("b", F.lit(r"(?m)^\s*(\d+\s*:\s*\d+)"), F.lit(1))).alias("x"))
    return line.select(F.trim(F.split("x", ":")[0]).cast("bigint").alias("value"), F.trim(F.split("x", ":")[1]).cast("bigint").alias("freq"))


def _write_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_counter(table: DataFrame, path: str, parameters: Parameters, partitions: int | None = None, physical: dict | None = None) -> None:
    """Parquet at path/table, sorted by code within partitions, and its parameters at path/info; physical ones are stored with them and not used."""
    rows = table.repartition(partitions, "code") if partitions else table.repartition("code")
    rows.sortWithinPartitions("code").write.mode("overwrite").parquet(f"{path}/table")
    _write_json(table.sparkSession, f"{path}/info", parameters.asdict() | ({"physical": physical} if physical else {}))


def load_counter(spark: SparkSession, path: str) -> tuple[DataFrame, Parameters]:
    info = json.loads(spark.read.text(f"{path}/info").first()[0])
    info.pop("physical", None)
    return marked(spark.read.parquet(f"{path}/table"), info["k"], info["mode"]), Parameters(**info)


def write_dump(table: DataFrame, path: str, k: int, fmt: str = "csv") -> None:
    """Codes as letters in a CSV with header, or codes in Parquet."""
    if fmt == "csv":
        table.select(dna.text("code", k).alias("code"), "value").write.mode("overwrite").csv(path, header=True)
    else:
        table.write.mode("overwrite").parquet(path)


def save_group(path: str, frames: dict[str, DataFrame] | None = None, attributes: dict | None = None, spark: SparkSession | None = None) -> None:
    """Tables by name at path/tables and attributes (JSON values) at path/attributes; those of other names stay."""
    for name, frame in (frames or {}).items():
        frame.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    for name, value in (attributes or {}).items():
        _write_json(spark or next(iter(frames.values())).sparkSession, f"{path}/attributes/{name}", {"value": value})


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none if it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in files.listStatus(place) if x.isDirectory()) if files.exists(place) else []


def load_group(spark: SparkSession, path: str, names: list[str] | None = None) -> dict:
    """The tables and attributes of a group by name, all or the given ones; KeyError for a missing name."""
    stored, attributes = _names(spark, f"{path}/tables"), _names(spark, f"{path}/attributes")
    out = {}
    for name in [*stored, *attributes] if names is None else names:
        if name in stored:
            out[name] = spark.read.parquet(f"{path}/tables/{name}")
        elif name in attributes:
            out[name] = json.loads(spark.read.text(f"{path}/attributes/{name}").first()[0])["value"]
        else:
            raise KeyError(f"{name} is not in {path}")
    return out


def groups(spark: SparkSession, path: str, ending: str = "") -> list[str]:
    """Names of the groups in a folder that end so, sorted."""
    return [n for n in _names(spark, path) if n.endswith(ending)]


def only_group(spark: SparkSession, path: str, ending: str = "", needed: bool = True) -> str | None:
    """The one group whose name ends so; ValueError for several, and for none if it is needed."""
    found = groups(spark, path, ending)
    if len(found) == 1 or not (found or needed):
        return found[0] if found else None
    raise ValueError(f"{len(found)} groups in {path}")


def largest_number(spark: SparkSession, path: str) -> int | None:
    """The greatest number that ends a group's name in a folder, such as a k-mer size; None if there is none."""
    import re

    return max((int(m[0]) for n in groups(spark, path) if (m := re.search(r"\d+$", n))), default=None)


def common_names(spark: SparkSession, paths: list[str]) -> list[str]:
    """Names of the tables that all these groups have, sorted."""
    first, *rest = [_names(spark, f"{p}/tables") for p in paths]
    return [n for n in first if all(n in r for r in rest)]


def common_datasets(frames: list[DataFrame]) -> list[str]:
    """Column names that all tables have, in the first one's order."""
    return [c for c in frames[0].columns if all(c in f.columns for f in frames)]


def save_tracks(track: DataFrame, path: str) -> None:
    track.write.mode("overwrite").partitionBy("chrom").parquet(path)


def load_tracks(spark: SparkSession, path: str, chrom: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Tracks, of one chromosome or with some columns only; KeyError for a missing column."""
    rows = spark.read.parquet(path)
    if missing := [c for c in columns or () if c not in rows.columns]:
        raise KeyError(missing[0])
    rows = rows if chrom is None else rows.filter(F.col("chrom") == chrom)
    return rows if columns is None else rows.select(*columns)
