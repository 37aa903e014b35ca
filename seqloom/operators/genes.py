"""Region, exon and gene tables: rates, ranks, lists and intervals."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .genome import BIN, bins, inside_regions

EXCLUDED = "^(TRNA|LOC|MIR)"


def _rate(n: str, length: str = "length") -> Column:
    """Per million positions, rounded half even."""
    return F.bround(F.col(n) / F.col(length) * 1e6, 0).cast("bigint")


def regions_of(genes: DataFrame, sizes: DataFrame, region: str = "region") -> DataFrame:
    """Adds chrom, start (0-based), end (exclusive) and length from region text and sizes (chrom, size)."""
    parsed = genes.withColumn("_r", text.region(region)).join(sizes.withColumnRenamed("chrom", "_c"), F.col("_r.chrom") == F.col("_c"))
    end = F.when(F.col("_r.end") == 0, F.col("size")).otherwise(F.least("_r.end", "size"))
    return parsed.select(*genes.columns, F.col("_r.chrom").alias("chrom"), (F.col("_r.start") - 1).alias("start"), end.alias("end")).withColumn("length", F.col("end") - F.col("start"))


def region_table(genes: DataFrame, minima: DataFrame, by: str = "losses") -> DataFrame:
    """rank, rate, n, rate2, n2, gene, region, length of each gene: losses (minima of value 0) and variants.

    Sorted by everything, descending; the sort key is losses or variants.
    """
    counted = inside_regions(minima, genes).groupBy("gene", "region", "length").agg(F.count_if(F.col("value") == 0).alias("nloss"), F.count("value").alias("nv"))
    first, second = ("nloss", "nv") if by == "losses" else ("nv", "nloss")
    rows = counted.select(_rate(first).alias("rate1"), F.col(first).alias("n1"), _rate(second).alias("rate2"), F.col(second).alias("n2"), "gene", "region", "length")
    return ranked(rows, ["rate1", "n1", "rate2", "n2", "gene", "region", "length"])


def ranked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rank 1..n by all keys descending. Gene tables have one row a gene, so one sorted window holds them."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*[F.col(k).desc() for k in keys])).cast("bigint"))


def exon_table(exons: DataFrame, minima: DataFrame) -> DataFrame:
    """gene, length, nloss, nv over the exons (gene, chrom, start, end) of each gene.

    nv: a variant over the first position counts, and each that begins after it; nloss: positions in losses.
    """
    m = minima.select(F.col("chrom").alias("m_chrom"), "first", "last", "value", F.explode(bins("first", F.col("last"))).alias("m_bin"))
    rows = exons.withColumn("bin", F.explode(bins("start", F.col("end") - 1)))
    overlap = (F.col("m_chrom") == F.col("chrom")) & (F.col("first") < F.col("end")) & (F.col("last") >= F.col("start"))
    # A pair that shares several bins is joined in the first of them.
    overlap &= (F.col("m_bin") == F.col("bin")) & (F.col("bin") == F.floor(F.greatest("first", "start") / BIN))
    joined = rows.join(m.hint("merge"), overlap, "left")
    covered = F.least(F.col("last") + 1, F.col("end")) - F.greatest("first", "start")
    by_exon = joined.groupBy("gene", "chrom", "start", "end").agg(
        F.coalesce(F.max((F.col("first") <= F.col("start")).cast("bigint")), F.lit(0)).alias("at_start"),
        F.count_if(F.col("first") > F.col("start")).alias("later"),
        F.coalesce(F.sum(F.when(F.col("value") == 0, covered)), F.lit(0)).alias("loss"),
    )
    return by_exon.groupBy("gene").agg(
        F.sum(F.col("end") - F.col("start")).alias("length"), F.sum("loss").alias("nloss"), F.sum(F.col("at_start") + F.col("later")).alias("nv"),
    )


def gene_list(case: DataFrame, control: DataFrame) -> DataFrame:
    """Names with variants in the case table and none in the control table; of repeated names the last rank counts."""
    last = lambda t, n: t.groupBy("gene").agg(F.max_by("nv", "rank").alias(n))
    both = last(case, "a").join(last(control, "b"), "gene").filter("a > 0 AND b = 0")
    return both.select("gene").filter(~F.col("gene").rlike(EXCLUDED))


def same_names(case: DataFrame, control: DataFrame) -> DataFrame:
    """Names that only one of the tables has; empty if the key sets agree."""
    a, b = case.select("gene").distinct().withColumn("a", F.lit(1)), control.select("gene").distinct().withColumn("b", F.lit(1))
    return a.join(b, "gene", "full").filter("a IS NULL OR b IS NULL").select("gene")


def combined_ranks(first: DataFrame, second: DataFrame, least: int = 10_000, gain: int = 2_000, limit: int = 100) -> DataFrame:
    """gene, r1, r2: names ranked far lower in the second table (r2 counts from 0, -1 if absent), first ones of the first table."""
    there = second.groupBy("gene").agg((F.min("rank") - 1).alias("r2"))
    joined = first.select("gene", F.col("rank").alias("r1")).join(there, "gene", "left").withColumn("r2", F.coalesce("r2", F.lit(-1).cast("bigint")))
    kept = joined.filter((F.col("r2") >= least) & (F.col("r2") - F.col("r1") >= gain) & ~F.col("gene").rlike(EXCLUDED))
    return kept.orderBy("r1").limit(limit)


def consensus(names: DataFrame, votes: int, key: str = "gene") -> DataFrame:
    """Names that stand in `votes` lists or more; names has key and list."""
    return names.groupBy(key).agg(F.count("*").alias("votes")).filter(F.col("votes") >= votes)


def merge_intervals(intervals: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, start, end of the unions of overlapping or touching intervals of each group."""
    along = Window.partitionBy(*group).orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))
    runs = intervals.withColumn("_new", new).withColumn("_run", F.sum("_new").over(along))
    return runs.groupBy(*group, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def merge_in_order(intervals: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """The order-dependent merge: each interval, in `order`, widens the first kept one it meets, else is kept itself."""
    columns = [intervals.schema[g] for g in group]

    def run(pdf):
        import pandas as pd

        kept: list[list[int]] = []
        for start, end in pdf.sort_values(order)[["start", "end"]].itertuples(index=False):
            for old in kept:
                if start <= old[1] and end >= old[0]:
                    old[0], old[1] = min(old[0], start), max(old[1], end)
                    break
            else:
                kept.append([start, end])
        out = pd.DataFrame(kept, columns=["start", "end"])
        for g in group:
            out.insert(0, g, pdf[g].iloc[0])
        return out[[*group, "start", "end"]]

    from pyspark.sql import types as T

    schema = T.StructType([*columns, T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return intervals.groupBy(*group).applyInPandas(run, schema)


def bed_genes(bed: DataFrame, accessions: DataFrame) -> DataFrame:
    """chrom, start (1-based), end, gene of the bed rows whose accession has a chromosome in accessions (acc, chrom)."""
    rows = bed.join(accessions, "acc")
    return rows.select("chrom", (F.col("start0") + 1).alias("start"), F.col("end0").alias("end"), text.full_name("extra").alias("gene"))


def exon_lines(genes: DataFrame, exons: DataFrame) -> DataFrame:
    """gene, region, n, exons: merged exon regions of each gene on the gene's own chromosome, as text."""
    name = lambda a, b, c: F.concat_ws("-", F.concat_ws(":", a, b), c)
    on_own = exons.join(genes.select("gene", F.col("chrom").alias("own")), "gene").filter("chrom = own").drop("own")
    merged = merge_intervals(on_own, ["gene", "chrom"])
    listed = merged.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("start", name("chrom", "start", "end").alias("region")))).alias("e"))
    return genes.join(listed, "gene").select("gene", name("chrom", "start", "end").alias("region"), F.size("e").cast("bigint").alias("n"), F.array_join("e.region", " ").alias("exons"))
