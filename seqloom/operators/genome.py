"""Tracks along sequences: presence, coverage, plateaus and their minima."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .counters import marked, same_codes
from .kmers import letters, position_codes

#: Positions of one bin of the coordinate axis; no window holds more than a bin and its halo.
BIN = 100_000


def pair_track(genome: DataFrame, pairs: DataFrame, genomic: DataFrame, k: int, mode: str = "max") -> DataFrame:
    """chrom, pos, c1, c2, uniq for every window of genome (chrom, seq) without invalid letters."""
    found = position_codes(genome, k, mode, keep=["chrom"], invalid=False, spread=True)
    same_codes(marked(found, k, mode), pairs, genomic)
    joined = found.join(pairs.select("code", "c1", "c2").hint("merge"), "code", "left").join(genomic.select("code", F.col("value").alias("g")).hint("merge"), "code", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select("chrom", "pos", F.coalesce("c1", zero).alias("c1"), F.coalesce("c2", zero).alias("c2"), (F.coalesce("g", zero) == 1).alias("uniq"))


def coverage(genome: DataFrame, flags: DataFrame, k: int, columns: dict[str, str], bin_size: int = BIN) -> DataFrame:
    """chrom, pos, base and coverage of every position: by how many flagged windows of k it is covered.

    flags has chrom, pos (the window's first) and boolean columns; columns maps names to them. Bins
    of the axis carry a halo of the k - 1 positions before them.
    """
    # By merge, as all joins of tracks: the planner takes a row for each position for as small as the text it was made from.
    axis = letters(genome, keep=["chrom"], spread=True).join(flags.select("chrom", "pos", *columns.values()).hint("merge"), ["chrom", "pos"], "left")
    own = F.floor(F.col("pos") / bin_size)
    rows = axis.withColumn("bin", F.explode(F.array_distinct(F.array(own, F.floor((F.col("pos") + k - 1) / bin_size)))))
    before = Window.partitionBy("chrom", "bin").orderBy("pos").rangeBetween(-(k - 1), 0)
    for name, flag in columns.items():
        rows = rows.withColumn(name, F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("int")).over(before).cast("bigint"))
    base = F.coalesce(F.when(F.col("letter") != "N", F.translate("letter", "ACGT", "0123")), F.lit("4")).cast("int")
    return rows.filter(own == F.col("bin")).select("chrom", "pos", base.alias("base"), *columns)


def unique_fraction(track: DataFrame) -> DataFrame:
    """chrom, windows, fraction of them that are unique in the genome."""
    return track.groupBy("chrom").agg(F.count("*").alias("windows"), F.avg(F.col("uniq").cast("double")).alias("fraction"))


def coverage_histogram(cover: DataFrame, column: str) -> DataFrame:
    return cover.groupBy("chrom", F.col(column).alias("coverage")).agg(F.count("*").alias("freq"))


def plateaus(cover: DataFrame, value: str, other: str, k: int, bin_size: int = BIN) -> DataFrame:
    """chrom, first, last, value, full, left_value, right_value of each maximal run of equal coverage.

    full tells whether `other` is k somewhere in the run. Runs and their neighbours are found
    within bins; only the first and last run of each bin are then stitched along the chromosome,
    so no window holds more than a bin or two rows a bin.
    """
    rows = cover.select("chrom", "pos", F.col(value).alias("value"), (F.col(other) == k).alias("full"), F.floor(F.col("pos") / bin_size).alias("bin"))
    along = Window.partitionBy("chrom", "bin").orderBy("pos")
    rows = rows.withColumn("piece", F.sum(F.coalesce((F.col("value") != F.lag("value").over(along)).cast("int"), F.lit(1))).over(along))
    pieces = rows.groupBy("chrom", "bin", "piece").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("value").alias("value"), F.max("full").alias("full"))
    inside = Window.partitionBy("chrom", "bin").orderBy("first")
    pieces = pieces.withColumn("left_value", F.lag("value").over(inside)).withColumn("right_value", F.lead("value").over(inside)).drop("bin", "piece")
    inner = F.col("left_value").isNotNull() & F.col("right_value").isNotNull()

    chrom = Window.partitionBy("chrom").orderBy("first")
    edge = pieces.filter(~inner)
    for name, step, touches in (("left_value", F.lag, F.lag("last").over(chrom) + 1 == F.col("first")), ("right_value", F.lead, F.lead("first").over(chrom) == F.col("last") + 1)):
        # Null where the neighbour is in the same bin, or there is none.
        edge = edge.withColumn(f"next_{name}", F.when(F.col(name).isNull() & touches, step("value").over(chrom)))
    edge = edge.withColumn("run", F.sum(F.coalesce((F.col("next_left_value") != F.col("value")).cast("int"), F.lit(1))).over(chrom))
    ends = edge.withColumn("left_value", F.coalesce("left_value", "next_left_value")).withColumn("right_value", F.coalesce("right_value", "next_right_value"))
    stitched = ends.groupBy("chrom", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.first("value").alias("value"), F.max("full").alias("full"),
        F.min_by("left_value", "first").alias("left_value"), F.max_by("right_value", "first").alias("right_value"),
    )
    return pieces.filter(inner).unionByName(stitched.drop("run"))


def minima(runs: DataFrame) -> DataFrame:
    """chrom, first, last, value of plateaus lower than both neighbours with full coverage of the other kind somewhere.

    The first and last plateau of a chromosome are none.
    """
    return runs.filter("left_value > value AND right_value > value AND full").select("chrom", "first", "last", "value")


def bins(first, last, bin_size: int = BIN):
    """Array of the bins that an interval (last included) touches; of an empty one that of its first position."""
    own = F.floor(F.col(first) / bin_size)
    return F.sequence(own, F.greatest(own, F.floor(last / bin_size)))


def inside_regions(found: DataFrame, regions: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Every region (chrom, start, end; 0-based, end exclusive) with the minima that begin and end inside it.

    Joined by chromosome and bin: a row for each bin of a region without minima has nulls in their
    place, so count values, not rows.
    """
    m = found.select(F.col("chrom").alias("m_chrom"), "first", "last", "value", F.floor(F.col("first") / bin_size).alias("m_bin"))
    rows = regions.withColumn("bin", F.explode(bins("start", F.col("end") - 1, bin_size)))
    inside = (F.col("m_chrom") == F.col("chrom")) & (F.col("m_bin") == F.col("bin")) & (F.col("first") >= F.col("start")) & (F.col("last") < F.col("end"))
    return rows.join(m.hint("merge"), inside, "left").drop("m_chrom", "m_bin", "bin")


def region_minima(found: DataFrame, regions: DataFrame) -> DataFrame:
    """The minima that begin and end inside each of regions, with the region's columns."""
    return inside_regions(found, regions).filter("value IS NOT NULL")


def variant_bits(found: DataFrame) -> DataFrame:
    """chrom, pos, bits of every position in a minimum: 1 for loss (value 0), 2 for a variant, 4 where it starts."""
    pos = F.explode(F.sequence("first", "last"))
    rows = found.select("chrom", pos.alias("pos"), "first", "value")
    return rows.select("chrom", "pos", (F.lit(2) + (F.col("value") == 0).cast("int") + 4 * (F.col("pos") == F.col("first")).cast("int")).alias("bits"))
