"""Comparing counters: selections, differences, groups and near codes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .counters import lookup, same_codes

ABSENT_MIN = 999_999


def pick_unique(selection: DataFrame, genomic: DataFrame) -> DataFrame:
    """Codes of the selection that the genome has once; their value is 2."""
    same_codes(selection, genomic)
    return selection.join(genomic.filter("value = 1").hint("merge"), "code", "left_semi").select("code", F.lit(2).cast("bigint").alias("value"))


def default_mincount(a: DataFrame, b: DataFrame) -> DataFrame:
    """mincount: the largest c such that a has as many codes with value c or more as b has codes; 1 if none."""
    same_codes(a, b)
    from pyspark.sql import Window

    reach = a.groupBy("value").agg(F.count("*").alias("n")).withColumn("reach", F.sum("n").over(Window.orderBy(F.col("value").desc())))
    size = b.agg(F.count("*").alias("size"))
    return reach.join(F.broadcast(size), F.col("reach") >= F.col("size")).agg(F.coalesce(F.max("value"), F.lit(1).cast("bigint")).alias("mincount"))


def difference(a: DataFrame, b: DataFrame, min_a: int, below_b: int = 2) -> DataFrame:
    """Codes with value min_a or more in a and less than below_b in b, ascending."""
    return lookup(a.filter(F.col("value") >= min_a), b, "other").filter(F.col("other") < below_b).select("code", "value", "other").orderBy("code")


def difference_histogram(a: DataFrame, b: DataFrame, min_a: int) -> DataFrame:
    """Histogram of b's values of a's codes with value min_a or more."""
    found = lookup(a.filter(F.col("value") >= min_a), b, "other")
    return found.groupBy(F.col("other").alias("value")).agg(F.count("*").alias("freq"))


def least_shared(a: DataFrame, b: DataFrame, below_b: int = 2) -> DataFrame:
    """The least value in a of codes with below_b or more in b."""
    same_codes(a, b)
    shared = a.join(b.filter(F.col("value") >= below_b).select("code").hint("merge"), "code", "left_semi")
    return shared.agg(F.coalesce(F.min("value"), F.lit(ABSENT_MIN).cast("bigint")).alias("least"))


def is_loss(case: int = 100, control: int = 36) -> Column:
    """Rare in the case counter, solid in the control, in bait and genome."""
    return (F.col("vo") < case) & (F.col("vm") >= control) & (F.col("vb") >= 1) & (F.col("vg") >= 1)


def is_gain(case: int = 300, control: int = 3) -> Column:
    return (F.col("vo") >= case) & (F.col("vm") <= control) & (F.col("vb") == 0) & (F.col("vg") == 0)


def gain_loss(case: DataFrame, control: DataFrame, bait: DataFrame, genomic: DataFrame, loss: Column, gain: Column) -> DataFrame:
    """code, vo, vm, vb, vg, type: losses among the bait's codes, gains among the case's."""
    same_codes(case, control, bait, genomic)

    def values(driver: DataFrame, own: str) -> DataFrame:
        out = driver.select("code", F.col("value").alias(own))
        for name, table in (("vo", case), ("vm", control), ("vb", bait), ("vg", genomic)):
            if name != own:
                out = lookup(out, table, name)
        return out.select("code", "vo", "vm", "vb", "vg")

    return values(bait, "vb").filter(loss).withColumn("type", F.lit("bait_loss")).unionByName(values(case, "vo").filter(gain).withColumn("type", F.lit("case_gain")))


def two_groups(samples: DataFrame, thresholds: DataFrame) -> DataFrame:
    """code, c1, c2: in how many samples of group 1 and 2 a code is solid.

    samples has sample, grp, code, value; thresholds has grp, sample, threshold, a row a sample.
    """
    solid = samples.join(thresholds, ["grp", "sample"]).filter(F.col("value") >= F.col("threshold"))
    return solid.groupBy("code").agg(F.count_if(F.col("grp") == 1).alias("c1"), F.count_if(F.col("grp") == 2).alias("c2"))


def hamming_partners(losses: DataFrame, gains: DataFrame, k: int, distance: int = 2) -> DataFrame:
    """code, partner of each loss: the one gain within the distance, -1 if none, -2 if several.

    Two codes within the distance agree on one of distance + 1 parts, so the join is on parts.
    """
    same_codes(losses, gains)
    cuts = [k * i // (distance + 1) for i in range(distance + 2)]

    def parts(df: DataFrame, name: str) -> DataFrame:
        # Part i has the bits of letters cuts[i] to cuts[i + 1].
        pick = [F.shiftrightunsigned("code", 2 * (k - b)).bitwiseAND(F.lit((1 << 2 * (b - a)) - 1)) for a, b in zip(cuts[:-1], cuts[1:])]
        return df.select(F.col("code").alias(name), F.posexplode(F.array(*pick)).alias("part", "bits"))

    near = parts(losses, "code").join(parts(gains, "gain"), ["part", "bits"]).filter(dna.letter_distance("code", "gain") <= distance)
    # A pair that agrees on several parts comes several times, which the least and greatest gain do not see.
    found = near.groupBy("code").agg(F.min("gain").alias("least"), F.max("gain").alias("most"))
    partner = F.when(F.col("least").isNull(), -1).when(F.col("least") < F.col("most"), -2).otherwise(F.col("least"))
    return losses.select("code").distinct().join(found, "code", "left").select("code", partner.cast("bigint").alias("partner"))


def loss_statistics(windows: DataFrame, partners: DataFrame, unique: DataFrame) -> DataFrame:
    """gene, total, unique, lost, partnered: window counts of each gene.

    windows has gene and code; unique has the codes that count as such; partners those lost, with a partner.
    """
    same_codes(windows, partners, unique)
    rows = windows.join(unique.select("code", F.lit(True).alias("u")).hint("merge"), "code", "left").join(partners.hint("merge"), "code", "left")
    return rows.groupBy("gene").agg(
        F.count("*").alias("total"), F.count("u").alias("unique"), F.count("partner").alias("lost"), F.count_if(F.col("partner") >= 0).alias("partnered"),
    )
