"""Mixing sources to target weights with nested hash thresholds."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its size.
MAX_REPEATS = 3
#: Hash bits, and the bits that each level of the histogram adds.
HASH_BITS, LEVEL_BITS = 60, 12


def _weighted(sizes: DataFrame, scratch: Scratch, weights) -> DataFrame:
    """sizes with weight, by each source's place in code point order (null last), found by range partitions and their counts."""
    order = F.col("source").asc_nulls_last()
    dealt = scratch.save(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    # One row a range partition.
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    return dealt.join(before, "part").select("source", "source_size", weight.alias("weight"))


def targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS) -> DataFrame:
    """source, source_size, numerator, denominator, target of each row of sizes (source, source_size).

    The target is weight times a common rate, or MAX_REPEATS times the size where that is less;
    the rate makes the targets add up to all sizes. It is a ratio of integers, so reruns and
    other engines agree to the last bit. Sources whose share is above their cap get the cap, and
    what is left is shared among the others, until none is above; each step is one aggregation,
    so sources may be as many as hosts.
    """
    ranked = scratch.save(_weighted(sizes, scratch, weights).withColumn("cap", F.col("source_size") * MAX_REPEATS), "weighted")
    wide = lambda c: c.cast("decimal(18,0)")
    whole = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    share, before = (whole["size"], whole["weight"]), None
    while share != before:
        capped = wide(F.col("cap")) * wide(F.lit(share[1])) <= wide(F.lit(share[0])) * wide(F.col("weight"))
        left = ranked.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)).alias("cap"), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("weight")).first()
        share, before = (whole["size"] - left["cap"], left["weight"]), share
    numerator, denominator = F.when(capped, F.col("cap")).otherwise(F.lit(share[0]) * F.col("weight")), F.when(capped, 1).otherwise(F.lit(share[1]))
    return ranked.select("source", "source_size", numerator.cast("long").alias("numerator"), denominator.cast("long").alias("denominator")).withColumn("target", F.col("numerator") / F.col("denominator"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, the number of words (null text: 0), and hash, that of the id (null: that of the text)."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), row_hash("doc_id", "text").alias("hash"))


def row_hash(doc_id: str, text: str):
    """HASH_BITS bits of the id's hash; rows without id go by their texts, so that they need not stand or fall together."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def thresholds(rows: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    """source, repeats, cut: every document counts `repeats` times, and once more if its hash is below cut.

    rows: source, size, hash. Level by level the sizes are summed by source and hash bucket; only
    the bucket in which the running sum passes the budget is opened. Rows with one hash stand or
    fall together; the last of them is in if its middle lies within the budget.
    """
    goal = sources.withColumn("repeats", F.when(F.col("source_size") > 0, F.expr("numerator div (denominator * source_size)")).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("budget", F.expr("numerator div denominator") - F.col("repeats") * F.col("source_size"))
    state = scratch.save(goal.select("source", "repeats", "budget", F.lit(0).cast("long").alias("cut")), "cut-0")
    levels = range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS)
    for i, shift in enumerate(levels, 1):
        inside = rows.alias("r").join(state.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        inside = inside.filter(F.shiftright(F.col("r.hash"), shift + LEVEL_BITS) == F.shiftright(F.col("s.cut"), shift + LEVEL_BITS)) if i > 1 else inside
        bucket = F.shiftright(F.col("r.hash"), shift).alias("bucket")
        histogram = inside.groupBy(F.col("r.source").alias("source"), F.col("s.budget").alias("budget"), bucket).agg(F.sum("r.size").alias("size"), F.count("*").alias("n"))
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")
        # The boundary bucket is the last one that begins within the budget.
        edge = histogram.withColumn("before", running).filter("before <= budget")
        edge = edge.groupBy("source").agg(F.max(F.struct("bucket", "before", "size", "n")).alias("e"))
        found = state.alias("s").join(edge.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")), "left").select(
            "s.source", "repeats", (F.col("budget") - F.coalesce("e.before", F.lit(0))).alias("budget"),
            F.coalesce(F.shiftleft("e.bucket", shift), "cut").alias("cut"), F.col("e.size").alias("size"), F.col("e.n").alias("n"),
        )
        found = scratch.save(found, f"cut-{i}")
        state = found.select("source", "repeats", "budget", "cut")
        # A bucket with one row needs no opening.
        if shift == 0 or (found.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    return found.select("source", "repeats", (F.col("cut") + F.when(F.col("size") <= 2 * F.col("budget"), 1 << shift).otherwise(0)).alias("cut"))


def mix(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of docs (doc_id, text, source).

    size counts words; a null text has none. Sources take part in code point order, null last and
    one source of its own. taken is size times copies; copies is at most MAX_REPEATS. Rows with
    one doc_id and source share their hash and so their copies, as do rows without doc_id that
    have one text. Without rows or words every target is 0. Texts of any length are counted whole.
    Other columns are not read.
    """
    rows = scratch.save(sized(docs), "sized")
    sources = scratch.save(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), scratch), "targets")
    cuts = thresholds(rows, sources, scratch)
    plan = sources.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source"))).select("t.*", "repeats", "cut")
    plan = scratch.save(plan, "plan")
    out = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    copies = (F.col("repeats") + (F.col("hash") < F.col("cut")).cast("long")).alias("copies")
    return out.select("doc_id", "r.source", "size", "source_size", "target", copies, "hash").withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs with all their columns, each as often as `mix` takes it."""
    rows = scratch.save(sized(docs), "sized")
    sources = scratch.save(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), scratch), "targets")
    plan = scratch.save(thresholds(rows, sources, scratch), "plan")
    joined = docs.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    copies = (F.col("p.repeats") + (row_hash("d.doc_id", "d.text") < F.col("p.cut")).cast("long")).cast("int")
    # Not the name of any column of docs, in any case.
    fresh = "copy" + "_" * max(map(len, docs.columns))
    return joined.select("d.*", F.explode(F.array_repeat(F.lit(0), copies)).alias(fresh)).drop(fresh)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'text ' || coalesce(text, '')))[1:15] AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM s),
r AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k,
         (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_size,
         (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_weight
  FROM w),
f AS (SELECT min(k) AS k FROM r WHERE left_size * weight < cap * left_weight),
t AS (
  SELECT r.source, r.source_size,
         CASE WHEN r.k >= f.k THEN g.left_size * r.weight ELSE r.cap END AS num,
         CASE WHEN r.k >= f.k THEN g.left_weight ELSE 1 END AS den
  FROM r CROSS JOIN f LEFT JOIN r g ON g.k = f.k),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN num // (den * source_size) ELSE 0 END AS repeats FROM t),
c AS (
  SELECT d.doc_id, d.size, b.source_size, b.num, b.den, b.repeats, b.num // b.den - b.repeats * b.source_size AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS unit
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, num::DOUBLE / den::DOUBLE AS target,
       (size * (repeats + CASE WHEN 2 * (upto - unit) + unit <= 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
