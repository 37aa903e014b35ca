"""Cross-site boilerplate lines by HyperLogLog spread, exact near the threshold."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .scratch import Scratch

#: Distinct sites at which a line is boilerplate, and the fewest words of such a line: 1 leaves out blank lines only.
MIN_SITES, MIN_WORDS = 4, 1
#: log2 of the registers of a sketch.
PRECISION = 6
#: Lines at two sites or more are counted exactly unless their estimate is above the threshold by this factor, five standard errors and more.
NEAR = 2.0
#: Boilerplate lines that are broadcast; beyond it lines are joined.
BROADCAST_LINES = 1_000_000


def _lines(column: pa.Array, min_words: int):
    """(first row, bytes, starts, ends, rows' first lines, hashes, has enough words) of runs of rows."""
    for lo, hi, data, offsets in textops.chunks(column):
        starts, ends, rows = textops.line_spans(data, offsets)
        words = textops.Words(data, offsets)
        full = np.searchsorted(words.starts, ends) - np.searchsorted(words.starts, starts) >= max(min_words, 1)
        yield lo, data, starts, ends, rows, textops.span_hashes(data, starts, ends).view(np.int64), full


def _line_sites(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """text, site hash -> the distinct (line, site) of each run of rows."""
    for batch in batches:
        sites = batch.column(1).to_numpy()
        for lo, _, _, _, rows, h, full in _lines(batch.column(0), min_words):
            site = np.repeat(sites[lo : lo + len(rows) - 1], np.diff(rows))
            pairs = np.unique(np.stack([h[full], site[full]]), axis=1) if full.any() else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["line", "site"])


def spread(sites: DataFrame) -> DataFrame:
    """line, estimate, several: HyperLogLog estimates of the distinct sites of each line of (line, site), and whether there are two at least.

    A sketch is its non-empty registers, a row each, with the least and greatest site; sketches merge
    by the greatest value of each register, which is a partial aggregation before the shuffle.
    """
    m = 1 << PRECISION
    h = F.xxhash64("site")
    register = F.pmod(h, F.lit(m)).cast("short")
    rest = F.shiftrightunsigned(h, PRECISION)
    bits = 64 - PRECISION
    # The position of the first one bit: log2 of a long below 2**58 is exact enough at powers of two here.
    width = F.length(F.bin(rest))
    rank = F.when(rest == 0, bits + 1).otherwise(bits - width + 1).cast("short")
    registers = sites.groupBy("line", register.alias("register")).agg(F.max(rank).alias("rank"), F.min("site").alias("low"), F.max("site").alias("high"))
    merged = registers.groupBy("line").agg(F.count("*").alias("filled"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("inverse"), (F.min("low") != F.max("high")).alias("several"))
    alpha = 0.7213 / (1 + 1.079 / m)
    raw = F.lit(alpha * m * m) / (F.col("inverse") + (m - F.col("filled")))
    linear = F.lit(float(m)) * F.log(F.lit(float(m)) / (m - F.col("filled")))
    return merged.select("line", F.when((raw <= 2.5 * m) & (F.col("filled") < m), linear).otherwise(raw).alias("estimate"), "several")


def boilerplate(docs: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """line: the hashes of lines of min_words words or more that stand at min_sites distinct sites or more.

    docs has text and site. A null site is a site of its own. Blank lines never count. A line that
    repeats at one site counts as one there. Without rows or sites enough the result is empty.
    """
    hashed = docs.select("text", F.coalesce(F.xxhash64(F.col("site").cast("string")), F.lit(0)).alias("site"))
    pairs = scratch.save(hashed.mapInArrow(lambda batches: _line_sites(batches, min_words), "line long, site long"), "pairs")
    estimates = scratch.save(spread(pairs).filter(F.col("several") | F.lit(min_sites < 2)), "estimates")
    sure = estimates.filter(F.col("estimate") > min_sites * NEAR).select("line")
    near = estimates.filter(F.col("estimate") <= min_sites * NEAR).select("line")
    counted = pairs.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("line")
    return scratch.save(sure.unionByName(counted), "boilerplate")


def _stripped(column: pa.Array, known, min_words: int) -> Iterator[tuple[list, list, list]]:
    """(lines, removed lines, text that is left) of runs of rows; known(hashes) tells boilerplate."""
    for _, data, starts, ends, rows, h, full in _lines(column, min_words):
        gone = full & known(h)
        raw, kept, removed = data.tobytes(), [], []
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            n = int(gone[a:b].sum())
            removed.append(n)
            kept.append(raw[starts[a] : ends[b - 1]].decode() if not n else "\n".join(raw[starts[i] : ends[i]].decode() for i in range(a, b) if not gone[i]))
        yield np.diff(rows).tolist(), removed, kept


def remove_boilerplate(docs: DataFrame, lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left of every row of docs.

    Lines are split at \\n; blank lines and those of fewer than min_words words stay. A null text has
    one empty line. Every occurrence of a boilerplate line goes, in texts of any length. Other
    columns are not read; rows that repeat are treated each; without rows there is no result row.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    n = lines.count()

    def run_with(get):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lo = 0
                for total, removed, kept in _stripped(batch.column(1), get(batch), min_words):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(kept)), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema.names)
                    lo += len(kept)

        return run

    if n <= BROADCAST_LINES:
        shared = spark.sparkContext.broadcast(np.sort(lines.toPandas()["line"].to_numpy(np.int64)))

        def get(_):
            def known(h):
                table = shared.value
                if not len(table):
                    return np.zeros(len(h), bool)
                return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h

            return known

        return rows.mapInArrow(run_with(get), schema)

    # Too many to broadcast: each text gets the boilerplate among its own lines by a join on its hash.
    # Texts of one hash would get each other's lines, which are boilerplate all the same.
    keyed = rows.withColumn("key", F.xxhash64("text"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, _, _, _, firsts, h, full in _lines(batch.column(1), min_words):
                key = np.repeat(keys[lo : lo + len(firsts) - 1], np.diff(firsts))
                yield pa.RecordBatch.from_arrays([pa.array(key[full]), pa.array(h[full])], ["key", "line"])

    own = keyed.select("key", "text").mapInArrow(explode, "key long, line long").distinct().join(lines, "line", "left_semi").groupBy("key").agg(F.collect_list("line").alias("own"))
    return keyed.join(own, "key", "left").select("doc_id", "text", "own").mapInArrow(run_with(_own_lines), schema)


def _own_lines(batch: pa.RecordBatch):
    every = np.unique(batch.column(2).flatten().to_numpy())
    return lambda h: np.isin(h, every)


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, chr(1)) AS site FROM documents),
s AS (SELECT rid, doc_id, site, string_split(text, chr(10)) AS lines FROM d),
l AS (SELECT rid, doc_id, site, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM s),
b AS (
  SELECT line FROM l WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {MIN_WORDS}
  GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN b USING (line))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_chars,
       md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_md5
FROM m GROUP BY rid
"""
