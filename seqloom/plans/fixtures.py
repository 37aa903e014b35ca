"""DNA views of the test tables, for Spark and as SQL common table expressions."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counters
from ..operators.kmers import codes

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
MAPPED = ("ACGT" * 7)[:26]
K, K_GENOME = 7, 5
#: The k of real counts, over dense reads.
K_LONG = 27
#: Solid values by k, as (group, sample, threshold).
THRESHOLDS = {K: [(g, s, 40 * g * g + 20 * s) for g in (1, 2) for s in range(4)], K_GENOME: [(g, s, 100 * g + 40 * s) for g in (1, 2) for s in range(4)]}


def as_dna(text) -> Column:
    """The i-th letter of the alphabet as the (i mod 4)-th base; everything else stays and is invalid."""
    return F.translate(F.lower(text), ALPHABET, MAPPED)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reads(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), "lang", "source", as_dna("text").alias("seq"))


def raw_reads(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq"))


def talks(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select("conv_id", "turn", "role", as_dna("text").alias("seq"))


def genome(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("chrom"), as_dna("text").alias("seq"))


def dense(text) -> Column:
    """The letters of a text alone, as DNA: one long valid run."""
    return as_dna(F.regexp_replace(text, "[^A-Za-z]", ""))


def dense_reads(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), dense("text").alias("seq"))


def dense_items(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("read_id"), dense("text").alias("seq"))


def dense_genome(spark: SparkSession, d: str) -> DataFrame:
    """A chromosome for each turn of a conversation."""
    return _table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("chrom"), dense("text").alias("seq"))


def case(spark: SparkSession, d: str) -> DataFrame:
    return counters.count(reads(spark, d).filter("lang = 'en'"), K)


def control(spark: SparkSession, d: str) -> DataFrame:
    return counters.count(reads(spark, d).filter("lang <> 'en'"), K)


def bait(spark: SparkSession, d: str) -> DataFrame:
    return counters.count(talks(spark, d), K)


def genomic(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return counters.count(genome(spark, d), k, nvalues=16)


def samples(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    own = reads(spark, d).select(F.when(F.col("lang") == "en", 1).otherwise(2).alias("grp"), F.pmod(F.col("read_id"), F.lit(4)).cast("int").alias("sample"), "seq")
    counted = codes(own, k, keep=["grp", "sample"]).groupBy("grp", "sample", "code").agg(F.count("*").alias("value"))
    return counters.marked(counted.select("grp", "sample", "code", counters.saturated(F.col("value"), 512).alias("value")), k, "max")


def thresholds(spark: SparkSession, k: int = K) -> DataFrame:
    return spark.createDataFrame(THRESHOLDS[k], "grp int, sample int, threshold int")


# The same in SQL.


def sql_dna(text: str) -> str:
    return f"translate(lower({text}), '{ALPHABET}', '{MAPPED}')"


def sql_dense(text: str) -> str:
    return sql_dna(f"regexp_replace({text}, '[^A-Za-z]', '', 'g')")


def sql_rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def sql_canonical(x: str, mode: str) -> str:
    return {"f": x, "r": sql_rc(x), "max": f"greatest({x}, {sql_rc(x)})", "min": f"least({x}, {sql_rc(x)})"}[mode]


def sql_code(x: str, k: int) -> str:
    return f"list_sum(list_transform(range({k}), lambda i: (instr('ACGT', substr({x}, i::INTEGER + 1, 1)) - 1)::BIGINT << (2 * ({k} - 1 - i))::INTEGER))::BIGINT"


def sql_text(code: str, k: int) -> str:
    return f"list_reduce(list_transform(range({k}), lambda i: substr('ACGT', ((({code}) >> (2 * ({k} - 1 - i))::INTEGER) & 3)::INTEGER + 1, 1)), lambda a, b: a || b)"


def sql_windows(source: str, k: int, keep: str = "") -> str:
    keep = keep and keep + ","
    return (
        f"(SELECT {keep} substr(run, i, {k}) AS kmer FROM (SELECT {keep} run, unnest(range(1, length(run) - {k} + 2)) AS i FROM "
        f"(SELECT {keep} unnest(regexp_extract_all(seq, '[ACGT]{{{k},}}')) AS run FROM {source})))"
    )


def sql_counter(source: str, k: int = K, mode: str = "max", nvalues: int = 512) -> str:
    return f"(SELECT {sql_code('kmer', k)} AS code, least(n, {nvalues - 1}) AS value FROM (SELECT {sql_canonical('kmer', mode)} AS kmer, count(*) AS n FROM {sql_windows(source, k)} GROUP BY 1))"


READS = f"reads AS (SELECT doc_id AS read_id, lang, source, {sql_dna('text')} AS seq FROM documents)"
TALKS = f"talks AS (SELECT conv_id, turn, role, {sql_dna('text')} AS seq FROM conversations)"
GENOME = f"genome AS (SELECT item_id::VARCHAR AS chrom, {sql_dna('text')} AS seq FROM benchmark)"
DENSE_READS = f"dense_reads AS (SELECT doc_id AS read_id, {sql_dense('text')} AS seq FROM documents)"
DENSE_ITEMS = f"dense_items AS (SELECT item_id AS read_id, {sql_dense('text')} AS seq FROM benchmark)"
DENSE_GENOME = f"genome AS (SELECT conv_id || ':' || turn AS chrom, {sql_dense('text')} AS seq FROM conversations)"
CASE = f"{READS}, en AS (SELECT * FROM reads WHERE lang = 'en'), case_c AS MATERIALIZED {sql_counter('en')}"
CONTROL = f"other AS (SELECT * FROM reads WHERE lang <> 'en'), control_c AS MATERIALIZED {sql_counter('other')}"
BAIT = f"{TALKS}, bait_c AS MATERIALIZED {sql_counter('talks')}"
GENOMIC = f"{GENOME}, genomic_c AS MATERIALIZED {sql_counter('genome', K, nvalues=16)}"


def sql_samples(k: int) -> str:
    """reads must be defined; gives samples_c and pairs_c (code, c1, c2)."""
    rows = ", ".join(map(str, THRESHOLDS[k]))
    return f"""
own AS (SELECT CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS grp, (read_id % 4)::INTEGER AS sample, seq FROM reads),
samples_c AS (SELECT grp, sample, {sql_code('kmer', k)} AS code, least(n, 511) AS value FROM
  (SELECT grp, sample, {sql_canonical('kmer', 'max')} AS kmer, count(*) AS n FROM {sql_windows('own', k, 'grp, sample')} GROUP BY 1, 2, 3)),
th(grp, sample, threshold) AS (VALUES {rows}),
pairs_c AS MATERIALIZED (SELECT code, count(*) FILTER (grp = 1) AS c1, count(*) FILTER (grp = 2) AS c2
  FROM samples_c JOIN th USING (grp, sample) WHERE value >= threshold GROUP BY code)"""


def sql_positions(k: int) -> str:
    """genome must be defined; gives windows_p (chrom, pos, kmer) of valid windows."""
    return f"""
every_p AS (SELECT chrom, seq, unnest(range(0, length(seq) - {k} + 1)) AS pos FROM genome WHERE length(seq) >= {k}),
windows_p AS (SELECT chrom, pos, substr(seq, pos::INTEGER + 1, {k}) AS kmer FROM every_p WHERE NOT regexp_matches(substr(seq, pos::INTEGER + 1, {k}), '[^ACGT]'))"""
