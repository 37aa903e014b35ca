"""Registered queries of the readers and writers: each writes files made from the test tables, reads them back and has SQL over the tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna, numbers, text
from ..operators import compare, counters, genes, statistics
from ..session import scratch_path
from ..sources import sequences, tables
from . import fixtures as fx
from .queries import _GENES, _HIST, _TRACK, _cover, _COVER, _genes, _histogram, _minima, _table, _track, K, query

_LETTERS = "regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')"


def _letters() -> Column:
    return F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(rows: DataFrame, name: str, *parts) -> str:
    """A new folder with a line of text for each row."""
    rows.select(_text(*parts).alias("value")).write.text(path := scratch_path(rows.sparkSession, name) + "/text")
    return path


def _file(spark: SparkSession, path: str, content: str) -> None:
    """One small file of a given name."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


# Sequences


@query(f"SELECT 'read' || doc_id || ' x' AS header, doc_id % 3 AS value1, md5({_LETTERS}) AS seq_md5 FROM documents WHERE length({_LETTERS}) > 0 AND doc_id % 3 <> 0")
def fasta_values(spark, d):
    records = _table(spark, d, "documents").select(_text("read", F.col("doc_id"), " x").alias("header"), _letters().alias("seq")).filter("seq <> ''")
    sequences.write_fasta(records, path := scratch_path(spark, "fasta"))
    value = F.regexp_extract("name", r"(\d+)$", 1).cast("bigint") % 3
    return sequences.with_values(sequences.read_fasta(spark, path), value, skip=0).select("header", "value1", F.md5("seq").alias("seq_md5"))


def _damaged(spark, d) -> str:
    """FASTQ whose third lines name another read, for every second record."""
    docs = _table(spark, d, "documents").withColumn("s", _letters()).filter("s <> ''")
    third = F.when(F.col("doc_id") % 2 == 0, "+").otherwise("+other")
    return _lines(docs, "fastq", "@read", F.col("doc_id"), "\n", F.col("s"), "\n", third, "\n", F.repeat(F.lit("I"), F.length("s")))


@query(f"SELECT 'read' || doc_id AS header, md5({_LETTERS}) AS seq_md5 FROM documents WHERE length({_LETTERS}) > 0")
def fastq_dirty(spark, d):
    return sequences.read_fastq(spark, _damaged(spark, d), dirty=True).select("header", F.md5("seq").alias("seq_md5"))


@query(f"SELECT count(*) AS records, count(*) FILTER (doc_id % 2 <> 0) AS malformed FROM documents WHERE length({_LETTERS}) > 0")
def fastq_check(spark, d):
    return sequences.fastq_report(spark, _damaged(spark, d)).agg(F.sum("records").alias("records"), F.sum("malformed").alias("malformed"))


def _pair(spark, d, end: int) -> DataFrame:
    """One file of an end of the benchmark's pairs; every seventh name of the second file differs."""
    items = _table(spark, d, "benchmark").repartition(1).sortWithinPartitions("item_id")
    name = F.when((F.col("item_id") % 7 == 3) & F.lit(end == 2), "lost").otherwise("item")
    seq = F.upper(_letters()) if end == 1 else F.reverse(_letters())
    path = _lines(items, f"pair{end}", "@", name, F.col("item_id"), f"/{end} x{end}", "\n", seq, "\n+\n", seq)
    return sequences.read_fastq(spark, path)


@query(f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS read_id, md5(upper({_LETTERS})) AS seq1, md5(reverse({_LETTERS})) AS seq2 FROM benchmark")
def fastq_pairs(spark, d):
    pairs = sequences.pair_reads(_pair(spark, d, 1), _pair(spark, d, 2))
    return pairs.select("read_id", F.md5("seq1").alias("seq1"), F.md5("seq2").alias("seq2"))


@query("SELECT read_id FROM (SELECT row_number() OVER (ORDER BY item_id) - 1 AS read_id, item_id FROM benchmark) WHERE item_id % 7 = 3")
def pair_headers(spark, d):
    return sequences.check_pairs(_pair(spark, d, 1), _pair(spark, d, 2))


@query(f"SELECT {_LETTERS} AS line, count(*) AS n FROM documents GROUP BY 1")
def text_lines(spark, d):
    docs = _table(spark, d, "documents").select(_letters().alias("value"))
    docs.write.text(path := scratch_path(spark, "lines") + "/text")
    return sequences.read_text(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query(f"SELECT header, grp AS \"group\", md5(s) AS seq_md5 FROM (SELECT 'read' || doc_id AS header, 'read' || doc_id AS grp, {_LETTERS} AS s FROM documents UNION ALL SELECT 'item' || item_id || ' b', 'item' || item_id, {_LETTERS} FROM benchmark) WHERE length(s) > 0")
def grouped_sequences(spark, d):
    root = scratch_path(spark, "mixed")
    docs = _table(spark, d, "documents").select(_text("read", F.col("doc_id")).alias("header"), _letters().alias("seq")).filter("seq <> ''").withColumn("qual", F.col("seq"))
    items = _table(spark, d, "benchmark").select(_text("item", F.col("item_id"), " b").alias("header"), _letters().alias("seq")).filter("seq <> ''")
    sequences.write_fastq(docs, f"{root}/docs.fq")
    sequences.write_fasta(items, f"{root}/items.fa")
    found = sequences.read_sequences(spark, [f"{root}/docs.fq", f"{root}/items.fa"], group=text.group_name("seqname", header="header"))
    return found.select("header", "group", F.md5("seq").alias("seq_md5"))


@query("SELECT 'a' || p_partkey || '.fq' AS file, CASE WHEN p_partkey % 2 = 0 THEN NULL END AS mate FROM part WHERE p_partkey < 4 UNION ALL SELECT 'b_R1.' || p_partkey || '_R1.fq', 'b_R1.' || p_partkey || '_R2.fq' FROM part WHERE p_partkey < 4")
def fastq_arguments(spark, d):
    keys = [r[0] for r in _table(spark, d, "part").filter("p_partkey < 4").select("p_partkey").collect()]
    found = sequences.resolve_fastq([f"a{i}.fq" for i in keys], [f"b_R1.{i}_R1.fq" for i in keys])
    return spark.createDataFrame(found, "file string, mate string")


# Region, gene and other tables


def _bed(spark, d) -> DataFrame:
    n = F.col("item_id")
    kind = F.when(n % 3 == 0, "Name=mir").otherwise("gene=g")
    path = _lines(
        _table(spark, d, "benchmark"), "bed", "NC_", n % 5, "\t", n * 10, "\t", n * 10 + 25 + n % 4, "\tid", n, "\t.\t+\tRefSeq\tgene\t.\tID=", n, ";", kind, n, ";Dbxref=GeneID:1"
    )
    return tables.read_bed(spark, path)


@query("SELECT 'NC_' || item_id % 5 AS acc, item_id * 10 AS start0, item_id * 10 + 25 + item_id % 4 AS end0, '+' AS strand, 'gene' AS region, CASE WHEN item_id % 3 = 0 THEN 'mir' ELSE 'g' END || item_id AS gene FROM benchmark")
def bed_rows(spark, d):
    return _bed(spark, d).select("acc", "start0", "end0", "strand", "region", text.full_name("extra").alias("gene"))


_BED_GENES = "bg AS (SELECT 'chr' || item_id % 5 AS chrom, item_id * 10 + 1 AS start, item_id * 10 + 25 + item_id % 4 AS \"end\", CASE WHEN item_id % 3 = 0 THEN 'mir' ELSE 'g' END || item_id AS gene FROM benchmark WHERE item_id % 5 <> 4)"


def _bed_genes(spark, d):
    accessions = spark.createDataFrame([(f"NC_{i}", f"chr{i}") for i in range(4)], "acc string, chrom string")
    return genes.bed_genes(_bed(spark, d), accessions)


@query(f"WITH {_BED_GENES} SELECT * FROM bg")
def accession_join(spark, d):
    return _bed_genes(spark, d)


@query(
    f"""WITH {_BED_GENES} SELECT gene, chrom || ':' || start || '-' || "end" AS region, 2::BIGINT AS n,
chrom || ':' || start || '-' || (start + 9) || ' ' || chrom || ':' || (start + 15) || '-' || "end" AS exons FROM bg"""
)
def exon_lines(spark, d):
    found = _bed_genes(spark, d)
    part = lambda a, b, chrom="chrom": found.select("gene", F.expr(chrom).alias("chrom"), F.expr(a).alias("start"), F.expr(b).alias("end"))
    # Touching and overlapping exons are one; those on another chromosome are left out.
    exons = part("start", "start + 5").unionByName(part("start + 4", "start + 9")).unionByName(part("start + 15", "end")).unionByName(part("start", "end", "'chrX'"))
    return genes.exon_lines(found, exons)


@query("SELECT CASE WHEN item_id % 4 = 0 THEN 'mitochondrion' ELSE 'chromosome ' || item_id % 9 END AS ch, 'acc' || item_id AS acc, item_id AS start, item_id + 30 AS stop, 'p' || item_id AS pname FROM benchmark WHERE item_id % 4 <> 1")
def protein_rows(spark, d):
    n = F.col("item_id")
    kind = F.when(n % 4 == 0, "mitochondrion").when(n % 4 == 1, "Un").otherwise(_text("chromosome ", n % 9))
    head = F.when(n % 6 == 5, "#a comment\n").otherwise("")
    path = _lines(_table(spark, d, "benchmark"), "proteins", head, kind, ",acc", n, ",", n, ",", n + 30, ",+,1,l,t,\"x, y\",9,p", n)
    return tables.read_proteins(spark, path).select("ch", "acc", "start", "stop", "pname")


@query("SELECT 'chr' || item_id || ':1-9' AS region, 'g' || item_id AS gene, CASE WHEN item_id % 2 = 0 THEN 'e1 e2' ELSE '' END AS exons FROM benchmark")
def region_rows(spark, d):
    n = F.col("item_id")
    rest = F.when(n % 2 == 0, " 2 e1   e2").otherwise(" 0")
    path = _lines(_table(spark, d, "benchmark"), "regions", "# of genes\n\n  chr", n, ":1-9\tg", n, rest, "  ")
    return tables.read_regions(spark, path, exons=True).select("region", "gene", F.array_join("exons", " ").alias("exons"))


@query(
    f"""WITH {_GENES} SELECT row_number() OVER (ORDER BY rl DESC, nloss DESC, rv DESC, nv DESC, gene DESC, region DESC, length DESC) AS rank,
rl AS rate1, rv AS rate2, gene, region, length, nloss, nv FROM tables"""
)
def gene_table_file(spark, d):
    table = genes.region_table(_genes(spark, d), _minima(spark, d), "losses")
    tables.write_gene_table(table, path := scratch_path(spark, "genes"))
    return tables.read_gene_table(spark, path)


@query("SELECT item_id AS code, item_id % 7 AS vo, 40 AS vm, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 0 END AS vb, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END AS vg, CASE WHEN item_id % 2 = 0 THEN 'bait_loss' ELSE 'case_gain' END AS type FROM benchmark")
def candidate_rows(spark, d):
    n = F.col("item_id")
    path = _lines(_table(spark, d, "benchmark"), "candidates", n, " ", n % 7, "  40 ", F.when(n % 2 == 0, "2 1 bait_loss").otherwise("0 0 case_gain"))
    return tables.read_candidates(spark, path)


@query("SELECT n_name AS sample, n_nationkey * 3 + 2 AS threshold FROM nation")
def threshold_files(spark, d):
    root = scratch_path(spark, "thresholds")
    for name, key in _table(spark, d, "nation").select("n_name", "n_nationkey").collect():
        _file(spark, f"{root}/{name}.threshold", f" {key * 3 + 2} of all\n9\n")
    return tables.read_thresholds(spark, root)


@query(f"WITH {_HIST} SELECT value, freq FROM h")
def statistics_log(spark, d):
    line = _histogram(spark, d).agg(F.sort_array(F.collect_list(F.struct("value", F.concat_ws(": ", "value", "freq").alias("line")))).alias("all"))
    # A histogram has at most as many rows as a counter has values.
    whole = line.select(_text("Started\nValue statistics:\n  ", F.array_join("all.line", " (1.5%)\n  "), " (0.1%)\n\nFill statistics:\n 1: 2\n").alias("value"))
    whole.write.text(path := scratch_path(spark, "log") + "/text")
    return tables.read_value_statistics(spark, path)


@query("SELECT 's' || s_suppkey AS sample, 'u' || s_nationkey AS unit, s_suppkey || '_R1.fq' AS fq1, s_suppkey || '_R2.fq' AS fq2 FROM supplier WHERE s_suppkey % 5 <> 0")
def sample_list(spark, d):
    n = F.col("s_suppkey")
    fold = F.when(n % 5 == 0, "10X_linkedReads/").otherwise("")
    path = _lines(_table(spark, d, "supplier"), "samples", "# a note\nsample\tunit\tfq1\tfq2\ns", n, "\tu", F.col("s_nationkey"), "\t", fold, n, "_R1.fq\t", n, "_R2.fq")
    return tables.read_samples(spark, path, exclude="10X_linkedReads")


# Counters, dumps and tracks in files


@query(f"WITH {fx.CASE} SELECT {fx.sql_text('code', K)} AS code, value FROM case_c WHERE value BETWEEN 2 AND 60")
def dump_csv(spark, d):
    tables.write_dump(counters.select_values(fx.case(spark, d), "2-60"), path := scratch_path(spark, "dump"), K)
    return spark.read.csv(path, header=True, schema="code string, value bigint")


@query(f"WITH {fx.CASE} SELECT code, value FROM case_c")
def dump_parquet(spark, d):
    tables.write_dump(fx.case(spark, d), path := scratch_path(spark, "dump"), K, "parquet")
    return spark.read.parquet(path).select("code", "value")


@query(f"WITH {_COVER} SELECT chrom, pos, cov_a FROM cover WHERE chrom = '7'")
def track_file(spark, d):
    genome_tracks = _cover(spark, d)
    tables.save_tracks(genome_tracks, path := scratch_path(spark, "tracks"))
    found = tables.load_tracks(spark, path, "7", ["chrom", "pos", "cov_a"])
    return found.select(F.col("chrom").cast("string").alias("chrom"), "pos", "cov_a")


@query(f"WITH {fx.CASE}, {fx.GENOMIC} SELECT 'case' AS name, code, value FROM case_c UNION ALL SELECT 'genomic', code, value FROM genomic_c")
def group_files(spark, d):
    """Two counters and an attribute saved as a group, found again by the group's name."""
    root = scratch_path(spark, "groups")
    tables.save_group(f"{root}/run7", {"case": fx.case(spark, d), "genomic": fx.genomic(spark, d)}, {"names": ["case", "genomic"]})
    found = tables.load_group(spark, f"{root}/{tables.only_group(spark, root)}")
    a, b = (found[n].select(F.lit(n).alias("name"), "code", "value") for n in found["names"])
    return a.unionByName(b)


@query(f"WITH {_TRACK} SELECT column_name FROM (SELECT unnest(['chrom', 'pos']) AS column_name)")
def common_columns(spark, d):
    names = tables.common_datasets([_track(spark, d), fx.genome(spark, d).withColumn("pos", F.lit(0))])
    return spark.createDataFrame([(n,) for n in names], "column_name string")


@query(f"WITH {fx.READS}, {fx.sql_samples(K)} SELECT c1, count(*) FILTER (c2 = 0) AS \"0\", count(*) FILTER (c2 = 1) AS \"1\", count(*) FILTER (c2 = 4) AS \"4\" FROM pairs_c WHERE c2 IN (0, 1, 4) GROUP BY c1")
def hist2d_wide(spark, d):
    pairs = compare.two_groups(fx.samples(spark, d), fx.thresholds(spark)).filter("c2 IN (0, 1, 4)")
    return statistics.histogram_2d_wide(pairs, [0, 1, 4])


# Scalar functions that only files use


@query("SELECT item_id, translate(md5(text), '01234567abcdef89', 'ACGTNNNN########') AS letters FROM (SELECT item_id, text FROM benchmark)")
def digits_to_letters(spark, d):
    # Hexadecimal digits: 0 to 3 are letters, 4 to 7 and others are not.
    digits = F.translate(F.md5("text"), "567", "444")
    return _table(spark, d, "benchmark").select("item_id", dna.letters(digits).alias("letters"))


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'MT' WHEN 1 THEN NULL WHEN 2 THEN (item_id % 19)::VARCHAR ELSE 'X' END AS chrom FROM benchmark")
def chromosome_names(spark, d):
    n = F.col("item_id")
    header = F.when(n % 4 == 0, "NC_1 x mitochondrion, complete").when(n % 4 == 1, "NW_1 unplaced scaffold").when(n % 4 == 2, _text("NC_2 isolate breed chromosome ", n % 19, ", whole")).otherwise("NC_3 Chromosome X, whole")
    return _table(spark, d, "benchmark").select("item_id", text.chromosome(header).alias("chrom"))


@query("SELECT page_id, 'all' AS a, 'fixed' AS c, 'f' || page_id AS b, 'p' || page_id AS s, CASE WHEN page_id % 10 = 3 THEN 'three' ELSE 'none' END AS m FROM pages")
def group_names(spark, d):
    n = F.col("page_id")
    path, header = _text("/x.y/f", n, ".tar.gz"), _text("p", n, " rest")
    names = {"k3": "three"}
    return _table(spark, d, "pages").select(
        "page_id", text.group_name("all").alias("a"), text.group_name("const", value="fixed").alias("c"), text.group_name("basename", path).alias("b"),
        text.group_name("seqname", header=header).alias("s"), text.group_name("dict", header=_text("k", n % 10, " z"), names=names, default="none").alias("m"),
    )


@query("SELECT p_partkey, (p_partkey * 2 + 1) % 1024 AS a, 1::BIGINT AS product FROM part WHERE p_partkey < 50")
def odd_inverses(spark, d):
    rows = []
    for (key,) in _table(spark, d, "part").filter("p_partkey < 50").select("p_partkey").collect():
        a = (key * 2 + 1) % 1024
        rows.append((key, a, a * numbers.inverse(a, 1024) % 1024))
    return spark.createDataFrame(rows, "p_partkey bigint, a bigint, product bigint")


@query()
def merge_in_order(spark, d):
    """Depends on the order of the intervals, so it has no SQL; tests compare with plain Python."""
    rows = _table(spark, d, "nation").select("n_regionkey", "n_nationkey", (F.col("n_nationkey") * 37 % 50).cast("bigint").alias("start")).withColumn("end", F.col("start") + 9)
    return genes.merge_in_order(rows, ["n_regionkey"], "n_nationkey")
