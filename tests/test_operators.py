import gzip
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import dna, numbers, text
from seqloom.operators import compare, counters, genes, genome, kmers, statistics, superkmers
from seqloom.sources import sequences, tables
from seqloom.streaming import counts

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def code(s):
    n = 0
    for c in s:
        n = 4 * n + "ACGT".index(c)
    return n


def brute(seqs, k, mode, nvalues=512, shape=None):
    shape = shape or range(k)
    out = {}
    for s in seqs:
        s = (s or "").translate(str.maketrans("acgtuU", "ACGTTT"))
        for i in range(len(s) - shape[-1]):
            w = "".join(s[i + o] for o in shape)
            if set(w) <= set("ACGT"):
                for x in {"f": [w], "r": [rc(w)], "min": [min(w, rc(w))], "max": [max(w, rc(w))], "both": [w, rc(w)]}[mode]:
                    out[code(x)] = out.get(code(x), 0) + 1
    return {c: min(n, nvalues - 1) for c, n in out.items()}


def reads(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


def as_dict(df):
    rows = df.collect()
    out = {int(r[0]): r[1] for r in rows}
    assert len(out) == len(rows)
    return out


GOLDEN = ["", None, "ACG", "NNNN", "NACGTN", "acgtu", "ACGT", "ACGTACGTNACGUACG", "ßACGTßACGT", "A" * 50]


@pytest.mark.parametrize("mode", dna.MODES)
def test_counts_match_brute_force(spark, mode):
    rng = random.Random(1)
    seqs = GOLDEN + ["".join(rng.choice("ACGTNacgtu") for _ in range(rng.randint(0, 200))) for _ in range(30)]
    for k, nvalues in ((4, 512), (3, 8), (1, 4)):
        assert as_dict(counters.count(reads(spark, seqs), k, mode, nvalues)) == brute(seqs, k, mode, nvalues)
    assert as_dict(counters.count(reads(spark, seqs), (0, 1, 3), mode)) == brute(seqs, 3, mode, shape=(0, 1, 3))


def test_long_sequences_lose_no_window(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("ACGTN" if rng.random() < 0.01 else "ACGT") for _ in range(5003))
    df = reads(spark, [long])
    assert as_dict(counters.count(df, 6)) == brute([long], 6, "max")
    assert as_dict(counters.count(df, (0, 3, 7))) == brute([long], 3, "max", shape=(0, 3, 7))
    pos = [r.pos for r in kmers.positions(df, 6, keep=["read_id"]).orderBy("pos").collect()]
    assert pos == [i for i in range(len(long) - 5) if set(long[i : i + 6]) <= set("ACGT")]


def test_large_k(spark):
    s = "ACGTTGCAACGTTGCAACGTTGCAACGTTGCT"
    assert as_dict(counters.count(reads(spark, [s]), 31, "f")) == {code(s[:31]): 1, code(s[1:]): 1}
    assert as_dict(counters.count(reads(spark, [s]), 32, "max")) == {code(max(s, rc(s))): 1}
    row = counters.count(reads(spark, [s]), 32, "f").select(dna.text("code", 32), dna.reverse_complement_code("code", 32)).first()
    assert row[0] == s and int(row[1]) == code(rc(s))


def test_canonical_counts_ignore_the_strand(spark):
    seqs = ["ACGTTTGACCA", "GGATTACA"]
    for mode in ("min", "max", "both"):
        assert as_dict(counters.count(reads(spark, seqs), 4, mode)) == as_dict(counters.count(reads(spark, [rc(s) for s in seqs]), 4, mode))


def test_bad_parameters():
    for shape in (0, 33, (1, 2), (0, 2, 2), ()):
        with pytest.raises(ValueError):
            dna.shape(shape)
    with pytest.raises(ValueError):
        dna.mode("x")
    with pytest.raises(ValueError):
        counters.check_same(counters.Parameters(5), counters.Parameters(6))


def test_code_functions(spark):
    words = ["".join(w) for w in itertools.product("ACGT", repeat=3)]
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("c", dna.code("w", 3))
    for r in df.select("w", "c", dna.text("c", 3).alias("t"), dna.reverse_complement_code("c", 3).alias("r"), dna.canonical_code("c", 3, "max").alias("m")).collect():
        assert (r.c, r.t, r.r, r.m) == (code(r.w), r.w, code(rc(r.w)), max(code(r.w), code(rc(r.w))))
    other = spark.createDataFrame([("ACGNx",)], "w string").select(dna.two_bits("w"), dna.letters(F.lit("01234z"))).first()
    assert list(other) == ["01244", "ACGTN#"]
    pairs = df.select("c", dna.letter_distance("c", F.lit(27).cast("bigint")).alias("d")).collect()
    assert all(r.d == sum(a != b for a, b in zip(dna_text(r.c), dna_text(27))) for r in pairs)


def dna_text(c):
    return "".join("ACGT"[(c >> 2 * i) & 3] for i in (2, 1, 0))


def table(spark, values):
    return spark.createDataFrame(list(values.items()), "code long, value long")


def test_updates(spark):
    old, new = table(spark, {1: 5, 2: 6, 3: 7}), table(spark, {2: 1, 3: 3, 4: 4})
    assert as_dict(counters.update(old, new, 8)) == {1: 5, 2: 7, 3: 7, 4: 4}
    assert as_dict(counters.update_existing(old, new, 8)) == {1: 5, 2: 7, 3: 7}
    assert as_dict(counters.store_new(old, new)) == {1: 5, 2: 6, 3: 7, 4: 4}
    assert as_dict(counters.overwrite(old, new)) == {1: 5, 2: 1, 3: 3, 4: 4}
    assert as_dict(counters.overwrite_existing(old, new)) == {1: 5, 2: 1, 3: 3}
    assert as_dict(counters.lookup(new.select("code"), old)) == {2: 6, 3: 7, 4: 0}
    pairs = spark.createDataFrame([(1, 1)] * 5 + [(1, 4)] * 9 + [(2, 4)], "code long, increment long")
    assert as_dict(counters.aggregate(pairs, "pairs", 2, 3)) == {1: 3 + 4 * 7, 2: 4}
    assert as_dict(counters.select_values(old, "5,7-9")) == {1: 5, 3: 7}
    assert [tuple(r) for r in counters.get_items(old, F.col("value") > 5, 1).collect()] == [(2, 2)]
    assert counters.is_unique(old).first()[0] and not counters.is_unique(old.union(old)).first()[0]


def test_filtered_counts(spark):
    a, b = reads(spark, ["ACGACGACG", "TTT"]), reads(spark, ["ACGTTT"])
    full = brute(["ACGACGACG", "TTT"], 3, "f")
    assert as_dict(counters.filtered_count(a, 3, 2, mode="f")) == {c: n for c, n in full.items() if n > 2}
    assert as_dict(counters.filtered_count(b, 3, 1, a, "f")) == {code("ACG"): 1, code("CGA"): 0, code("GAC"): 0}
    assert as_dict(counters.filtered_count(a, 3, 0, mode="f")) == full


def test_verify(spark):
    df = reads(spark, ["ACGTN", "TTTT"])
    assert counters.verify(df, counters.count(df, 3), 3).count() == 0
    assert {(r.read_id, r.pos) for r in counters.verify(reads(spark, ["ACGA"]), counters.count(df, 3), 3).collect()} == {(0, 1)}


def test_difference_equals_anti_join(spark):
    a, b = table(spark, {1: 1, 2: 2, 5: 9}), table(spark, {2: 1, 7: 1})
    assert as_dict(compare.difference(a, b, 1, 1).select("code", "value")) == as_dict(a.join(b, "code", "left_anti"))
    assert compare.least_shared(a, b, 5).first()[0] == 999_999
    assert as_dict(compare.pick_unique(a, b)) == {2: 2}


def test_hamming_partners_match_all_pairs(spark):
    rng = random.Random(3)
    k = 9
    gains = [rng.randrange(4**k) for _ in range(300)]
    losses = [g ^ (rng.randrange(4) << 2 * rng.randrange(k)) ^ (rng.randrange(4) << 2 * rng.randrange(k)) for g in gains[:150]] + [rng.randrange(4**k) for _ in range(100)]

    def distance(x, y):
        return sum((x >> 2 * i) & 3 != (y >> 2 * i) & 3 for i in range(k))

    one = lambda v: spark.createDataFrame([(x,) for x in v], "code long")
    for r in compare.hamming_partners(one(losses), one(gains), k).collect():
        near = {g for g in gains if distance(r.code, g) <= 2}
        assert r.partner == (-1 if not near else -2 if len(near) > 1 else near.pop())


def brute_minima(a, b, k):
    out, i = [], 0
    while i < len(a):
        j = i
        while j + 1 < len(a) and a[j + 1] == a[i]:
            j += 1
        if i > 0 and j + 1 < len(a) and a[i - 1] > a[i] < a[j + 1] and any(b[p] == k for p in range(i, j + 1)):
            out.append((i, j, a[i]))
        i = j + 1
    return out


@pytest.mark.parametrize("bin_size", [3, 7, 1000])
def test_coverage_and_minima(spark, bin_size):
    rng = random.Random(4)
    k, rows, want = 3, [], {}
    for chrom in ("x", "y"):
        n = 90
        flags = [rng.random() < 0.6 for _ in range(n - k + 1)]
        rows += [(chrom, p, f) for p, f in enumerate(flags)]
        cov = [sum(flags[max(0, p - k + 1) : p + 1]) for p in range(n)]
        want[chrom] = cov
    flags = spark.createDataFrame(rows, "chrom string, pos long, a boolean").withColumn("b", F.lit(True))
    seqs = spark.createDataFrame([("x", "ACGTN" * 18), ("y", "a" * 90)], "chrom string, seq string")
    cover = genome.coverage(seqs, flags, k, {"ca": "a", "cb": "b"}, bin_size)
    got = {(r.chrom, r.pos): (r.ca, r.base) for r in cover.collect()}
    assert len(got) == 180 and all(got[c, p][0] == v for c, cov in want.items() for p, v in enumerate(cov))
    assert [got["x", p][1] for p in range(5)] == [0, 1, 2, 3, 4] and got["y", 0][1] == 0
    full = [min(p + 1, k, 90 - p) for p in range(90)]
    found = {(r.chrom, r.first, r.last, r.value) for r in genome.minima(genome.plateaus(cover, "ca", "cb", k, bin_size)).collect()}
    assert found == {(c, *m) for c, cov in want.items() for m in brute_minima(cov, full, k)}


def test_region_text(spark):
    forms = {"chr1": ("chr1", 1, 0), "chr1:": ("chr1", 1, 0), "chr2:1_000-2_000": ("chr2", 1000, 2000), "X:5-": ("X", 5, 0), "X:-7": ("X", 1, 7), "MT:10+5": ("MT", 10, 14), "3:9": ("3", 9, 9)}
    df = spark.createDataFrame([(f,) for f in forms], "r string")
    assert all(tuple(r.p) == forms[r.r] for r in df.select("r", text.region("r").alias("p")).collect())
    with pytest.raises(Exception, match="no region"):
        spark.createDataFrame([("chr1:a-b",)], "r string").select(text.region("r")).collect()


def test_headers_and_names(spark):
    df = spark.createDataFrame([("NC_1 Homo chromosome 7, whole",), ("x mitochondrion, complete",), ("y unplaced scaffold",)], "h string")
    assert [r[0] for r in df.select(text.chromosome("h")).collect()] == ["7", "MT", None]
    one = spark.range(1)
    assert one.select(text.file_stem(F.lit("/a/b.fa.gz"))).first()[0] == "b"
    assert one.select(text.mate_name(F.lit("x_R1_y_R1.fq"))).first()[0] == "x_R1_y_R2.fq"
    assert one.select(text.group_name("dict", header=F.lit("s1 more"), names={"s1": "g"})).first()[0] == "g"
    assert one.select(text.group_name("dict", header=F.lit("s2"), names={"s1": "g"}, default="d")).first()[0] == "d"
    with pytest.raises(ValueError):
        text.group_name("other")


def test_numbers(spark):
    df = spark.createDataFrame([(n,) for n in range(1, 70)], "n long")
    for r in df.select("n", numbers.bits_for("n").alias("b"), numbers.next_power("n").alias("u"), numbers.previous_power("n").alias("d"), numbers.next_odd("n").alias("o"), numbers.log_gamma("n").alias("g"), numbers.log_binomial(F.lit(50), F.col("n")).alias("c")).collect():
        assert r.b == math.ceil(math.log2(r.n)) and r.u == 2**r.b and r.d == 1 << (r.n.bit_length() - 1) and r.o == r.n | 1
        assert abs(r.g - math.lgamma(r.n)) < 1e-9
        assert r.c == -math.inf if r.n > 50 else abs(r.c - math.log(math.comb(50, r.n))) < 1e-9
    assert numbers.inverse(5, 4**7) * 5 % 4**7 == 1
    sums = numbers.log_sum(spark.createDataFrame([(1, 1000.0), (1, 1000.0), (2, -math.inf)], "g int, x double"), ["g"], "x")
    assert {r.g: r.logsum for r in sums.collect()} == {1: pytest.approx(1000 + math.log(2)), 2: -math.inf}


def test_thresholds_and_tails(spark):
    h = lambda d: spark.createDataFrame(list(d.items()), "value long, freq long")
    assert tuple(statistics.solid_threshold(h({1: 90, 2: 10, 4: 5, 5: 8})).first()) == (4, 13)
    assert tuple(statistics.solid_threshold(h({0: 5, 1: 9, 2: 3})).first()) == (1, 12)
    assert {r.at_least: r.value for r in statistics.tail(h({1: 20, 5: 1, 3: 1})).collect()} == {1: 5, 2: 3, 10: 1}
    assert [r.freq for r in statistics.dense(h({0: 2, 3: 1})).orderBy("value").collect()] == [2, 0, 0, 1]


def test_interval_merges(spark):
    rows = [("a", 1, 5), ("a", 5, 7), ("a", 9, 12), ("a", 10, 11), ("a", 20, 21), ("b", 1, 2)]
    df = spark.createDataFrame(rows, "g string, start long, end long")
    assert {tuple(r) for r in genes.merge_intervals(df, ["g"]).collect()} == {("a", 1, 7), ("a", 9, 12), ("a", 20, 21), ("b", 1, 2)}
    ordered = spark.createDataFrame([("a", 1, 2, 0), ("a", 5, 6, 1), ("a", 2, 5, 2)], "g string, start long, end long, n int")
    assert {tuple(r) for r in genes.merge_in_order(ordered, ["g"], "n").collect()} == {("a", 1, 5), ("a", 5, 6)}


# Files


def test_fasta_files(spark, tmp_path):
    body = ">one first\nACGT\n\n;note\nAC GT\n>two\n>three x\r\nTT\r\nGG\r\n"
    (tmp_path / "a.fa").write_text(body)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nAAAA")
    got = {(r.name, r.header, r.seq) for r in sequences.read_fasta(spark, [f"{tmp_path}/a.fa", f"{tmp_path}/b.fa.gz"]).collect()}
    assert got == {("one", "one first", "ACGTACGT"), ("two", "two", ""), ("three", "three x", "TTGG"), ("z", "z", "AAAA")}
    records = sequences.with_values(sequences.read_fasta(spark, f"{tmp_path}/a.fa"), F.length("name"), 5)
    assert {r.name for r in records.collect()} == {"one", "two"}
    sequences.write_fasta(spark.createDataFrame([("h", "ACGT" * 40)], "header string, seq string"), f"{tmp_path}/out")
    assert sequences.read_fasta(spark, f"{tmp_path}/out").first().seq == "ACGT" * 40


def test_fastq_files(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r0 x\nACGT\n+\nIIII\n@r1\nGG\n+r1\nII")
    (tmp_path / "b.fq").write_text("@r0/2\r\nTTTT\r\n+\r\nIIII\r\n@q1\r\nCC\r\n+\r\nII\r\n")
    a, b = (sequences.read_fastq(spark, f"{tmp_path}/{n}.fq") for n in "ab")
    assert [tuple(r)[1:] for r in a.orderBy("read_id").collect()] == [(0, "r0 x", "ACGT", "IIII"), (1, "r1", "GG", "II")]
    assert sequences.pair_reads(a, b).count() == 2
    assert [r.read_id for r in sequences.check_pairs(a.withColumn("header", text.first_word("header")), b).collect()] == [1]
    for bad in ("r0\nA\n+\nI\n", "@r0\nA\n-\nI\n", "@r0\nA\n+r9\nI\n", "@r0\nA\n"):
        (tmp_path / "bad.fq").write_text(bad)
        with pytest.raises(Exception, match="malformed"):
            sequences.read_fastq(spark, f"{tmp_path}/bad.fq").collect()
        sequences.read_fastq(spark, f"{tmp_path}/bad.fq", dirty=True).collect()
    sequences.write_fastq(a, f"{tmp_path}/out")
    assert {r.seq for r in sequences.read_fastq(spark, f"{tmp_path}/out").collect()} == {"ACGT", "GG"}
    mixed = sequences.read_sequences(spark, [f"{tmp_path}/a.fq"], group=text.file_stem("file"))
    assert {r.group for r in mixed.collect()} == {"a"}
    with pytest.raises(ValueError):
        sequences.read_sequences(spark, ["x.txt"])


def test_tables(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# note\nchr1:5-9 g1 2 chr1:5-6 chr1:8-9\nchr2 g2 0\n")
    rows = tables.read_regions(spark, f"{tmp_path}/r.txt", exons=True).orderBy("gene").collect()
    assert [(r.region, r.gene, r.exons) for r in rows] == [("chr1:5-9", "g1", ["chr1:5-6", "chr1:8-9"]), ("chr2", "g2", [])]
    (tmp_path / "s1.thr.txt").write_text("17 rest\nmore")
    assert [tuple(r) for r in tables.read_thresholds(spark, f"{tmp_path}/s1.thr.txt").collect()] == [("s1.thr", 17)]
    (tmp_path / "log.txt").write_text("x\nValue statistics:\n 1: 20 (5%)\n2:3 (1%)\n\n9: 9\n")
    assert {tuple(r) for r in tables.read_value_statistics(spark, f"{tmp_path}/log.txt").collect()} == {(1, 20), (2, 3)}
    (tmp_path / "c.txt").write_text("5 1 2 2 1 bait_loss\n6 9 0 0 0 case_gain\n")
    assert tables.read_candidates(spark, f"{tmp_path}/c.txt").count() == 2
    (tmp_path / "c.txt").write_text("5 1 2 1 1 bait_loss\n")
    with pytest.raises(Exception, match="does not fit"):
        tables.read_candidates(spark, f"{tmp_path}/c.txt").collect()


def test_counter_round_trip(spark, tmp_path):
    p = counters.Parameters(3, "max", 8)
    t = counters.count(reads(spark, ["ACGTACGT"]), p.k, p.mode, p.nvalues)
    tables.save_counter(t, f"{tmp_path}/c", p, 2)
    again, q = tables.load_counter(spark, f"{tmp_path}/c")
    assert q == p and as_dict(again) == as_dict(t)
    tables.write_dump(t, f"{tmp_path}/d", 3)
    assert {r.code: int(r.value) for r in spark.read.csv(f"{tmp_path}/d", header=True).collect()} == {dna_text(c): v for c, v in as_dict(t).items()}
    track = spark.createDataFrame([("x", 1, 2)], "chrom string, pos long, cov int")
    tables.save_tracks(track, f"{tmp_path}/t")
    assert tables.load_tracks(spark, f"{tmp_path}/t", "x", ["pos", "cov"]).first().cov == 2
    with pytest.raises(KeyError):
        tables.load_tracks(spark, f"{tmp_path}/t", columns=["nope"])


def test_streams(spark, tmp_path):
    for i, s in enumerate(["ACGTA", "CGTAC", "TTTT"]):
        reads(spark, [s]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = counts.read_stream(spark, f"{tmp_path}/in", files_per_batch=1)
    q = counts.stream_counts(stream, 3).writeStream.outputMode("complete").format("memory").queryName("kmers").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    want = brute(["ACGTA", "CGTAC", "TTTT"], 3, "max")
    assert as_dict(spark.table("kmers")) == want
    counts.merge_batches(stream, 3, f"{tmp_path}/out", f"{tmp_path}/cp2").awaitTermination()
    assert as_dict(counts.load_batches(spark, f"{tmp_path}/out")) == want


def test_fastq_streams(spark, tmp_path):
    folder, seqs = tmp_path / "in", ["ACGTTGCA", "GGGTTTAA", "ACGNACG"]
    folder.mkdir()
    run = lambda: counts.merge_fastq(spark, str(folder), 3, str(tmp_path / "out"), str(tmp_path / "check"), files_per_batch=1).awaitTermination()
    for i, seq in enumerate(seqs):
        data = f"@r\n{seq}\n+\n{'@' * len(seq)}\n".encode()
        (folder / (f"{i}.fq.gz" if i % 2 else f"{i}.fq")).write_bytes(gzip.compress(data) if i % 2 else data)
        if i:
            run()
    assert as_dict(counts.load_batches(spark, str(tmp_path / "out"))) == brute(seqs, 3, "max")


def test_commands(spark, tmp_path):
    from seqloom.__main__ import parser, run

    (tmp_path / "a.fq").write_text("@a\nACGACG\n+\nIIIIII\n@b\nTTTT\n+\nIIII\n")
    (tmp_path / "f.fa").write_text(">a\nACGACG\n")

    def call(*words):
        return run(parser().parse_args([str(w) for w in words]), spark)

    assert call("count", "-q", tmp_path / "a.fq", "-o", tmp_path / "c", "-k", 3, "--rcmode", "f", "-v", "count", 8) == 0
    assert as_dict(tables.load_counter(spark, f"{tmp_path}/c")[0]) == brute(["ACGACG", "TTTT"], 3, "f", 8)
    assert call("filtercount", "-f", tmp_path / "f.fa", "-o", tmp_path / "g", "-k", 3, "--rcmode", "f") == 0
    assert as_dict(tables.load_counter(spark, f"{tmp_path}/g")[0]) == {code("ACG"): 2}
    assert call("optimize", "-i", tmp_path / "c", "-o", tmp_path / "o", "-p", 2) == 0
    assert call("dump", "-i", tmp_path / "o", "-o", tmp_path / "d", "--text", "--values", "2") == 0
    assert {r.code for r in spark.read.csv(f"{tmp_path}/d", header=True).collect()} == {"ACG", "TTT"}
    assert call("check", tmp_path / "a.fq") == 0
    (tmp_path / "bad.fq").write_text("a\nA\n+\nI\n")
    assert call("check", tmp_path / "bad.fq") == 1


def test_annotation_joins(spark):
    bed = spark.createDataFrame([("NC_1", 9, 20, "gene=a;Dbxref=GeneID:1,miRBase:MI7"), ("NC_2", 4, 8, "Name=b c;"), ("NW_9", 1, 2, "gene=z")], "acc string, start0 long, end0 long, extra string")
    accessions = spark.createDataFrame([("NC_1", "1"), ("NC_2", "MT")], "acc string, chrom string")
    found = genes.bed_genes(bed, accessions)
    assert {tuple(r) for r in found.collect()} == {("1", 10, 20, "a,MI7"), ("MT", 5, 8, "b_c")}
    exons = spark.createDataFrame([("a,MI7", "1", 10, 12), ("a,MI7", "1", 12, 15), ("a,MI7", "1", 18, 20), ("a,MI7", "2", 1, 2)], "gene string, chrom string, start long, end long")
    assert [tuple(r) for r in genes.exon_lines(found, exons).collect()] == [("a,MI7", "1:10-20", 2, "1:10-15 1:18-20")]


def test_fastq_arguments():
    assert sequences.resolve_fastq(["a.fq"], ["x_R1_y_R1.fq"]) == [("a.fq", None), ("x_R1_y_R1.fq", "x_R1_y_R2.fq")]
    for bad in ((["a"], ["b"]), (["a", "a"], None), (["x_R2"], ["x_R1"])):
        with pytest.raises(ValueError):
            sequences.resolve_fastq(*bad)


def test_gene_tables(spark, tmp_path):
    rows = spark.createDataFrame([("g1", "1:1-10", 10, 1, 2), ("g2", "1:1-10", 10, 1, 3)], "gene string, region string, length long, n1 long, n2 long")
    ranked = genes.ranked(rows.withColumn("rate1", F.lit(5)).withColumn("rate2", F.col("n2")), ["rate1", "n1", "rate2", "n2", "gene", "region", "length"])
    tables.write_gene_table(ranked.coalesce(1), f"{tmp_path}/t")
    assert [tuple(r) for r in tables.read_gene_table(spark, f"{tmp_path}/t").orderBy("rank").collect()] == [(1, 5, 3, "g2", "1:1-10", 10, 1, 3), (2, 5, 2, "g1", "1:1-10", 10, 1, 2)]


def test_groups_and_histograms(spark):
    samples = spark.createDataFrame([(1, 0, 7, 5), (1, 1, 7, 9), (2, 0, 7, 1), (2, 0, 8, 9)], "grp int, sample int, code long, value long")
    limits = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 2)], "grp int, sample int, threshold int")
    pairs = compare.two_groups(samples, limits)
    assert {tuple(r) for r in pairs.collect()} == {(7, 2, 0), (8, 0, 1)}
    assert {tuple(r) for r in statistics.histogram_2d(pairs).collect()} == {(2, 0, 1, 50.0), (0, 1, 1, 50.0)}
    assert {tuple(r) for r in statistics.histogram_2d_wide(pairs, [0, 1]).collect()} == {(2, 1, 0), (0, 0, 1)}
    seqs = spark.createDataFrame([("a", "ACG"), ("a", "A"), ("b", "")], "grp string, seq string")
    assert {tuple(r) for r in statistics.group_sizes(seqs, "grp", offset=1).collect()} == {("a", 2, 6), ("b", 1, 1)}
    assert {tuple(r) for r in statistics.group_sizes(seqs, "grp", override=9).collect()} == {("a", 2, 9), ("b", 1, 9)}


def test_codes_at_the_borders_of_pieces(spark, monkeypatch):
    rng = random.Random(31)
    for n in (30, 31, 32, 61, 62, 63, 90, 200):
        seqs = ["".join(rng.choice("ACGT" if j % 2 else "ACGTTGCAAN") for _ in range(n)) for j in range(4)] + ["é😀" + "ACGTT" * (n // 5)]
        for k in (1, 5, 26, 27, 31, 32):
            mode = rng.choice(["f", "r", "min", "max", "both"])
            assert as_dict(counters.count(reads(spark, seqs), k, mode)) == brute(seqs, k, mode)
        for shape in ((0, 1, 3), (0, 2, 29, 30), (0, 30), (0, 31), (0, 40, 61)):
            assert as_dict(counters.count(reads(spark, seqs), shape, "max")) == brute(seqs, None, "max", shape=shape)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_positions_in_small_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(kmers, "BLOCK", block)
    rng = random.Random(32)
    seqs = ["".join(rng.choice("ACGTacguN") for _ in range(n)) for n in (0, 2, 3, 150)] + [None]
    frame = reads(spark, seqs).filter("seq IS NOT NULL") if block > 1 else reads(spark, seqs)
    for spread in (False, True):
        got = {(r.read_id, r.pos): r.code for r in kmers.position_codes(frame, 3, "f", keep=["read_id"], spread=spread).collect()}
        text_ = {(r.read_id, r.pos): r.kmer for r in kmers.positions(frame, 3, "f", keep=["read_id"], invalid=True).collect()}
        clean = [(s or "").translate(str.maketrans("acgtuU", "ACGTTT")) for s in seqs]
        want = {(i, p): s[p : p + 3] if set(s[p : p + 3]) <= set("ACGT") else None for i, s in enumerate(clean) for p in range(len(s) - 2)}
        assert text_ == want and got == {k: v and code(v) for k, v in want.items()}
        letters = {(r.read_id, r.pos): r.letter for r in kmers.letters(frame, keep=["read_id"], spread=spread).collect()}
        assert letters == {(i, p): c if c in "ACGT" else "N" for i, s in enumerate(clean) for p, c in enumerate(s)}


def test_counters_of_other_kmers_are_refused(spark):
    a, b = counters.count(reads(spark, ["ACGTACGT"]), 4), counters.count(reads(spark, ["ACGTACGT"]), 5)
    c, plain = counters.count(reads(spark, ["ACGTACGT"]), 4, "min"), spark.createDataFrame([(1, 2)], "code long, value long")
    for other in (b, c):
        for f in (counters.update, counters.update_existing, counters.store_new, counters.overwrite, counters.overwrite_existing, counters.lookup, compare.pick_unique, compare.default_mincount, compare.least_shared):
            with pytest.raises(ValueError):
                f(a, other)
        with pytest.raises(ValueError):
            compare.gain_loss(a, a, other, a, compare.is_loss(), compare.is_gain())
        with pytest.raises(ValueError):
            compare.difference(a.filter("value > 0").orderBy("code"), other, 1)
    with pytest.raises(ValueError):
        counters.verify(reads(spark, ["ACGT"]), b, 4)
    assert counters.update(a, plain).count() >= 1 and counters.update(a, a).count() == a.count()


def test_counters_of_files_keep_their_kmers(spark, tmp_path):
    for k in (4, 5):
        tables.save_counter(counters.count(reads(spark, ["ACGTACGT"]), k), f"{tmp_path}/{k}", counters.Parameters(k))
    a, b = (tables.load_counter(spark, f"{tmp_path}/{k}")[0] for k in (4, 5))
    with pytest.raises(ValueError):
        counters.update(a, b)


def test_parameter_precedence():
    from seqloom.__main__ import resolve_parameters

    none = dict.fromkeys(("nobjects", "type", "hashfunctions", "pagesize", "fill", "aligned"))
    assert resolve_parameters(None, none)["nobjects"] == 10_000_000
    got = resolve_parameters(["5", "x:a", "_", "4", "0.5"], {**none, "pagesize": 3})
    assert got == {"nobjects": 5, "type": "x", "aligned": True, "hashfunctions": "random", "pagesize": 3, "fill": 0.5}
    with pytest.raises(ValueError):
        resolve_parameters(["1"] * 6, none)


def test_more_commands(spark, tmp_path, monkeypatch):
    import io
    import types

    from seqloom import __main__ as command

    for end, seq in ((1, "ACGTTGCA"), (2, "GGGTTTAA")):
        (tmp_path / f"s_R{end}.fq").write_text(f"@r\n{seq}\n+\n{'I' * 8}\n")
    run = lambda *a: command.run(command.parser().parse_args(list(map(str, a))), spark)
    assert run("count", "--paired", tmp_path / "s_R1.fq", "-o", tmp_path / "pair", "-k", 3, "-P", 100, "_", "-p", 4) == 0
    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(b">a\nACGTTGCA\n")))
    assert run("count", "--fasta", "-", "-o", tmp_path / "one", "-k", 3, "--nostats") == 0
    pair, one = (as_dict(tables.load_counter(spark, str(tmp_path / n))[0]) for n in ("pair", "one"))
    assert pair == brute(["ACGTTGCA", "GGGTTTAA"], 3, "max", 32) and one == brute(["ACGTTGCA"], 3, "max", 32)
    assert run("diff", tmp_path / "pair", tmp_path / "one", "-o", tmp_path / "diff", "--mincount", 1, 1, "--below", 1) == 0
    rows = {r.code for r in spark.read.csv(f"{tmp_path}/diff/first", header=True).collect()}
    assert {code(c) for c in rows} == set(pair) - set(one)
    assert run("histogram", "-i", tmp_path / "one", "-o", tmp_path / "h") == 0
    assert run("gainloss", *[x for n in ("case", "control", "bait", "genomic") for x in (f"--{n}", tmp_path / "one")], "-o", tmp_path / "g") == 0
    assert run("dump", "-i", tmp_path / "pair", "-o", tmp_path / "d", "--text", "--values", 1, "2-3") == 0


def test_groups_in_folders(spark, tmp_path):
    one, two = spark.range(3), spark.range(2)
    root = str(tmp_path)
    assert tables.groups(spark, f"{root}/none") == [] and tables.only_group(spark, root, needed=False) is None and tables.largest_number(spark, root) is None
    tables.save_group(f"{root}/x5", {"a": one, "b": two}, {"k": 5, "shape": [0, 2], "name": "é"})
    tables.save_group(f"{root}/x11", {"b": one, "c": two})
    tables.save_group(f"{root}/x11", attributes={"k": None}, spark=spark)
    got = tables.load_group(spark, f"{root}/x5")
    assert got["a"].count() == 3 and (got["k"], got["shape"], got["name"]) == (5, [0, 2], "é") and set(got) == {"a", "b", "k", "shape", "name"}
    assert set(tables.load_group(spark, f"{root}/x11", ["k", "b"])) == {"k", "b"}
    with pytest.raises(KeyError):
        tables.load_group(spark, f"{root}/x5", ["a", "z"])
    assert tables.groups(spark, root) == ["x11", "x5"] and tables.largest_number(spark, root) == 11 and tables.only_group(spark, root, "5") == "x5"
    with pytest.raises(ValueError):
        tables.only_group(spark, root)
    with pytest.raises(ValueError):
        tables.only_group(spark, root, "y")
    assert tables.common_names(spark, [f"{root}/x5", f"{root}/x11"]) == ["b"]


def _long_reads(seed, n=12):
    rng = random.Random(seed)
    made = ["".join(rng.choice("ACGTNacgtu" if rng.random() < 0.02 else "ACGT") for _ in range(rng.randint(0, 300))) for _ in range(n)]
    return [*GOLDEN, *made, *made[:3], "AC" * 60, "T" * 150]


@pytest.mark.parametrize("mode", dna.MODES)
def test_long_kmers_match_brute_force(spark, mode):
    seqs = _long_reads(5)
    for k in (13, 27, 31):
        assert as_dict(counters.count(reads(spark, seqs), k, mode)) == brute(seqs, k, mode), k
    full = brute(seqs, 27, mode)
    assert as_dict(counters.filtered_count(reads(spark, seqs), 27, 1, mode=mode)) == {c: n for c, n in full.items() if n > 1}


def test_long_kmers_shuffle_runs_and_not_codes(spark):
    """What is dealt out is far less than a row for each distinct k-mer."""
    rng = random.Random(6)
    df = reads(spark, ["".join(rng.choice("ACGT") for _ in range(5000)) for _ in range(20)])
    plan = counters.count(df, 27)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(code" not in plan
    assert superkmers._dealt_runs(df, 27, "seq").agg(F.sum(F.length("data"))).first()[0] < 3 * 20 * 4974


def test_lookup_in_reads(spark):
    """Keys that reads have or not, keys twice and null ones; against the lookup in a whole counter."""
    seqs, other = _long_reads(7), _long_reads(8, 3)
    for k in (4, 27):
        for mode in ("f", "max"):
            full = brute(seqs, k, mode)
            codes = [*list(full)[::3], *brute(other, k, mode), *list(full)[:2], None]
            keys = spark.createDataFrame(list(enumerate(codes)), "i long, code long")
            got = {r.i: (r.code, r.value) for r in counters.lookup_reads(keys, reads(spark, seqs), k, mode).collect()}
            assert got == {i: (c, full.get(c, 0)) for i, c in enumerate(codes)}
    plan = counters.lookup_reads(keys, reads(spark, seqs), 27)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan
    with pytest.raises(ValueError):
        counters.lookup_reads(counters.count(reads(spark, seqs), 5), reads(spark, seqs), 27)


def test_large_buckets_go_to_files(monkeypatch):
    """More distinct codes than are held: sorted parts on disk, merged by ranges."""
    monkeypatch.setattr(superkmers, "HELD", 1000)
    rng = random.Random(9)
    tally, want = superkmers._Tally(), {}
    for _ in range(100):
        codes = [rng.randrange(10_000) << 40 for _ in range(300)]
        for c in codes:
            want[c] = want.get(c, 0) + 1
        tally.add(superkmers.np.array(codes, "uint64"))
    pieces = list(tally.counts())
    assert len(tally.files) > 1 and len(pieces) > 1
    assert [(int(c), int(n)) for codes, counts in pieces for c, n in zip(codes, counts)] == sorted(want.items())
