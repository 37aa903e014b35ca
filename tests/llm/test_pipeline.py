import re
import zlib

import corpus_pipeline
import numpy as np
from seqloom.llm import quality, token_output
from test_dedup import brute
from test_llm_operators import brute_counts, brute_mix

PATH = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def core(text):
    return [w for w in (re.sub(r"^[^0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff]+$", "", x) for x in WORD.findall(text or "")) if w]


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    # Rows that no stage may trip over.
    odd = [(-1, None, None, None, None), (-2, "", "en", "src0", 0), (None, "word " * 40, "en", None, 5), (-3, "one two three", "en", "src1", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).cache()
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    def step(name, frame):
        got = [tuple(r) for r in stages[name](spark, frame, PATH).collect()]
        assert all(tuple(rows[r[0]]) == r for r in got)
        return spark.createDataFrame(got, docs.schema), [r[0] for r in got]

    model = quality.train(docs, spark.read.parquet(f"{PATH}/labels.parquet"))
    kept, ids = step("quality_rules", docs)
    verdict = {r.doc_id: r.kept for r in quality.judge(docs, model).collect()}
    assert sorted(map(str, ids)) == sorted(str(d) for d in rows if verdict[d])
    for d in ids:
        n, _, _, _, repeated = brute_counts(rows[d].text)
        assert n >= 20 and 100 * repeated <= 30 * n
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{PATH}/labels.parquet").collect()}
    assert np.mean([labels[d] for d in ids if d in labels]) > 0.97

    single, ids_2 = step("near_dedup", kept)
    parts = brute([(d, rows[d].text) for d in ids])
    assert sorted(map(str, ids_2)) == sorted(str(d) for d in ids if d is None or parts[d] == d)

    clean, ids_3 = step("decontamination", single)
    items = [core(r.text) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    grams = {tuple(x.lower() for x in i[j : j + 13]) for i in items for j in range(len(i) - 12)} | {tuple(x.lower() for x in i) for i in items if 4 <= len(i) < 13}
    lengths = {len(g) for g in grams}

    def leaks(text):
        w = [x.lower() for x in core(text)]
        return any(tuple(w[j : j + n]) in grams for n in lengths for j in range(len(w) - n + 1))

    leaked = {d for d in ids_2 if leaks(rows[d].text)}
    assert leaked and set(ids_2) - set(ids_3) == leaked

    mixed, ids_4 = step("mixing", clean)
    target, sizes = brute_mix([(d, rows[d].text, rows[d].source) for d in ids_3])
    longest = max(len(WORD.findall(rows[d].text)) for d in ids_3)
    for source in sizes:
        taken = sum(len(WORD.findall(rows[d].text)) for d in ids_4 if rows[d].source == source)
        assert abs(taken - target[source]) <= longest / 2 + 1
    assert max(ids_4.count(d) for d in set(ids_4)) <= 3 and set(ids_4) <= set(ids_3)

    out = stages["token_output"](spark, mixed, PATH).collect()
    tokenizer = token_output._encoder(token_output.vocabulary_path()).tokenizer
    start, got = 0, sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(ids_4, key=lambda d: (d is not None, d or 0))
    for r in got:
        ids = np.array([*tokenizer.encode(rows[r.doc_id].text, add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_pipeline_of_no_documents(spark, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{PATH}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_stage_over_an_unread_one(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    unread = stages["near_dedup"](spark, docs, PATH)
    mixed = stages["mixing"](spark, stages["decontamination"](spark, unread, PATH), PATH)
    assert stages["token_output"](spark, mixed, PATH).count() == mixed.count() > 0
