import random
import re

import numpy as np
import pytest
import pyarrow as pa
from seqloom.llm import near_dedup, textops
from seqloom.llm.components import components
from seqloom.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """component of each doc_id by comparing all pairs."""
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: root(d) for d in parent}


def dedup(spark, rows, schema=SCHEMA):
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, schema), Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    return got


def variants(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows, n = [], 0
    for _ in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 7)):
            copy = list(text)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "\n", "  "]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
            n += 7
    rng.shuffle(rows)
    return rows


def test_components_match_brute_force(spark):
    rows = variants()
    want = brute(rows)
    for r in dedup(spark, rows):
        assert r.component_id == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)
        assert r.n_shingles == len(shingles(dict(rows)[r.doc_id]))


def test_many_near_copies_that_only_a_centre_links(spark):
    rng = random.Random(9)
    centre = [f"w{i}" for i in range(60)]
    rows = [(500, " ".join(centre))]
    for n in range(60):
        copy = list(centre)
        copy[5 + n % 50] = f"x{n}"
        if n % 2:
            copy[(25 + n) % 50] = f"y{n}"
        rows.append((n, " ".join(copy)))
    rng.shuffle(rows)
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in dedup(spark, rows)} == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d e f"), (5, "a b c d e f"), (4, "A  b\tc D e f"), (4, "A b c d e f"), (9, "a b"), (8, "A B"), (7, "b a")]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in dedup(spark, rows)}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 2, None, True), (5, 2, 4, False), (4, 2, 4, True), (9, 1, 8, False), (8, 1, 8, True), (7, 1, 7, True)}


def test_empty_table_and_other_columns(spark):
    assert dedup(spark, []) == []
    frame = spark.createDataFrame([(1, "a b", "x", 3, True)], "doc_id long, text string, rep string, component_id int, kept boolean")
    assert near_dedup.near_duplicates(frame, Scratch(spark, "t")).collect()[0].asDict() == {"doc_id": 1, "n_shingles": 1, "component_id": 1, "kept": True}


@pytest.mark.parametrize("local", [0, 1000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr("seqloom.llm.components.LOCAL_EDGES", local)
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 50), (50, 100), (70, 70), (50, 60)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()
    assert {r.node: r.component for r in got} == {**{i: 1 for i in range(1, 31)}, 50: 50, 60: 50, 100: 50}
    assert len(got) == 33


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(1)
    for shared, own in ((900, 100), (600, 200), (100, 500)):
        both, a, b = rng.integers(0, 1 << 63, shared, dtype=np.uint64), *(rng.integers(0, 1 << 63, own, dtype=np.uint64) for _ in "ab")
        r = near_dedup.wide_sketch([np.concatenate((both, a)), np.concatenate((both, b))])
        n = np.array([shared + own])
        ok, estimate = near_dedup.plausible(n, n, r[:1], r[1:])
        similarity = shared / (shared + 2 * own)
        assert abs(estimate[0] - similarity) < 0.08
        assert ok[0] == (similarity > 0.75)


def test_sketches_merge():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 63, 300, dtype=np.uint64) for _ in "ab")
    one, two, both = near_dedup.sketch([a, b, np.concatenate((a, b))])
    assert (np.maximum(one, two) == both).all()


def test_words_and_lines_match_plain_python():
    rng = random.Random(4)
    texts = ["", None, "é x \n\n y", "\n"] + ["".join(rng.choice("ab é\n\t\x0b\x1f") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    column = pa.array(texts)
    for limit in (7, 1 << 20):
        for lo, hi, data, offsets in textops.chunks(column, limit):
            words, (starts, ends, rows) = textops.Words(data, offsets), textops.line_spans(data, offsets)
            for r in range(hi - lo):
                text = texts[lo + r] or ""
                at = range(words.rows[r], words.rows[r + 1])
                assert [bytes(data[words.starts[i] : words.ends[i]]).decode() for i in at] == WORD.findall(text)
                assert [bytes(data[starts[i] : ends[i]]).decode() for i in range(rows[r], rows[r + 1])] == text.split("\n")
    h = textops.Words(*textops.text_bytes(pa.array(["Ab ab", "ab", "ba ab"]))).hashes(lower=True)
    assert h[0] == h[1] == h[2] == h[4] != h[3]


def test_repeated_ids_are_one_node(spark):
    a, b = "one text of eight words stands right here", "quite another text of as many words here"
    got = {(r.doc_id, r.component_id, r.kept) for r in dedup(spark, [(4, a), (4, b), (2, b), (9, a)])}
    assert got == {(4, 2, False), (2, 2, True), (9, 2, False)}


def test_distinct_documents_are_rows(spark):
    a, b = "one text of eight words stands right here", "quite another text of as many words here"
    rows = [(4, a, 1), (4, b, 2), (2, b, 3), (2, b, 1), (9, a.upper(), 4), (None, a, 5), (None, a, 5), (7, None, 6), (7, None, 6), (7, " ", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    got = near_dedup.distinct_documents(docs, Scratch(spark, "t"))
    assert got.columns == docs.columns
    want = [(4, a, 1), (2, b, 1), (None, a, 5), (None, a, 5), (7, None, 6), (7, None, 6), (7, " ", 7)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    named = docs.selectExpr("doc_id", "text", "mark", "1 AS gone_id", "'x' AS first", "2 AS component_id", "3 AS _row", "4 AS ____id")
    got = near_dedup.distinct_documents(named, Scratch(spark, "t"))
    assert got.columns == named.columns and sorted(str(tuple(r)[:3]) for r in got.collect()) == sorted(map(str, want))
    empty = spark.createDataFrame([], docs.schema)
    assert near_dedup.distinct_documents(empty, Scratch(spark, "t")).collect() == []


@pytest.mark.parametrize("block", [1, 2, 7])
def test_blocks_of_any_size_give_the_same_components(spark, monkeypatch, block):
    # Star links alone leave several components to a bucket; all pairs of blocks then have to be met.
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(11)
    rows = []
    for g in range(3):
        centre = [f"w{g}x{i}" for i in range(60)]
        rows.append((900 + g, " ".join(centre)))
        for n in range(25):
            copy = list(centre)
            copy[5 + n % 50] = f"x{n}"
            if n % 2:
                copy[(25 + n) % 50] = f"y{n}"
            rows.append((100 * g + n, " ".join(copy)))
    rng.shuffle(rows)
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in dedup(spark, rows)} == want


def test_very_long_texts(spark):
    rng = random.Random(12)
    words = [f"v{rng.randrange(10**6)}" for _ in range(150_000)]
    near = list(words)
    for i in range(0, len(near), 40):
        near[i] = "other"
    rows = [(1, " ".join(near)), (2, " ".join(words)), (3, "v" * 1_500_000), (4, "V" * 1_500_000)]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in dedup(spark, rows)}
    assert got == {1: (1, len(shingles(rows[0][1]))), 2: (1, len(shingles(rows[1][1]))), 3: (3, 1), 4: (3, 1)}
