"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on ids."""

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .scratch import Scratch

END_ID = 1
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}
#: Distinct words that a worker keeps the ids of, and words that are encoded as one text.
CACHE_WORDS, JOINED_WORDS = 500_000, 1000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
# The second bytes of U+00C0 to U+00FF after 0xC3, without the multiplication and division signs.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'|"]] = True


def _segments(words: textops.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows' first segments and hashes of the words, each cut before the marks that end it.

    The cut stands after a letter, where this tokenizer always cuts. Letters A-Z hash as a-z, as it
    lower-cases. Words with a | are left as they are: they may hold special tokens.
    """
    data, starts, ends = words.data, words.starts, words.ends
    inner = np.flatnonzero(~_MARK[data])
    last = inner[np.maximum(np.searchsorted(inner, ends) - 1, 0)] if len(inner) else np.zeros(len(ends), np.int64)
    bars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 124, out=bars[1:])
    plain = bars[ends] == bars[starts]
    latin = _LATIN[data[last]] & (last > starts) & (data[np.maximum(last - 1, 0)] == 0xC3)
    cut = np.where(plain & (last >= starts) & (last < ends) & (_LETTER[data[last]] | latin), last + 1, ends)
    has_tail = cut < ends
    at = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(has_tail)))[:-1]
    n = len(starts) + int(has_tail.sum())
    s, e, bar = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
    s[at], e[at], bar[at] = starts, cut, ~plain
    s[at[has_tail] + 1], e[at[has_tail] + 1] = cut[has_tail], ends[has_tail]
    h = textops.span_hashes(data, s, e, lower=True)
    if bar.any():
        h[bar] = textops.mix(textops.span_hashes(data, s[bar], e[bar]) ^ textops.WINDOW_FACTORS[60])
    return s, e, np.append(at, n)[words.rows], h


# How a tokenizer file must be made for its tokens never to depend on what is across white space.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def drops_white_space(tokenizer) -> bool:
    """Is it made of the parts that WordEncoder relies on, with no special token without a |?"""
    made = json.loads(tokenizer.to_str())
    model = made["model"]
    return (
        (made["normalizer"] or {}).get("normalizers") == _NORMALIZERS
        and (made["pre_tokenizer"] or {}).get("pretokenizers") == [_SPLIT, _BYTES]
        and all("|" in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in made["added_tokens"])
        and not any(made[x] for x in ("post_processor", "truncation", "padding"))
        and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not (model["dropout"] or model["continuing_subword_prefix"] or model["unk_token"] or model["ignore_merges"])
    )


def _latin_only(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which spans hold nothing but A-Z, a-z and U+00C0 to U+00FF without the two signs."""
    good = _LETTER[data]
    pair = np.flatnonzero((data[:-1] == 0xC3) & _LATIN[data[1:]])
    good[pair] = good[pair + 1] = True
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(good, out=sums[1:])
    return sums[ends] - sums[starts] == ends - starts


class TextEncoder:
    """Ids of whole texts by any tokenizer, text by text."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, rows' offsets in them)."""
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.int32), *found]), np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))


class WordEncoder:
    """Ids of whole texts by a tokenizer that `drops_white_space`, so that words can be encoded apart.

    Each distinct word, without the marks that end it, is encoded once by the library; a text is
    its segments' ids in order. Words of Latin letters only, each one token run whose last token
    ends a word, are encoded many at a time as one text.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
            ends[number] = token.endswith("</w>")
        self.ends_word = ends
        self._reset()

    def _reset(self):
        self.place: dict[int, int] = {}
        self.lengths, self.firsts, self.ids, self.filled = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), np.empty(1 << 14, np.int32), 0
        self.known = 0

    @staticmethod
    def _room(column: np.ndarray, size: int) -> np.ndarray:
        return column if size <= len(column) else np.concatenate((column, np.empty(max(size, 2 * len(column)) - len(column), column.dtype)))

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each one's)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum())), lengths

    def _learn(self, hashes: np.ndarray, words: list[bytes], latin: np.ndarray) -> None:
        """Adds words; latin tells which have Latin letters only. Numbers are given in the order: these, then others."""
        plain, other = np.flatnonzero(latin), np.flatnonzero(~latin)
        parts = []
        for lo in range(0, len(plain), JOINED_WORDS):
            own = plain[lo : lo + JOINED_WORDS]
            ids, _ = self._library([b" ".join([words[i] for i in own]).decode()])
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) != len(own) or stops[-1] != len(ids):
                raise ValueError("the tokenizer does not end words as WordEncoder expects")
            parts.append((ids, np.diff(stops, prepend=0)))
        if len(other):
            parts.append(self._library([words[i].decode() for i in other]))
        for ids, lengths in parts:
            n, more, size = self.known, len(lengths), len(ids)
            self.lengths, self.firsts, self.ids = self._room(self.lengths, n + more), self._room(self.firsts, n + more), self._room(self.ids, self.filled + size)
            self.lengths[n : n + more] = lengths
            self.firsts[n : n + more] = self.filled + np.cumsum(lengths) - lengths
            self.ids[self.filled : self.filled + size] = ids
            self.filled, self.known = self.filled + size, n + more
        self.place.update(zip(hashes[np.concatenate((plain, other))].tolist(), range(self.known - len(words), self.known)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, rows' offsets in them)."""
        words = textops.Words(data, offsets)
        if not len(words):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        starts, ends, rows, h = _segments(words)
        coded = pa.array(h).dictionary_encode()
        distinct, index = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        if len(self.place) > CACHE_WORDS:
            self._reset()
        known = np.fromiter(map(self.place.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
        if (new := np.flatnonzero(known < 0)).size:
            first = np.full(len(distinct), -1)
            first[index[::-1]] = np.arange(len(index))[::-1]
            raw, at = data.tobytes(), first[new]
            self._learn(distinct[new], [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())], _latin_only(data, starts[at], ends[at]))
            known[new] = np.fromiter(map(self.place.__getitem__, distinct[new].tolist()), np.int64, len(new))
        entry = known[index]
        lengths = self.lengths[entry]
        stops = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.firsts[entry] - (stops - lengths), lengths) + np.arange(stops[-1])]
        return ids, np.concatenate(([0], stops))[rows]


def encoder(path: str) -> TextEncoder | WordEncoder:
    """Of a tokenizer file, by words where its parts allow that."""
    # A task has one core; the library's own threads would only take others' time.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return (WordEncoder if drops_white_space(tokenizer) else TextEncoder)(tokenizer)


@lru_cache(2)
def _encoder(path: str) -> TextEncoder | WordEncoder:
    return encoder(path)


def _with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends the end id to each row."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.int32)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, offsets + np.arange(n + 1)


def write(docs: DataFrame, path: str, partitions: int | None = None, vocabulary: str | None = None, end: int = END_ID) -> None:
    """Encodes docs (doc_id, text) into ORC files at path/data, rows in ascending order of doc_id.

    A row has doc_id, part (the file's place in the order), part_start (ids before it in the
    part), n_tokens (with the end id) and ids. path/index has doc_id range and token count of
    each part. A null text is empty: its row has the end id only. Null ids come first, rows that
    repeat an id in the order of their texts.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, start = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, data, offsets in textops.chunks(batch.column(1)):
                ids, cuts = _with_end(*encoder.encode(data, offsets), end)
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n), pa.array(np.full(n, part, np.int32)), pa.array(start + cuts[:-1]), pa.array(np.diff(cuts)),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)),
                    ],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                start += int(cuts[-1])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    rows.mapInArrow(run, schema).write.mode("overwrite").options(**ORC_OPTIONS).orc(f"{path}/data")
    stored = spark.read.schema(schema).orc(f"{path}/data")
    index = stored.groupBy("part").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    index.write.mode("overwrite").parquet(f"{path}/index")


def read(spark, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids from the files; start counts the ids of all rows before.

    doc_ids are pushed down to the stripes' statistics, row indexes and Bloom filters. Stripes are
    read in parallel: part_start is stored, so no row needs its neighbours.
    """
    index = spark.read.parquet(f"{path}/index")
    # One row for each part; the parts are as many as the tasks that wrote them.
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = index.select("part", before.alias("before"))
    rows = spark.read.orc(f"{path}/data")
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    return rows.join(base, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what `read` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            ids = column.values.to_numpy(zero_copy_only=False).astype("<u4")
            cuts = column.offsets.to_numpy()
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]])
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, schema)


def encoded(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Writes docs and returns the digests of what the files hold."""
    write(docs, scratch.path("tokens"))
    return digests(read(docs.sparkSession, scratch.path("tokens")))
