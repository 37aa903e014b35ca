"""Token counts of sections: whole texts are encoded once and their tokens attributed by offsets."""

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textops

#: How a token that crosses section borders is allocated.
RULES = ("most", "first", "last")


@lru_cache(2)
def encoder(path: str):
    """(byte-level encoding, bytes of each token id) of a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, does it cross a border), for token spans and the sections' ascending starts.

    Sections reach to the next one's start; empty ones get nothing. A token within one section
    belongs to it. One that crosses goes to the section with most of its bytes, the first of
    equals ("most"), or to that of its first or last byte.
    """
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    crossing = last > first
    out = last.copy() if rule == "last" else first.copy()
    if rule == "most":
        for t in np.flatnonzero(crossing):
            borders = np.concatenate(([starts[t]], sections[first[t] + 1 : last[t] + 1], [ends[t]]))
            out[t] = first[t] + int(np.diff(borders).argmax())
    return out, crossing


def section_tokens(docs: DataFrame, vocabulary: str, rule: str = "most") -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, section_tokens of every row of docs (doc_id, text).

    Sections are the \\n-split lines, each with the \\n that ends it. section_tokens has the count
    of each section, joined by commas; they add up to n_tokens. A null or empty text is one
    section without tokens; texts of any length are encoded whole. A null doc_id stays null. Other
    columns are not read; rows that repeat are counted each; without rows there is no result row.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = encoder(vocabulary)
        for batch in batches:
            for lo, hi, data, offsets in textops.chunks(batch.column(1)):
                raw, starts_of = data.tobytes(), textops.line_spans(data, offsets)
                lines, _, rows = starts_of
                out = []
                for r in range(hi - lo):
                    text = raw[offsets[r] : offsets[r + 1]].decode()
                    ids = np.array(encoding.encode_ordinary(text), np.int64)
                    ends = np.cumsum(lengths[ids])
                    sections = lines[rows[r] : rows[r + 1]] - offsets[r]
                    own, crossing = allocate(ends - lengths[ids], ends, sections, rule)
                    counts = np.bincount(own, minlength=len(sections)) if len(ids) else np.zeros(len(sections), int)
                    out.append((len(ids), len(sections), int(crossing.sum()), ",".join(map(str, counts.tolist()))))
                tokens, sections, crossing, counts = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(x, pa.int64()) for x in (tokens, sections, crossing)], pa.array(counts)], schema.names)

    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_sections", "n_crossing")], T.StructField("section_tokens", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
