"""Quality rules: boosted trees over document statistics, scored from flat node arrays."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Labelled rows that the trees are fitted on, at most; those with the smallest hash of their id.
TRAIN_ROWS = 20_000

#: Features, and +1 or -1 where the score may only rise or fall with them.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "duplicate_lines": -1, "repeated_words": -1, "upper_share": -1,
    "digit_share": 0, "mark_share": -1, "other_share": 0, "words_per_line": 0, "unlike_words": 0, "bare_words": 0,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_CLASSES = np.zeros(256, np.uint8)
_CLASSES[65:91] = 1
_CLASSES[97:123] = 2
_CLASSES[48:58] = 3
_CLASSES[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
_CLASSES[128:] = 5
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _per_row(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive cuts."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[cuts])


def _row_keys(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a row."""
    return textops.mix(h + np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(rows)) * textops.WINDOW_FACTORS[61])


def _repeated(keys: np.ndarray) -> np.ndarray:
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[place] == keys


def _distinct(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    order = np.lexsort((keys, np.repeat(np.arange(len(rows) - 1), np.diff(rows))))
    s = keys[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    return _per_row(first, rows)


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(COUNTS, FEATURES) of each text, as integer and float columns."""
    words = textops.Words(data, offsets)
    n = words.counts()
    kinds = _CLASSES[data]
    by_kind = [_per_row(kinds == c, offsets) for c in range(6)]
    lead = (data & 0xC0) != 0x80
    word_chars = _per_row(lead & textops._IS_WORD[data], offsets)
    symbols = _per_row(_IS_SYMBOL[data], offsets)

    starts, ends, lines = textops.line_spans(data, offsets)
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(textops._IS_WORD[data], out=inside[1:])
    full = inside[ends] > inside[starts]
    full_lines = _per_row(full, lines)
    full_rows = np.concatenate(([0], np.cumsum(full_lines)))
    keys = _row_keys(textops.span_hashes(data, starts[full], ends[full]), full_rows)
    dup_lines = full_lines - _distinct(keys, full_rows)

    h = words.hashes()
    window, at = textops.windows(h, words.rows, REPEAT_WINDOW)
    twice = at[_repeated(_row_keys(window, np.searchsorted(at, words.rows)))]
    cover = np.zeros(len(words) + 1, np.int64)
    cover[twice] += 1
    cover[twice + REPEAT_WINDOW] -= 1
    repeat = _per_row(np.cumsum(cover[:-1]) > 0, words.rows)
    bare = _per_row(_CLASSES[data[words.ends - 1]] != 4, words.rows)
    # Words that differ from the one two before them.
    changes = np.zeros(len(h), bool)
    changes[2:] = h[2:] != h[:-2]

    chars, words_f = np.maximum(word_chars, 1), np.maximum(n, 1)
    features = np.stack(
        [
            np.log1p(n), word_chars / words_f, symbols / words_f, dup_lines / np.maximum(full_lines, 1), repeat / words_f, by_kind[1] / chars,
            by_kind[3] / chars, by_kind[4] / chars, by_kind[5] / chars, n / np.maximum(full_lines, 1), _per_row(changes, words.rows) / words_f, bare / words_f,
        ],
        axis=1,
    ).astype(np.float64)
    return np.stack([n, word_chars, symbols, dup_lines, repeat], axis=1).astype(np.int64), features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


@dataclass
class Trees:
    """Complete trees of one depth: node arrays (tree, node) and leaf values (tree, leaf)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x. A row goes right where its feature exceeds the threshold."""
        total = np.full(len(x), self.prior)
        row, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[row, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return total


def fit(x: np.ndarray, y: np.ndarray, signs, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 2.0) -> Trees:
    """Boosted trees for labels 0 and 1 by logistic loss over binned features.

    A split on a feature with a sign keeps the two sides' values in that order, and the middle
    between them bounds everything below, so the score is monotonic in that feature. With one
    class or no row the result is a constant: positive, or the class.
    """
    inner = 2**depth - 1
    share = y.mean() if len(y) else 1.0
    if share in (0.0, 1.0):
        flat = np.zeros((0, inner))
        return Trees(flat.astype(np.int64), flat, np.zeros((0, inner + 1)), 1.0 if share else -1.0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    model = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), float(np.log(share / (1 - share))))
    total = np.full(len(y), model.prior)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for node in range(inner):
            lo, hi = bounds[node]
            bounds[2 * node + 1] = bounds[2 * node + 2] = (lo, hi)
            mine = at == node
            best = (1e-6, None)
            gs, hs = g[mine], h[mine]
            whole = gs.sum() ** 2 / (hs.sum() + l2)
            for f, sign in enumerate(signs):
                if not len(edges[f]):
                    continue
                b = binned[mine, f]
                gl = np.bincount(b, gs, len(edges[f]) + 1).cumsum()[:-1]
                hl = np.bincount(b, hs, len(edges[f]) + 1).cumsum()[:-1]
                gr, hr = gs.sum() - gl, hs.sum() - hl
                left, right = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - whole
                gain[(hl < 1e-3) | (hr < 1e-3) | (sign * (right - left) < 0)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, sign, (left[k] + right[k]) / 2))
            if best[1] is None:
                at[mine] = 2 * node + 1
                continue
            f, k, sign, middle = best[1]
            model.feature[t, node], model.threshold[t, node] = f, edges[f][k]
            at[mine] = 2 * node + 1 + (binned[mine, f] > k)
            if sign:
                low, high = (lo, middle), (middle, hi)
                bounds[2 * node + 1], bounds[2 * node + 2] = (low, high) if sign > 0 else (high, low)
        for leaf in range(inner + 1):
            mine = at == inner + leaf
            lo, hi = bounds[inner + leaf]
            value = -g[mine].sum() / (h[mine].sum() + l2)
            model.leaf[t, leaf] = rate * np.clip(value, lo, hi)
        total += model.leaf[t, at - inner]
    return model


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in textops.chunks(batch.column(2)):
            _, x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on at most `rows` labelled documents, those with the smallest hash of their id.

    Labels without id or quality are ignored; of contradicting ones the lower counts, and of rows
    that repeat an id the one with the smallest statistics.
    """
    wanted = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).cast("double").alias("y"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("doc_id", "y", "text")
    found = found.mapInArrow(_training_rows, "doc_id long, y double, x array<double>")
    got = found.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(np.float64), list(FEATURES.values()))


def _verdicts(column: pa.Array, model: Trees, least: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in textops.chunks(column):
        counts, x = statistics(data, offsets)
        failed = base_failed(counts)
        yield lo, hi, counts, failed, ~failed & (model.score(x) >= least)


def judge(docs: DataFrame, model: Trees, least: float = 0.0) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row.

    A null text counts as empty, has no words and so fails the base rules. Rows are judged one by
    one, whole at any length: a null id, repeated rows and other columns make no difference, and
    an empty table has an empty result. `least` is the log-odds that a document must reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, counts, failed, kept in _verdicts(batch.column(1), model, least):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *[pa.array(c) for c in counts.T], pa.array(failed), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "kept"]
                )

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep(docs: DataFrame, model: Trees, least: float = 0.0) -> DataFrame:
    """The rows of docs, with all their columns, that `judge` keeps."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [v[4] for v in _verdicts(batch.column(at), model, least)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
