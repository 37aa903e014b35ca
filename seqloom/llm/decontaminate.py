"""Benchmark decontamination by template windows with typed slots, and by the words themselves."""

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops

WINDOW = 8
#: A window needs this many words that are no slots.
MIN_LITERALS = 4
#: Consecutive windows of an item, or all of a shorter one, that make a match.
MIN_RUN = 6
#: Words that make an exact match, those of MIN_RUN windows; a shorter item needs all of its words.
EXACT = WINDOW + MIN_RUN - 1
#: Bytes of benchmark text that are indexed and broadcast at a time, as an index of about ten times their size; a larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20

# Words that are units after a number.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds lb lbs ton tons ml l "
    "liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours hr day days week weeks month months year years "
    "dollar dollars usd euro euros eur cent cents percent degrees celsius fahrenheit watt watts kw volt volts mph kmh hz khz mhz kb mb gb tb"
).split()

_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0xA5A5_0001, 0xA5A5_0002, 0xA5A5_0003))
_CORE = np.zeros(256, bool)
_CORE[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True


def _unit_hashes() -> np.ndarray:
    data, offsets = textops.text_bytes(pa.array(UNITS))
    return np.sort(textops.span_hashes(data, offsets[:-1], offsets[1:], lower=True))


_UNIT_HASHES = _unit_hashes()


@dataclass
class Tokens:
    """Canonical hashes of the words of some rows, their raw hashes, the rows' first words, which words look like names, and the hashes that exact matches compare."""

    canonical: np.ndarray
    raw: np.ndarray
    rows: np.ndarray
    capital: np.ndarray
    exact: np.ndarray

    @property
    def slots(self) -> np.ndarray:
        return (self.canonical == _NUMBER) | (self.canonical == _NAME) | (self.canonical == _UNIT)


def tokenize(data: np.ndarray, offsets: np.ndarray, any_case: bool = True) -> Tokens:
    """Words without outer marks, lower-cased (A-Z); numbers, names and units become typed slots.

    A word with a digit is a number. A capital followed by a small letter is a name unless it
    begins a row, a line or a sentence. A listed unit counts after a number. Words of marks only
    are left out.
    """
    words = textops.Words(data, offsets)
    core = np.flatnonzero(_CORE[data])
    first = np.searchsorted(core, words.starts)
    last = np.searchsorted(core, words.ends) - 1
    solid = last >= first
    starts, ends = core[first[solid]], core[last[solid]] + 1
    # A sentence or line ends somewhere between the previous word's last core byte and this word.
    gap_starts = np.concatenate(([0], ends[:-1])) if len(starts) else starts
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_STOP[data] | (data == 10), out=breaks[1:])
    begins = breaks[starts] > breaks[gap_starts]
    rows = np.concatenate(([0], np.cumsum(solid)))[words.rows]
    begins[rows[:-1][rows[:-1] < len(starts)]] = True

    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_DIGIT[data], out=digits[1:])
    raw = textops.span_hashes(data, starts, ends, lower=True)
    number = digits[ends] > digits[starts]
    head, second = data[starts], data[np.minimum(starts + 1, ends - 1)]
    capital = (head >= 65) & (head <= 90) & (((second >= 97) & (second <= 122)) | (second >= 128))
    canonical = raw.copy()
    canonical[~begins & capital] = _NAME
    canonical[number] = _NUMBER
    after = np.flatnonzero(number) + 1
    after = after[after < len(raw)]
    unit = after[np.isin(raw[after], _UNIT_HASHES) & ~np.isin(after, rows[:-1])]
    canonical[unit] = _UNIT
    return Tokens(canonical, raw, rows, capital, raw if any_case else textops.span_hashes(data, starts, ends))


def _first_forms(tokens: Tokens, at: int, k: int) -> Iterator[np.ndarray]:
    """The first k canonical words of the item that begins at `at` as they are where other words stand before it: its first word may be a name or a unit there."""
    if tokens.canonical[at] == _NUMBER:
        return
    for slot, fits in ((_NAME, tokens.capital[at]), (_UNIT, np.isin(tokens.raw[at], _UNIT_HASHES))):
        if fits:
            form = tokens.canonical[at : at + k].copy()
            form[0] = slot
            yield form


def _usable(tokens: Tokens, at: np.ndarray, k: int) -> np.ndarray:
    literal = np.zeros(len(tokens.raw) + 1, np.int64)
    np.cumsum(~tokens.slots, out=literal[1:])
    return literal[at + k] - literal[at] >= MIN_LITERALS


def _grams(words: np.ndarray, lengths: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(k, sums over the k words from each word on) by ascending length; sums hold until the next step and may cross rows."""
    sums = np.zeros(len(words), np.uint64)
    for j in range(min(max(lengths, default=0), len(words))):
        sums = sums[: len(words) - j]
        sums += words[j:] * textops.WINDOW_FACTORS[j]
        if j + 1 in lengths:
            yield j + 1, sums


def _all_tokens(texts: list, any_case: bool) -> Tokens:
    parts, rows = [], [np.zeros(1, np.int64)]
    for _, _, data, offsets in textops.chunks(pa.array(texts, pa.large_string())):
        parts.append(tokenize(data, offsets, any_case))
        rows.append(parts[-1].rows[1:] + rows[-1][-1])
    join = lambda name, kind: np.concatenate([np.empty(0, kind), *[getattr(p, name) for p in parts]])
    return Tokens(join("canonical", np.uint64), join("raw", np.uint64), np.concatenate(rows), join("capital", bool), join("exact", np.uint64))


class _Table:
    """Rows by a sorted key, and a bit for each low part of a key that occurs."""

    def __init__(self, keys: np.ndarray, **columns: np.ndarray):
        order = np.lexsort((*reversed(columns.values()), keys))
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        self.columns = {name: c[order] for name, c in columns.items()}
        self.bits = np.zeros(1 << 16, bool)
        self.bits[self.keys & np.uint64(0xFFFF)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of h, row) of every row whose key is in h, by index."""
        at = np.flatnonzero(self.bits[h & np.uint64(0xFFFF)])
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[place] == h[at]
        at, place = at[good], place[good]
        n = self.first[place + 1] - self.first[place]
        return np.repeat(at, n), np.repeat(self.first[place] - np.cumsum(n) + n, n) + np.arange(n.sum())


class Index:
    """Template windows and exact words of benchmark items, by length; equal items count as the first one.

    All of it is arrays: about 50 bytes a word.
    """

    def __init__(self, item_ids: list, texts: list, any_case: bool = False):
        order = sorted(range(len(texts)), key=lambda i: (item_ids[i] is None, item_ids[i] or 0, texts[i] or ""))
        self.any_case, ids = any_case, [item_ids[i] for i in order]
        tokens = _all_tokens([texts[i] or "" for i in order], any_case)
        self.raw, self.starts, self.words = tokens.raw, tokens.rows[:-1], np.diff(tokens.rows)
        # number: the place of the first of equal items.
        seen: dict[bytes, int] = {}
        number = np.array([seen.setdefault(hashlib.blake2b(tokens.raw[a : a + n].tobytes(), digest_size=16).digest(), i) for i, (a, n) in enumerate(zip(self.starts, self.words))], np.int64)
        self.ids = ids
        first = (number == np.arange(len(number))) & (self.words > 0)
        self.total, self.need = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        self.exact, self.tables = self._exact_tables(tokens, number), {}
        for k in sorted({min(WINDOW, int(n)) for n in self.words[first] if n >= MIN_LITERALS}):
            own = first & (np.minimum(self.words, WINDOW) == k)
            if (table := self._template_table(tokens, own, k)) is not None:
                self.tables[k] = table

    def _exact_tables(self, tokens: Tokens, number: np.ndarray) -> dict[int, _Table]:
        size, out = np.minimum(self.words, EXACT), {}
        row = np.repeat(np.arange(len(self.words)), self.words)
        for k, sums in _grams(tokens.exact, {int(n) for n in size if n}):
            at = np.flatnonzero((size[row[: len(sums)]] == k) & (np.arange(len(sums)) + k <= tokens.rows[row[: len(sums)] + 1]))
            # Pairs of gram and item, once each.
            order = np.lexsort((number[row[at]], sums[at]))
            x, n = sums[at][order], number[row[at]][order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (n[1:] != n[:-1])
            out[k] = _Table(x[new], number=n[new].astype(np.int32))
        return out

    def _template_table(self, tokens: Tokens, own: np.ndarray, k: int) -> _Table | None:
        """Windows of the items in own: number, rank among the item's usable windows, place in it, slots as bits, and whether the first word itself must be equal."""
        h, at = textops.windows(tokens.canonical, tokens.rows, k)
        row = np.searchsorted(tokens.rows, at, "right") - 1
        good = own[row] & _usable(tokens, at, k)
        h, at, row = h[good], at[good], row[good]
        if not len(at):
            return None
        new = np.flatnonzero(np.diff(row, prepend=-1))
        count = np.diff(np.append(new, len(row)))
        self.total[row[new]], self.need[row[new]] = count, np.minimum(count, MIN_RUN)
        rank = np.arange(len(row)) - np.repeat(new, count)
        slots, mask = tokens.slots, np.zeros(len(at), np.uint8)
        for j in range(k):
            mask |= slots[at + j].astype(np.uint8) << np.uint8(j)
        place = at - tokens.rows[row]
        more = []
        for i in np.flatnonzero(place == 0).tolist():
            literals = k - 1 - int(mask[i] & 0xFE).bit_count()
            for form in _first_forms(tokens, int(at[i]), k):
                more.append((textops.windows(form, np.array([0, k]), k)[0][0], row[i], rank[i], 0, mask[i] | 1, literals < MIN_LITERALS))
        x, *columns = zip(*more) if more else [()] * 6
        kinds = {"number": np.int32, "rank": np.int32, "place": np.int32, "mask": np.uint8, "fixed": bool}
        base = (row, rank, place, mask, np.zeros(len(row), bool))
        joined = {name: np.concatenate((b, np.array(c, kind))).astype(kind) for (name, kind), b, c in zip(kinds.items(), base, columns)}
        return _Table(np.concatenate((h, np.array(x, np.uint64))), **joined)

    def _exact_matches(self, tokens: Tokens) -> dict[tuple[int, int], tuple[int, int]]:
        """(row, number) -> most consecutive windows that stand in the item word for word, and all windows of the item."""
        best: dict = {}
        for k, sums in _grams(tokens.exact, set(self.exact)):
            at, entry = self.exact[k].find(sums)
            row = np.searchsorted(tokens.rows, at, "right") - 1
            good = at + k <= tokens.rows[row + 1]
            at, row, own = at[good], row[good], self.exact[k].columns["number"][entry[good]].astype(np.int64)
            if not len(at):
                continue
            order = np.lexsort((at, own))
            at, row, own = at[order], row[order], own[order]
            runs = np.flatnonzero(np.concatenate(([True], (np.diff(own) != 0) | (np.diff(at) != 1) | (np.diff(row) != 0))))
            for r, number, size in zip(row[runs].tolist(), own[runs].tolist(), np.diff(np.append(runs, len(at))).tolist()):
                width = min(WINDOW, int(self.words[number]))
                total = int(self.words[number]) - width + 1
                best[r, number] = max(best.get((r, number), (0, 0)), (min(size + k - width, total), total))
        return best

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, object, int, int, bool]]:
        """(row, item id, matched windows, windows of the item, all slots equal) of each match, by templates, else by exact words."""
        tokens = tokenize(data, offsets, self.any_case)
        exact = self._exact_matches(tokens)
        for k, table in self.tables.items():
            h, at = textops.windows(tokens.canonical, tokens.rows, k)
            hit, entry = table.find(h)
            number, rank, place, mask, fixed = (c[entry] for c in table.columns.values())
            p = at[hit]
            good = ~fixed | (tokens.raw[p] == self.raw[np.minimum(self.starts[number], max(len(self.raw) - 1, 0))])
            row = np.searchsorted(tokens.rows, p[good], "right") - 1
            diagonals = defaultdict(list)
            for r, n, d, i, q, m in zip(row.tolist(), number[good].tolist(), p[good].tolist(), rank[good].tolist(), place[good].tolist(), mask[good].tolist()):
                slots = [j for j in range(k) if m >> j & 1]
                values = [int(self.raw[self.starts[n] + q + j]) for j in slots]
                diagonals[r, n, d - q].append((i, d, slots, values))
            best: dict = {}
            for (r, n, _), found in diagonals.items():
                for size, same in self._runs(sorted(found), tokens.raw):
                    if size >= self.need[n]:
                        best[r, n] = max(best.get((r, n), (0, False)), (size, same))
            for (r, n), (size, same) in sorted(best.items()):
                exact.pop((r, n), None)
                yield r, self.ids[n], size, int(self.total[n]), same
        for (r, n), (size, total) in sorted(exact.items()):
            yield r, self.ids[n], size, total, True

    @staticmethod
    def _runs(found: list, raw: np.ndarray) -> Iterator[tuple[int, bool]]:
        """Lengths of runs of consecutive windows in which equal slot values stay equal, and unequal ones unequal."""
        size, before, there, back, same = 0, None, {}, {}, True
        for rank, p, slots, values in found:
            new = [(v, int(raw[p + s])) for s, v in zip(slots, values)]
            fits = all(there.get(v, w) == w and back.get(w, v) == v for v, w in new)
            if size and (rank != before + 1 or not fits):
                yield size, same
                size, there, back, same = 0, {}, {}, True
            for v, w in new:
                there[v], back[w] = w, v
                same &= v == w
            size, before = size + 1, rank
        if size:
            yield size, same


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, text -> and the hashes of the words by which items are equal."""
    for batch in batches:
        for lo, hi, data, offsets in textops.chunks(batch.column(1)):
            tokens = tokenize(data, offsets)
            keys = [tokens.raw[a:b].tobytes() for a, b in zip(tokens.rows[:-1], tokens.rows[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(keys, pa.binary())], ["item_id", "text", "key"])


def _blocks(benchmark: DataFrame, any_case: bool) -> Iterator[Index]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // BLOCK_BYTES
    if n > 1:
        # Equal items share a block, which counts them as one; the same text stays once.
        items = items.mapInArrow(_with_key, "item_id long, text string, key binary").groupBy("key", "text").agg(F.min("item_id").alias("item_id"))
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == b)
        got = part.toPandas()
        ids = [None if x != x else int(x) for x in got["item_id"].tolist()]
        yield Index(ids, [x if isinstance(x, str) else None for x in got["text"].tolist()], any_case)


def contaminated(docs: DataFrame, benchmark: DataFrame, any_case: bool = False) -> DataFrame:
    """doc_id, item_id, matched windows, windows of the item and whether all slots are equal.

    One row for each row of docs (doc_id, text) and distinct benchmark item (item_id, text) of
    which it holds MIN_RUN consecutive template windows, or all if there are fewer, or EXACT
    consecutive words as they stand, or all words of a shorter item. Templates take windows with
    MIN_LITERALS words that are no slots; exact words have no such limit, and their case counts
    unless any_case. A match by exact words only counts all windows of the item. Equal items count
    as the one with the smallest id (a null id last); items without a word match nothing. A null
    text is empty; texts of any length are searched whole. A null doc_id stays null; rows that repeat
    are matched each; other columns are not read. An empty table on either side has no matches.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("item_id", "matched_windows", "item_windows")], T.StructField("same_slots", T.BooleanType())])
    out = None
    for index in _blocks(benchmark, any_case):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, _, data, offsets in textops.chunks(batch.column(1)):
                    if found := list(shared.value.matches(data, offsets)):
                        rows, items, size, total, same = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(np.array(rows) + lo)), *[pa.array(x, pa.int64()) for x in (items, size, total)], pa.array(same)], schema.fieldNames()
                        )

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, any_case: bool = False) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item as `contaminated` finds them."""
    at = docs.columns.index("text")
    for index in _blocks(benchmark, any_case):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in textops.chunks(batch.column(at)):
                    good[[lo + m[0] for m in shared.value.matches(data, offsets)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
