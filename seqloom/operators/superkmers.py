"""Counts of long k-mers, where letters are dealt out in place of codes.

Windows that follow each other and have one minimizer (the m-mer of least hash among a window's, on
either strand) make a run, which is stored as its first window and the letters after it: 16 bytes for
seven windows at k = 27. Both strands of a k-mer have the same minimizer, so all its occurrences meet in
one bucket, where runs are taken apart again and counted by sorting.
"""

import tempfile
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare

#: Shorter k-mers have so few codes that partial aggregation does as well; longer ones do not fit a number.
LEAST, MOST = 13, 31
#: Bits of a bucket's number; a task counts its buckets one after the other.
BUCKET_BITS = 12
#: Letters that are looked at together.
CHUNK = 1 << 20
#: Runs that a task gathers before it deals them out.
GATHERED = 1 << 20
#: Codes of a bucket held in memory; more go to files as sorted parts.
HELD = 1 << 22
#: Rows of a batch of counts.
ROWS = 1 << 16

_DIGITS = np.full(256, 4, np.uint8)
_DIGITS[np.frombuffer(b"ACGTUacgtu", np.uint8)] = [0, 1, 2, 3, 3, 0, 1, 2, 3, 3]
_ORDER, _DEAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _u(x) -> np.uint64:
    return np.uint64(x)


def _minimizer(k: int) -> int:
    return min(15, k - 4)


def _longest(k: int) -> int:
    """Windows of a run at most: 28 letters after the first window, and no more than a window holds."""
    return min(29, k)


def _rolled(digits: np.ndarray, size: int, backward: bool = False) -> np.ndarray:
    """Codes of all windows of `size` digits; backward, of the windows read from their end."""
    n, length, done, out = len(digits), 1, 0, None
    now = digits.astype(np.uint64)
    glued = lambda a, b, x, y: (b << _u(2 * x) | a) if backward else (a << _u(2 * y) | b)
    while True:
        if size & length:
            m = n - done - length + 1
            out = now if out is None else glued(out[:m], now[done : done + m], done, length)
            done += length
        if 2 * length > size:
            return out
        now = glued(now[: n - 2 * length + 1], now[length:], length, length)
        length *= 2


def _hashes(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    return (np.minimum(forward, backward) * _ORDER >> _u(32)).astype(np.uint32)


def _buckets(least: np.ndarray) -> np.ndarray:
    return (least.astype(np.uint64) * _DEAL >> _u(64 - BUCKET_BITS)).astype(np.uint16)


def _runs(digits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and runs (first window; letters after it from the top bits on, and the number of windows in the lowest 8) of some digits, 4 for invalid letters."""
    m, n = _minimizer(k), len(digits) - k + 1
    before = np.concatenate([[0], np.cumsum(digits == 4, dtype=np.int64)])
    valid = before[k:] == before[:-k]
    digits = digits & 3
    codes = _rolled(digits, k)
    least, reach = _hashes(_rolled(digits, m), _rolled(3 - digits, m, True)), 1
    while reach < k - m + 1:
        step = min(reach, k - m + 1 - reach)
        least, reach = np.minimum(least[:-step], least[step:]), reach + step
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])]))
    size = np.diff(np.append(first, n))
    first, size = first[valid[first]], size[valid[first]]
    parts = -(-size // _longest(k))
    if len(parts) and parts.max() > 1:
        off = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * _longest(k)
        first, size = np.repeat(first, parts) + off, np.minimum(np.repeat(size, parts) - off, _longest(k))
    more = (size - 1).astype(np.uint64)
    # The letters after the first window are the last ones of the last window.
    after = codes[first + size - 1] << (_u(62) - _u(2) * more) << _u(2)
    return _buckets(least[first]), np.stack([codes[first], after | more + _u(1)], 1)


def _taken_apart(runs: np.ndarray, k: int, mode: str) -> np.ndarray:
    """The codes, in the given mode, of all windows of the runs."""
    size, mask, out = runs[:, 1] & _u(255), _u((1 << 2 * k) - 1), [runs[:, 0]]
    for i in range(1, int(size.max(initial=1))):
        runs = runs[size > i]
        size = size[size > i]
        out.append((runs[:, 0] << _u(2 * i) | runs[:, 1] >> _u(64 - 2 * i)) & mask)
    forward = np.concatenate(out)
    if mode == "f":
        return forward
    backward = _backward(forward, k)
    return {"r": lambda: backward, "min": lambda: np.minimum(forward, backward), "max": lambda: np.maximum(forward, backward), "both": lambda: np.concatenate([forward, backward])}[mode]()


def _backward(codes: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements: the pairs of bits of all 64 are turned round, then shifted to their place."""
    x = ~codes
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = (x >> _u(shift) & _u(mask)) | (x & _u(mask)) << _u(shift)
    return x.byteswap() >> _u(64 - 2 * k)


def _key_buckets(codes: np.ndarray, k: int) -> np.ndarray:
    m, back = _minimizer(k), _backward(codes, k)
    mask, w = _u((1 << 2 * m) - 1), k - m + 1
    least = np.full(len(codes), 0xFFFFFFFF, np.uint32)
    for i in range(w):
        least = np.minimum(least, _hashes(codes >> _u(2 * (w - 1 - i)) & mask, back >> _u(2 * i) & mask))
    return _buckets(least)


def _dealt(buckets: np.ndarray, rows: np.ndarray, kind: int):
    """A batch with a row for each bucket: the rows' bytes by their place, so that zeros lie together."""
    import pyarrow as pa

    order = np.argsort(buckets, kind="stable")
    buckets, data = buckets[order], np.ascontiguousarray(rows[order])
    at = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    width = data.itemsize * data.shape[1]
    data = data.view(np.uint8).reshape(-1, width)
    blobs = [data[a:b].T.tobytes() for a, b in zip(at, [*at[1:], len(buckets)])]
    return pa.RecordBatch.from_arrays([pa.array(buckets[at], pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "data"])


def _numbers(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8 * width, -1).T).view(np.uint64)


_DEALT = "bucket int, kind int, data binary"


def _dealt_runs(reads: DataFrame, k: int, seq: str) -> DataFrame:
    def run(batches):
        buckets, runs, n = [], [], 0
        for batch in batches:
            letters = _DIGITS[np.frombuffer("\n".join(x for x in batch.column(0).to_pylist() if x).encode(), np.uint8)]
            for start in range(0, len(letters) - k + 1, CHUNK):
                found = _runs(letters[start : start + CHUNK + k - 1], k)
                buckets.append(found[0])
                runs.append(found[1])
                n += len(found[0])
                if n >= GATHERED:
                    yield _dealt(np.concatenate(buckets), np.concatenate(runs), 1)
                    buckets, runs, n = [], [], 0
        if n:
            yield _dealt(np.concatenate(buckets), np.concatenate(runs), 1)

    return reads.select(seq).mapInArrow(run, _DEALT)


def _dealt_keys(keys: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if len(codes):
                yield _dealt(_key_buckets(codes, k), codes[:, None], 0)

    return keys.select(F.col("code").cast("bigint")).filter("code IS NOT NULL").mapInArrow(run, _DEALT)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    codes, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[at], np.add.reduceat(counts, at) if len(at) else counts


class _Tally:
    """Counts of the codes of a bucket. Beyond HELD distinct ones, sorted parts go to files and are merged by ranges of codes."""

    def __init__(self):
        self.raw, self.n, self.parts, self.files = [], 0, [], []

    def add(self, codes: np.ndarray) -> None:
        self.raw.append(codes)
        self.n += len(codes)
        if self.n >= HELD:
            self._settle()
            if sum(len(p[0]) for p in self.parts) >= HELD:
                self.parts = [_summed(self.parts)]
                # Few distinct codes stay; else adding up would go over the same ones again and again.
                if 2 * len(self.parts[0][0]) >= HELD:
                    self._put_away()

    def _settle(self) -> None:
        if self.n:
            codes = np.sort(np.concatenate(self.raw))
            at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            self.parts.append((codes[at], np.diff(np.append(at, len(codes))).astype(np.int64)))
            self.raw, self.n = [], 0

    def _put_away(self) -> None:
        (codes, counts), = self.parts
        file = tempfile.TemporaryFile()
        codes.tofile(file)
        counts.tofile(file)
        file.flush()
        n = len(codes)
        self.files.append((np.memmap(file, np.uint64, "r", 0, (n,)), np.memmap(file, np.int64, "r", 8 * n, (n,))))
        self.parts = []

    def counts(self):
        """Pieces of codes and counts, each code once."""
        self._settle()
        parts = [*self.files, *([_summed(self.parts)] if self.parts else [])]
        if not self.files:
            yield from parts
            return
        # Evenly spaced codes of the parts cut their union into ranges of HELD at most, or nearly so.
        seen = np.sort(np.concatenate([codes[:: max(1, HELD >> 10)] for codes, _ in parts]))
        ends = [*seen[512::512], None]
        at = [0] * len(parts)
        for end in ends:
            to = [len(codes) if end is None else int(np.searchsorted(codes, end)) for codes, _ in parts]
            yield _summed([(np.asarray(codes[a:b]), np.asarray(counts[a:b])) for (codes, counts), a, b in zip(parts, at, to)])
            at = to


class _KeyTally:
    """Counts of the keys of a bucket alone; all keys come before the first codes."""

    def __init__(self):
        self.keys, self.n = [], None

    def add(self, codes: np.ndarray) -> None:
        if self.n is None:
            self.keys = np.unique(np.concatenate(self.keys))
            self.n = np.zeros(len(self.keys), np.int64)
        at = np.searchsorted(self.keys, codes)
        at[at == len(self.keys)] = 0
        self.n += np.bincount(at[self.keys[at] == codes], minlength=len(self.keys))

    def counts(self):
        if len(self.keys):
            self.add(np.zeros(0, np.uint64))
            yield self.keys, self.n


def _counted(dealt: DataFrame, k: int, mode: str, keyed: bool) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        def made(held):
            codes, counts = (np.concatenate(x) for x in zip(*held))
            for a in range(0, len(codes), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(codes[a : a + ROWS].view(np.int64)), pa.array(counts[a : a + ROWS])], ["code", "n"])

        held, n = [], 0
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        for _, own in groupby(rows, key=lambda row: row[0]):
            tally = _KeyTally() if keyed else _Tally()
            for _, kind, data in own:
                if kind == 0:
                    tally.keys.append(_numbers(data, 1)[:, 0])
                elif not keyed or len(tally.keys):
                    tally.add(_taken_apart(_numbers(data, 2), k, mode))
            for piece in tally.counts():
                held.append(piece)
                n += len(piece[0])
                if n >= ROWS:
                    yield from made(held)
                    held, n = [], 0
        if held:
            yield from made(held)

    return dealt.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, "code bigint, n bigint")


def fits(reads: DataFrame, offsets) -> bool:
    """Whether windows with letters at the offsets are counted here: contiguous ones of LEAST to MOST letters, of tables that do not stream."""
    return not reads.isStreaming and LEAST <= len(offsets) <= MOST and offsets[-1] + 1 == len(offsets)


def occurrences(reads: DataFrame, k: int, mode: str = "max", seq: str = "seq") -> DataFrame:
    """code, n: how often each k-mer stands in reads."""
    prepare(reads.sparkSession)
    return _counted(_dealt_runs(reads, k, seq), k, mode, False)


def key_occurrences(keys: DataFrame, reads: DataFrame, k: int, mode: str = "max", seq: str = "seq") -> DataFrame:
    """code, n: how often each distinct code of keys stands in reads, 0 included."""
    prepare(reads.sparkSession)
    return _counted(_dealt_keys(keys, k).unionByName(_dealt_runs(reads, k, seq)), k, mode, True)
