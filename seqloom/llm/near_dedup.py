"""Near-duplicate documents by SetSketch registers, verified on full shingle sets.

A register is the floor of the negative logarithm of the least of exponentially distributed hash
values of a set, truncated to 16 bits (base 1.001) in bands or 8 bits (base 1.2) otherwise. Bands
of register values give candidate pairs, the joint likelihood of two wide sketches and the known
set sizes discards hopeless ones, and every link is confirmed on the full sets. Identical sets are one class from the start, so copies
never become pairs.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .components import components
from .scratch import Scratch

SHINGLE_WORDS = 5
MIN_SIMILARITY_PERCENT = 75
#: Bands of four registers: a pair at similarity 0.75 shares none with probability 5e-6.
BANDS, BAND_WIDTH = 32, 4
REGISTERS = BANDS * BAND_WIDTH
#: Registers of the sketches that pairs are estimated from, of which a first look takes some.
WIDE, FIRST_LOOK = 1024, 128
#: Equal registers of the first look below which a pair is dropped: six standard deviations under the mean at 0.75.
FIRST_EQUAL = 66
RATE = 20.0
#: Bases of the band registers (16 bits) and of the wide ones (8 bits).
BAND_BASE, WIDE_BASE = 1.001, 1.2
#: Candidates whose log-likelihood at or above the threshold is this far below its maximum are dropped.
LIKELIHOOD_GAP = 14.0
#: Members of a block; a larger bucket is compared in pairs of blocks.
BLOCK = 1024

_rng = np.random.default_rng(77001)
_FACTORS = _rng.integers(1, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2)


def shingle_sets(column: pa.Array, k: int = SHINGLE_WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for runs of rows."""
    for lo, hi, data, offsets in textops.chunks(column):
        words = textops.Words(data, offsets)
        h = words.hashes(lower=True)
        shingles, at = textops.windows(h, words.rows, k)
        cut = np.searchsorted(at, words.rows)
        counts = words.counts()
        sets = [np.empty(0, np.uint64)] * (hi - lo)
        short = np.flatnonzero((counts > 0) & (counts < k))
        for r, x in zip(short, textops.whole_hashes(h, words.rows, short)):
            sets[r] = np.array([x], np.uint64)
        for r in np.flatnonzero(counts >= k):
            s = np.sort(shingles[cut[r] : cut[r + 1]])
            sets[r] = s[np.concatenate(([True], s[1:] != s[:-1]))]
        yield lo, sets


def sketch(sets: list[np.ndarray], registers: int = REGISTERS, base: float = BAND_BASE, dtype=np.uint16) -> np.ndarray:
    """Registers of each non-empty set, a row each."""
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), registers), np.uint64)
    lo = 0
    while lo < len(sets):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), 1 << 15)))
        x = np.concatenate(sets[lo:hi])
        first = np.concatenate(([0], np.cumsum(sizes[lo:hi])[:-1]))
        h = np.empty_like(x)
        for i in range(registers):
            np.multiply(x, _FACTORS[i], out=h)
            h += _SHIFTS[i]
            out[lo:hi, i] = np.minimum.reduceat(h, first)
        lo = hi
    least = -np.log1p(-((out >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(base)), 0, np.iinfo(dtype).max).astype(dtype)


def wide_sketch(sets: list[np.ndarray]) -> np.ndarray:
    return sketch(sets, WIDE, WIDE_BASE, np.uint8)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """int64 keys, one for each row and band."""
    quads = np.ascontiguousarray(registers).view(np.uint64)
    return textops.mix(quads ^ textops.WINDOW_FACTORS[np.arange(BANDS)]).view(np.int64)


def _larger_probability(x: np.ndarray) -> np.ndarray:
    """Probability that one register exceeds the other, by the share x of what only one set has."""
    return -np.log1p(-np.clip(x, 0, 1) * (WIDE_BASE - 1) / WIDE_BASE) / np.log(WIDE_BASE)


def log_likelihood(j: np.ndarray, na, nb, above, below, registers: int) -> np.ndarray:
    """Joint log-likelihood of similarity j, given set sizes and how often register a exceeds b or is below."""
    u, v = na / (na + nb), nb / (na + nb)
    p, q = _larger_probability(u - v * j), _larger_probability(v - u * j)
    tiny = 1e-12
    equal = registers - above - below
    return above * np.log(p + tiny) + below * np.log(q + tiny) + equal * np.log(np.maximum(1 - p - q, tiny))


def plausible(na: np.ndarray, nb: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(can the pair reach the threshold, maximum-likelihood similarity) of pairs of wide sketches."""
    na, nb, m = na.astype(np.float64), nb.astype(np.float64), ra.shape[1]
    above, below = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    most = np.minimum(na, nb) / np.maximum(na, nb)
    bound = MIN_SIMILARITY_PERCENT / 100
    grid = np.linspace(0, 1, 65)[:, None]
    ll = log_likelihood(grid * most, na, nb, above, below, m)
    best = ll.max(axis=0)
    high = bound + (most - bound) * np.linspace(0, 1, 17)[:, None]
    reach = log_likelihood(np.minimum(high, most), na, nb, above, below, m).max(axis=0)
    ok = (100 * np.minimum(na, nb) >= MIN_SIMILARITY_PERCENT * np.maximum(na, nb)) & (reach >= best - LIKELIHOOD_GAP)
    return ok, grid[ll.argmax(axis=0), 0] * most


def _fixed(column: pa.Array, dtype) -> np.ndarray:
    """A matrix of a binary column whose values have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.empty((0, 1), dtype)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(n, -1).view(dtype)


def _print(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, mark, text -> and the size, print and registers of the text's set."""
    for batch in batches:
        for lo, sets in shingle_sets(batch.column(2)):
            full = [s for s in sets if len(s)]
            registers = iter(sketch(full) if full else ())
            prints = [_print(s) if len(s) else None for s in sets]
            marks = [next(registers).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).slice(lo, len(sets)) for i in (0, 1)], pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(marks, pa.binary())],
                ["doc_id", "mark", "n_shingles", "print", "registers"],
            )


def _to_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_fixed(batch.column(1), np.uint16))
            rep = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rep)], ["band", "rep"])


def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, print, text -> the sets that have this print, with their sketches."""
    for batch in batches:
        for lo, sets in shingle_sets(batch.column(2)):
            at = [i for i, (s, p) in enumerate(zip(sets, batch.column(1).slice(lo, len(sets)).to_pylist())) if len(s) and _print(s) == p]
            sets = [sets[i] for i in at]
            if sets:
                columns = [wide_sketch(sets), band_keys(sketch(sets)), sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([lo + i for i in at])), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([x.tobytes() for x in c], pa.binary()) for c in columns]],
                    ["rep", "n", "registers", "keys", "set"],
                )


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, b, na, nb, ra, rb -> the pairs a, b that can reach the threshold."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            ra, rb = _fixed(part.column(4), np.uint8), _fixed(part.column(5), np.uint8)
            ok, _ = plausible(part.column(2).to_numpy(), part.column(3).to_numpy(), ra, rb)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(ok))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, b, sa, sb -> the pairs whose full sets reach the threshold."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            ok.append(100 * shared >= MIN_SIMILARITY_PERCENT * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _best_pairs(band, rep, comp, size, registers, keys, side, k):
    """Plausible pairs of different components in one block; the k best of each two components (all if k is None).

    Of a pair that shares several bands only the first one counts, so no pair is made twice.

    side: 0 or 1 if the block joins two blocks, whose inner pairs other blocks have; else all -1.
    """
    n, found, look = len(rep), [], np.ascontiguousarray(registers[:, :FIRST_LOOK])
    rows = max(1, (1 << 20) // n)
    for lo in range(0, n - 1, rows):
        i = np.arange(lo, min(n - 1, lo + rows))
        ii, jj = np.nonzero((comp[i][:, None] != comp[None, :]) & (i[:, None] < np.arange(n)[None, :]) & ((side[i][:, None] != side[None, :]) | (side[0] < 0)))
        ii += lo
        if len(ii):
            for at in range(0, len(ii), 1 << 13):
                a, b = ii[at : at + (1 << 13)], jj[at : at + (1 << 13)]
                ok = (look[a] == look[b]).sum(axis=1) >= FIRST_EQUAL
                a, b = a[ok], b[ok]
                shared = keys[a] == keys[b]
                ok = keys[a, shared.argmax(axis=1)] == band
                a, b = a[ok], b[ok]
                ok, est = plausible(size[a], size[b], registers[a], registers[b])
                found.append((a[ok], b[ok], est[ok]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b, est = (np.concatenate(x) for x in zip(*found))
    if k is not None and len(a):
        ca, cb = np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])
        order = np.lexsort((-est, cb, ca))
        first = np.concatenate(([True], (ca[order][1:] != ca[order][:-1]) | (cb[order][1:] != cb[order][:-1])))
        start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        order = order[np.arange(len(order)) - start < k]
        a, b = a[order], b[order]
    return rep[a], rep[b]


def _block_pairs(k):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by band, i, j; a block may go on in the next batch."""
        held: list[pa.RecordBatch] = []

        def flush(part: pa.Table):
            part = part.combine_chunks()
            key = np.stack([part.column(c).to_numpy() for c in ("band", "i", "j")])
            cuts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [part.num_rows]))
            rep, comp, size, own = (part.column(c).to_numpy() for c in ("rep", "component", "n", "own"))
            registers, keys = _fixed(part.column("registers"), np.uint8), _fixed(part.column("keys"), np.int64)
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo > 1:
                    side = np.full(hi - lo, -1) if key[1, lo] == key[2, lo] else (own[lo:hi] == key[2, lo]).astype(int)
                    out.append(_best_pairs(key[0, lo], *[x[lo:hi] for x in (rep, comp, size, registers, keys)], side, k))
            a, b = (np.concatenate([x[t] for x in out] or [np.empty(0, np.int64)]) for t in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            key = np.stack([table.column(c).to_numpy() for c in ("band", "i", "j")])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if len(change):
                yield flush(table.slice(0, int(change[-1])))
                held = table.slice(int(change[-1])).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _attach(pairs: DataFrame, side: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Joins columns of `side` (by rep) to both ends of pairs (a, b)."""
    for end in ("a", "b"):
        pairs = pairs.join(side.select(F.col("rep").alias(end), *[F.col(c).alias(names[end == "b"]) for c, names in columns.items()]), end)
    return pairs


def _blocks(member: DataFrame) -> DataFrame:
    """band, rep, component, own, i, j: each member in every pair of blocks in which it meets other components.

    member has band, rep, component and c, the members of the bucket.

    A bucket of BLOCK members or fewer is one block. In a larger one a component of more than a
    quarter of a block has blocks of its own, of which no two meet, and the others share blocks;
    so one huge component costs a bucket as many rows as it has strangers' blocks, not its square.
    """
    zero = F.lit(0).cast("long")
    small = member.filter(F.col("c") <= BLOCK).select("band", "rep", "component", zero.alias("own"), zero.alias("i"), zero.alias("j"))
    big = member.filter(F.col("c") > BLOCK)
    if big.isEmpty():
        return small
    sizes = big.groupBy("band", "component").agg(F.count("*").alias("n"))
    large = 4 * F.col("n") > BLOCK
    rest = sizes.groupBy("band").agg(F.ceil(F.sum(F.when(large, 0).otherwise(F.col("n"))) / BLOCK).alias("shared"))
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.greatest(n, F.lit(1)))
    own = F.when(large, F.xxhash64("component", deal("rep", F.ceil(F.col("n") / BLOCK)))).otherwise(deal("component", F.col("shared")))
    group = F.when(large, F.col("component")).otherwise(F.lit(-1).cast("long"))
    big = big.join(sizes, ["band", "component"]).join(rest, "band").select("band", "rep", "component", group.alias("group"), own.alias("own"))
    blocks = big.select("band", "group", "own").distinct()
    groups = blocks.select("band", "group").distinct()
    meet = groups.withColumnRenamed("group", "g").join(groups.withColumnRenamed("group", "h"), "band").filter("g < h OR g = h AND g = -1")
    for end, place in (("g", "i"), ("h", "j")):
        meet = meet.join(blocks.select("band", F.col("group").alias(end), F.col("own").alias(place)), ["band", end])
    meet = meet.filter("g < h OR i <= j").select("band", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    ends = meet.withColumn("own", F.explode(F.array_distinct(F.array("i", "j"))))
    return small.unionByName(big.join(ends, ["band", "own"]).select(*small.columns))


def _classes(docs: DataFrame, sc: Scratch, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n_shingles, print of each row; print, rep, rep_mark, component_id, component_mark of each set).

    mark is a hash of the text. rep and rep_mark name the least row that has the set, component_id
    and component_mark that of all sets linked with it. by_id: sets of one doc_id are linked too.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    base = sc.save(texts.mapInArrow(_base, "doc_id long, mark long, n_shingles long, print binary, registers binary"), "base")
    full = base.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = full.groupBy("print").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.first("registers").alias("registers"))
    # Numbers of the classes hold once the table is written.
    classes = sc.save(classes.select(F.monotonically_increasing_id().alias("rep"), "print", F.col("least.doc_id").alias("doc_id"), F.col("least.mark").alias("mark"), "registers"), "classes")
    bands = classes.select("rep", "registers").mapInArrow(_to_bands, "band long, rep long")
    hubs = bands.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("last > hub").drop("last")
    buckets = sc.save(bands.join(hubs, "band").distinct(), "buckets")

    active = classes.select("rep", "print", "doc_id", "mark").join(buckets.select("rep").distinct(), "rep").hint("shuffle_hash")
    sets = texts.join(active, ["doc_id", "mark"]).select("rep", "print", "text").mapInArrow(_to_sets, "rep long, n long, registers binary, keys binary, set binary")
    sets = sc.save(sets, "sets")
    sketches = sets.select("rep", "n", "registers", "keys")

    def verified(pairs: DataFrame) -> DataFrame:
        return _attach(pairs, sets, {"set": ("sa", "sb")}).select("a", "b", "sa", "sb").mapInArrow(_linked, "a long, b long")

    stars = buckets.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    stars = _attach(stars, sketches, {"n": ("na", "nb"), "registers": ("ra", "rb")}).select("a", "b", "na", "nb", "ra", "rb")
    edges = verified(stars.mapInArrow(_likely, "a long, b long"))
    if by_id:
        repeated = full.groupBy("doc_id").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).filter("lo <> hi").select("doc_id")
        own = full.select("doc_id", "print").join(repeated, "doc_id").join(classes.select("print", "rep"), "print").groupBy("doc_id", "rep").agg(F.lit(1))
        least = own.groupBy("doc_id").agg(F.min("rep").alias("a"))
        edges = edges.unionByName(own.join(least, "doc_id").select("a", F.col("rep").alias("b")))
    found = components(edges, sc, "links-0")
    for i, k in enumerate((1, None), 1):
        # Buckets with members of one component only are done with.
        member = buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
        counts = member.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).filter("lo < hi").select("band", "c")
        member = sc.save(member.join(counts, "band"), f"open-{i}")
        if member.isEmpty():
            break
        rows = _blocks(member).join(sketches, "rep").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
        rows = rows.select("band", "i", "j", "rep", "component", "n", "own", "registers", "keys")
        more = sc.save(verified(rows.mapInArrow(_block_pairs(k), "a long, b long").distinct()), f"edges-{i}")
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), sc, f"links-{i}")
    least = F.min(F.struct("doc_id", "mark"))
    linked = classes.select("rep", "print", "doc_id", "mark").join(found.withColumnRenamed("node", "rep"), "rep")
    names = linked.groupBy("component").agg(least.alias("least"))
    label = linked.join(names, "component").select("rep", F.col("least.doc_id").alias("component_id"), F.col("least.mark").alias("component_mark"))
    label = classes.select("rep", "print", "doc_id", "mark").join(label, "rep", "left")
    label = label.select("print", F.coalesce("component_id", "doc_id").alias("component_id"), F.when(F.col("component_id").isNull(), F.col("mark")).otherwise(F.col("component_mark")).alias("component_mark"))
    sc.drop("buckets", "sets", *[f"{x}-{i}" for x in ("open", "edges") for i in (1, 2)])
    return base.select("doc_id", "mark", "n_shingles", "print"), label


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    Texts are compared as sets of distinct 5-word shingles of their lower-cased (A-Z) words; with
    fewer words the whole sequence is the one shingle. Documents whose sets have a similarity of
    0.75 or more are linked; component_id is the smallest doc_id reachable; kept says that it is
    the row's own. Null and wordless texts have an empty set and link with nothing. Rows that
    repeat a doc_id are one node with several sets: they share one component_id and are all kept
    or all not, but for those with an empty set. A row without doc_id links with nothing, has no
    component_id and is kept. Texts of any length are compared whole. Other columns are not read.

    Equal sets form a class. Bands link each member of a bucket with the bucket's first one; what
    stays apart in a bucket is then compared by sketch in blocks, the best pairs of each two
    components first and in the last round all.
    """
    base, label = _classes(docs, scratch, True)
    out = base.join(label.select("print", "component_id"), "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def distinct_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs, with all their columns, that stay if one of each group of near-duplicates does.

    Here rows are compared, not ids: rows that repeat a doc_id with different texts are different
    documents. Of a group the row with the smallest doc_id stays, then that with the smallest hash
    of its text, and of rows that agree in both the least by all columns. Rows without doc_id or
    words all stay.
    """
    base, label = _classes(docs, scratch, False)
    rows = base.filter("doc_id IS NOT NULL").join(label, "print")
    is_first = (F.col("doc_id") == F.col("component_id")) & (F.col("mark") == F.col("component_mark"))
    rows = rows.groupBy("doc_id", "mark").agg(F.min(is_first).alias("first"), F.count("*").alias("n"))
    # Names that no column of docs has.
    key, text = ("_" * max(map(len, docs.columns)) + x for x in ("id", "mark"))
    gone = scratch.save(rows.filter("NOT first OR n > 1").select(F.col("doc_id").alias(key), F.col("mark").alias(text), "first"), "gone")
    same = (F.col("doc_id").cast("long") == F.col(key)) & (F.xxhash64("text") == F.col(text))
    out = docs.join(gone.drop("first").hint("shuffle_hash"), same, "left_anti")
    again = gone.filter("first").drop("first")
    if again.isEmpty():
        return out
    one = docs.join(again, same, "left_semi").groupBy(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_mark")).agg(F.min(F.struct(*[docs[c] for c in docs.columns])).alias("_row"))
    return out.unionByName(one.select("_row.*"))
