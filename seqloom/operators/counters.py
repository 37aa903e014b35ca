"""Counters: tables (code, value) with one row a code, and their updates and lookups."""

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from . import superkmers
from .kmers import codes, position_codes

NVALUES = 512


@dataclass(frozen=True)
class Parameters:
    """What a counter was made with."""

    k: int
    mode: str = "max"
    nvalues: int = NVALUES

    def __post_init__(self):
        dna.shape(self.k)
        dna.mode(self.mode)
        if self.nvalues < 2:
            raise ValueError("a counter needs two values or more")

    def asdict(self) -> dict:
        return asdict(self)


def check_same(*parameters: Parameters) -> Parameters:
    """ValueError unless all have the same k and mode."""
    if len({(p.k, p.mode) for p in parameters}) > 1:
        raise ValueError(f"k or mode differ: {parameters}")
    return parameters[0]


def marked(table: DataFrame, k: int | Sequence[int], mode: str) -> DataFrame:
    """The table with its shape and mode in the metadata of column code, which files and most operators keep."""
    return table.withMetadata("code", {"shape": list(dna.shape(k)), "mode": mode})


def same_codes(*tables: DataFrame) -> None:
    """ValueError if tables that say what their codes are do not agree; those without metadata are not checked."""
    found = [(tuple(m["shape"]), m["mode"]) for t in tables if (m := t.schema["code"].metadata) and "shape" in m]
    if len(set(found)) > 1:
        raise ValueError("counters of different k-mers: " + "; ".join(f"shape {list(s)} mode {m}" for s, m in dict.fromkeys(found)))


def saturated(value, nvalues: int) -> Column:
    return F.least(value, F.lit(nvalues - 1).cast("bigint"))


# Merge rules by name: a function of (increments column, arguments) that gives the aggregate.
VALUE_SETS: dict[str, Callable[..., Column]] = {
    "count": lambda increment, nvalues=NVALUES: saturated(F.sum(increment), nvalues),
    "pairs": lambda increment, bits1, bits2: dna.pack(
        F.least(F.coalesce(F.sum(F.when(increment < 1 << bits1, increment)), F.lit(0)), F.lit((1 << bits1) - 1)),
        F.least(F.coalesce(F.sum(F.when(increment >= 1 << bits1, F.shiftrightunsigned(increment, bits1))), F.lit(0)), F.lit((1 << bits2) - 1)),
        bits1,
    ),
}


def count(reads: DataFrame, k: int | Sequence[int], mode: str = "max", nvalues: int = NVALUES, seq: str = "seq") -> DataFrame:
    """The exact, saturating counter of all windows of reads."""
    return marked(occurrences(reads, k, mode, seq).select("code", saturated(F.col("n"), nvalues).alias("value")), k, mode)


def occurrences(reads: DataFrame, k: int | Sequence[int], mode: str = "max", seq: str = "seq") -> DataFrame:
    """code, n: how often each k-mer stands in reads.

    Long contiguous k-mers are counted by minimizers, others by a partial and a final hash aggregation.
    """
    offsets = dna.shape(k)
    if superkmers.fits(reads, offsets):
        return superkmers.occurrences(reads, len(offsets), dna.mode(mode), seq)
    return codes(reads, k, mode, seq).groupBy("code").agg(F.count("*").alias("n"))


def filtered_count(reads: DataFrame, k: int, admitted_after: int, filter_reads: DataFrame | None = None, mode: str = "max", nvalues: int = NVALUES) -> DataFrame:
    """Counts of reads, for k-mers seen more than admitted_after times in filter_reads (or reads).

    With the same input for both one aggregation does; else admitted k-mers without a count get 0.
    """
    if filter_reads is None:
        found = occurrences(reads, k, mode).filter(F.col("n") > admitted_after)
        return marked(found.select("code", saturated(F.col("n"), nvalues).alias("value")), k, mode)
    admitted = occurrences(filter_reads, k, mode).filter(F.col("n") > admitted_after).select("code")
    joined = admitted.join(occurrences(reads, k, mode).hint("merge"), "code", "left")
    return marked(joined.select("code", saturated(F.coalesce("n", F.lit(0).cast("bigint")), nvalues).alias("value")), k, mode)


def aggregate(increments: DataFrame, value_set: str = "count", *args) -> DataFrame:
    """(code, increment) rows merged by a named value set."""
    return increments.groupBy("code").agg(VALUE_SETS[value_set](F.col("increment"), *args).alias("value"))


def update(table: DataFrame, increments: DataFrame, nvalues: int = NVALUES) -> DataFrame:
    """Adds increments (code, value), inserting absent codes."""
    same_codes(table, increments)
    both = table.select("code", "value").unionByName(increments.select("code", "value"))
    return both.groupBy("code").agg(saturated(F.sum("value"), nvalues).alias("value"))


def update_existing(table: DataFrame, increments: DataFrame, nvalues: int = NVALUES) -> DataFrame:
    """Adds increments to codes that are present; others are ignored."""
    same_codes(table, increments)
    more = increments.groupBy("code").agg(F.sum("value").alias("more"))
    return table.join(more.hint("merge"), "code", "left").select("code", saturated(F.col("value") + F.coalesce("more", F.lit(0)), nvalues).alias("value"))


def store_new(table: DataFrame, new: DataFrame) -> DataFrame:
    """Inserts absent codes; present ones keep their value."""
    same_codes(table, new)
    return table.select("code", "value").unionByName(new.join(table.hint("merge"), "code", "left_anti").select("code", "value"))


def overwrite(table: DataFrame, new: DataFrame) -> DataFrame:
    """Replaces or inserts."""
    same_codes(table, new)
    return new.select("code", "value").unionByName(table.join(new.hint("merge"), "code", "left_anti").select("code", "value"))


def overwrite_existing(table: DataFrame, new: DataFrame) -> DataFrame:
    """Replaces the values of present codes."""
    same_codes(table, new)
    return table.join(new.select("code", F.col("value").alias("new")).hint("merge"), "code", "left").select("code", F.coalesce("new", "value").alias("value"))


def lookup(keys: DataFrame, table: DataFrame, name: str = "value") -> DataFrame:
    """keys with the value of their code, 0 if absent."""
    same_codes(keys, table)
    # The planner takes counters for as small as the files they come from; they grow with the input, so none is broadcast.
    return keys.join(table.select("code", F.col("value").alias(name)).hint("merge"), "code", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def lookup_reads(keys: DataFrame, reads: DataFrame, k: int | Sequence[int], mode: str = "max", nvalues: int = NVALUES, seq: str = "seq", name: str = "value") -> DataFrame:
    """keys with the value of their code in the counter of reads, 0 if absent, where no counter is needed for anything else.

    Long k-mers that are no keys are never put together; keys meet the runs of reads in their buckets.
    """
    same_codes(keys, marked(keys, k, mode))
    offsets = dna.shape(k)
    if not superkmers.fits(reads, offsets):
        return lookup(keys, count(reads, k, mode, nvalues, seq), name)
    found = superkmers.key_occurrences(keys, reads, len(offsets), dna.mode(mode), seq)
    return lookup(keys, found.select("code", saturated(F.col("n"), nvalues).alias("value")), name)


def parse_values(text: str) -> list[tuple[int, int]]:
    """Inclusive ranges of a list such as 1,3-5."""
    ranges = []
    for part in text.split(","):
        low, dash, high = part.strip().partition("-")
        ranges.append((int(low), int(high if dash else low)))
    return ranges


def select_values(table: DataFrame, values: str) -> DataFrame:
    condition = F.lit(False)
    for low, high in parse_values(values):
        condition = condition | F.col("value").between(low, high)
    return table.filter(condition)


def dump(table: DataFrame, k: int, values: str | None = None) -> DataFrame:
    """(code as letters, value), restricted to some values if given."""
    chosen = table if values is None else select_values(table, values)
    return chosen.select(dna.text("code", k).alias("code"), "value")


def count_items(table: DataFrame, condition: Column) -> DataFrame:
    return table.filter(condition).agg(F.count("*").alias("n"))


def get_items(table: DataFrame, condition: Column, limit: int) -> DataFrame:
    """The first `limit` codes that meet the condition, with the number of all that do."""
    chosen = table.filter(condition)
    return chosen.orderBy("code").limit(limit).select("code").crossJoin(F.broadcast(chosen.agg(F.count("*").alias("total"))))


def is_unique(table: DataFrame) -> DataFrame:
    """One row: do codes appear once each?"""
    return table.groupBy("code").count().agg((F.coalesce(F.max("count"), F.lit(1)) == 1).alias("is_unique"))


def optimize(table: DataFrame, partitions: int) -> DataFrame:
    """The same rows, dealt by code and sorted, for compact files and pruned scans."""
    return table.repartition(partitions, "code").sortWithinPartitions("code")


def verify(sequences: DataFrame, table: DataFrame, k: int, mode: str = "max", observed: int = 1, nvalues: int = NVALUES, keep: Sequence[str] = ("read_id",)) -> DataFrame:
    """Windows whose code is absent from the table or holds too small a value; empty if all is well."""
    same_codes(table, marked(table, k, mode))
    found = position_codes(sequences, k, mode, keep=keep, invalid=False)
    joined = found.join(table.hint("merge"), "code", "left")
    bad = F.col("value").isNull() | ~dna.count_compatible(F.lit(observed), "value", nvalues)
    return joined.filter(bad).select(*keep, "pos", "code")
