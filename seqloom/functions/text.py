"""Headers, regions, attributes and group names as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_word(header) -> Column:
    return F.regexp_extract(_col(header), r"^\s*(\S*)", 1)


def chromosome(header) -> Column:
    """Name of the chromosome in a header: its number or letter, MT for a mitochondrion.

    Null for unplaced and unlocalized sequences; an error for anything else.
    """
    header = _col(header)
    low = F.lower(header)
    name = F.regexp_extract(header, r"(?i)chromosome:?\s+([0-9A-Za-z]+)", 1)
    skipped = low.contains("unplaced") | low.contains("unlocalized")
    return F.when(skipped, F.lit(None)).when(low.contains("mitochondri"), F.lit("MT")).when(name != "", name).otherwise(F.raise_error(F.concat(F.lit("no chromosome in header: "), header)))


def header_items(header, names: list[str]) -> Column:
    """name:value items of a header in the order of names; words up to the next item joined by _, absent items left out."""
    header = _col(header)
    found = []
    for name in names:
        value = F.trim(F.regexp_extract(header, rf"(?:^|\s){name}:(.*?)(?=\s+\w+:|$)", 1))
        found.append(F.when(value != "", F.regexp_replace(value, r"\s+", "_")))
    return F.array_compact(F.array(*found))


def region(text) -> Column:
    """STRUCT<chrom, start, end> of chr, chr:, chr:s-e, chr:s-, chr:-e, chr:s+len, chr:pos.

    Positions are 1-based and inclusive; digits may have _ between them. A missing start is 1, a
    missing end 0: to the end of the chromosome.
    """
    text = F.trim(_col(text))
    chrom = F.regexp_extract(text, r"^([^:]+)", 1)
    rest = F.regexp_replace(F.regexp_extract(text, r"^[^:]+:(.*)$", 1), "[_ ]", "")
    number = lambda pattern: F.regexp_extract(rest, pattern, 1).try_cast("bigint")
    start, until, length = number(r"^(\d+)"), number(r"-(\d+)$"), number(r"\+(\d+)$")
    alone = rest.rlike(r"^\d+$")
    good = rest.rlike(r"^(\d*-\d*|\d+\+\d+|\d+|)$")
    end = F.when(alone, start).when(length.isNotNull(), start + length - 1).otherwise(F.coalesce(until, F.lit(0)))
    parsed = F.struct(chrom.alias("chrom"), F.coalesce(start, F.lit(1)).alias("start"), end.alias("end"))
    return F.when(good & (chrom != ""), parsed).otherwise(F.raise_error(F.concat(F.lit("no region: "), text)))


def attributes(extra) -> Column:
    """MAP of key=value pairs separated by ;."""
    return F.str_to_map(F.regexp_replace(_col(extra), r";\s*$", ""), F.lit(";"), F.lit("="))


def full_name(extra) -> Column:
    """Name (or gene) of the attributes, followed by synonyms and miRBase references, with _ for blanks."""
    a = attributes(extra)
    refs = F.filter(F.split(F.coalesce(a["Dbxref"], F.lit("")), ","), lambda x: x.startswith("miRBase:"))
    refs = F.transform(refs, lambda x: F.substring(x, 9, 1 << 20))
    name = F.coalesce(a["Name"], a["gene"])
    more = F.array_compact(F.concat(F.array(name, a["gene_synonym"]), refs))
    return F.replace(F.array_join(more, ","), F.lit(" "), F.lit("_"))


def file_stem(path) -> Column:
    """File name without any extension."""
    return F.regexp_extract(_col(path), r"([^/.]+)[^/]*$", 1)


def mate_name(name) -> Column:
    """The other file of a pair: the rightmost _R1 becomes _R2; null if there is none."""
    name = _col(name)
    return F.when(name.rlike("_R1"), F.regexp_replace(name, r"^(.*)_R1", "$1_R2"))


def group_name(how: str, path=None, header=None, names: dict | None = None, default: str = "other", value: str = "all") -> Column:
    """Group of a sequence: all, const, basename, seqname, strict (an error for unknown names) or dict (default for unknown ones)."""
    if how in ("all", "const"):
        return F.lit(value if how == "const" else "all")
    if how == "basename":
        return file_stem(path)
    if how == "seqname":
        return first_word(header)
    if how in ("strict", "dict"):
        table = F.create_map(*[F.lit(x) for kv in (names or {}).items() for x in kv]) if names else F.create_map().cast("map<string,string>")
        missing = F.lit(default) if how == "dict" else F.raise_error(F.concat(F.lit("no group for "), first_word(header)))
        return F.coalesce(table[first_word(header)], missing)
    raise ValueError(f"unknown grouping {how!r}")
