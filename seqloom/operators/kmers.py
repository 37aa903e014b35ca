"""Windows of k letters as rows, as text or as codes."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna

#: Letters of a piece: two numbers of HALF letters hold it, so its windows are made by shifts alone.
HALF = 31
PIECE = 2 * HALF
#: Windows of a block of a sequence along which positions count. Blocks are cut into pieces, so no array holds all pieces of a chromosome.
BLOCK = 1 << 16

_VALID = "ACGTUacgtu"


def _cut(seq, span: int, letters: int, letter: str = ".") -> Column:
    """Pieces of `letters` letters at most, each beginning after the last window of the one before.

    One pass over the text: a piece is seen ahead and only its windows' first letters are taken.
    """
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=({letter}{{{span},{letters}}})){letter}{{1,{letters - span + 1}}}"), F.lit(1))


def _piece_size(span: int) -> int:
    return max(PIECE, 2 * span)


def _valid_pieces(df: DataFrame, size: int, seq: str, keep: Sequence[str]) -> DataFrame:
    """keep and _piece: all windows of `size` valid letters, none of them in two pieces."""
    return df.select(*keep, F.explode(_cut(seq, size, _piece_size(size), f"[{_VALID}]")).alias("_piece"))


def _all_pieces(df: DataFrame, span: int, seq: str, keep: Sequence[str], position: bool = False, spread: bool = False) -> DataFrame:
    """keep, _piece and, if asked for, _at: where it begins. Invalid letters are N. spread deals the blocks of long sequences out."""
    size = _piece_size(span)
    clean = F.regexp_replace(seq, f"[^{_VALID}]", "N")
    if not position:
        return df.select(*keep, F.explode(_cut(clean, span, size)).alias("_piece"))
    blocks = df.select(*keep, F.posexplode(_cut(clean, span, BLOCK + span - 1)).alias("_b", "_block"))
    if spread:
        blocks = blocks.repartition(*keep, "_b")
    pieces = blocks.select(*keep, "_b", F.posexplode(_cut("_block", span, size)).alias("_p", "_piece"))
    at = F.col("_b").cast("bigint") * BLOCK + F.col("_p") * (size - span + 1)
    return pieces.select(*keep, at.alias("_at"), "_piece")


def _numbers(piece, digits: str, base: int) -> Column:
    """The number that the digits of some letters are, for _VALID and N in that order."""
    return F.conv(F.translate(piece, f"{_VALID}N", digits), base, 10).cast("bigint")


def _window(hi: str, lo: str, behind: Column, span: int) -> Column:
    """The code of the window of a piece with so many letters behind it; hi and lo are the numbers of the piece's halves."""
    # Letters behind the window may lie in the second half alone.
    whole = F.call_function("shiftright", F.col(hi), 2 * (behind - F.col("_low")))
    parted = F.call_function("shiftleft", F.col(hi), 2 * (F.col("_low") - behind)).bitwiseOR(F.call_function("shiftright", F.col(lo), 2 * behind))
    return F.when(behind >= F.col("_low"), whole).otherwise(parted).bitwiseAND(F.lit((1 << 2 * span) - 1))


def _with_codes(pieces: DataFrame, offsets: Sequence[int], mode: str, keep: Sequence[str], checked: bool) -> DataFrame:
    """keep, _i and code, in the given mode, of every window of the pieces (keep, _piece): null where a letter at the offsets is N, if they are to be checked.

    The reverse complement of a window is a window of the piece's, so it costs two shifts as well.
    """
    span = offsets[-1] + 1
    low = F.greatest(F.length("_piece") - HALF, F.lit(0))
    second = lambda text: F.when(low > 0, _numbers(F.substring(text, HALF + 1, HALF), "01233012330", 4)).otherwise(F.lit(0).cast("bigint"))
    first = lambda text: _numbers(F.substring(text, 1, HALF), "01233012330", 4)
    columns = {"_n": F.length("_piece"), "_low": low}
    if mode != "r":
        columns |= {"_hi": first("_piece"), "_lo": second("_piece")}
    if mode != "f":
        pieces = pieces.withColumn("_other", F.reverse(F.translate("_piece", _VALID, "TGCAAtgcaa")))
        columns |= {"_rhi": first("_other"), "_rlo": second("_other")}
    if checked:
        columns["_bad"] = _numbers("_piece", "00000000001", 2)
    rows = pieces.select(*keep, *[c.alias(n) for n, c in columns.items()])
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - span)).alias("_i"))
    behind = F.col("_n") - span - F.col("_i")
    forward = _picked(_window("_hi", "_lo", behind, span), offsets) if mode != "r" else None
    backward = _picked(_window("_rhi", "_rlo", F.col("_i"), span), [span - 1 - o for o in reversed(offsets)]) if mode != "f" else None
    code = {"f": lambda: forward, "r": lambda: backward, "min": lambda: F.least(forward, backward), "max": lambda: F.greatest(forward, backward), "both": lambda: F.array(forward, backward)}[mode]()
    if checked:
        mask = sum(1 << (span - 1 - o) for o in offsets)
        good = F.call_function("shiftright", F.col("_bad"), behind).bitwiseAND(F.lit(mask)) == 0
        none = F.lit(None).cast("bigint")
        code = F.when(good, code).otherwise(F.array(none, none) if mode == "both" else none)
    return rows.select(*keep, "_i", F.explode(code).alias("code") if mode == "both" else code.alias("code"))


def _picked(window: Column, offsets: Sequence[int]) -> Column:
    """The code of the letters at the offsets of a window's code: runs of neighbours are moved together."""
    span, size = offsets[-1] + 1, len(offsets)
    if span == size:
        return window
    out, done = F.lit(0).cast("bigint"), 0
    starts = [i for i in range(size) if i == 0 or offsets[i] != offsets[i - 1] + 1]
    for a, b in zip(starts, [*starts[1:], size]):
        run = F.shiftright(window, 2 * (span - offsets[a] - (b - a))).bitwiseAND(F.lit((1 << 2 * (b - a)) - 1))
        done += b - a
        out = out.bitwiseOR(F.shiftleft(run, 2 * (size - done)))
    return out


def _text_windows(pieces: DataFrame, offsets: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """keep, _i and kmer of every window of the pieces."""
    span = offsets[-1] + 1
    rows = pieces.withColumn("_piece", dna.bases("_piece")).select(*keep, "_piece", F.explode(F.sequence(F.lit(0), F.length("_piece") - span)).alias("_i"))
    if span == len(offsets):
        return rows.select(*keep, "_i", F.col("_piece").substr(F.col("_i") + 1, F.lit(span)).alias("kmer"))
    return rows.select(*keep, "_i", F.concat(*[F.col("_piece").substr(F.col("_i") + 1 + o, F.lit(1)) for o in offsets]).alias("kmer"))


def windows(df: DataFrame, k: int | Sequence[int], seq: str = "seq", keep: Sequence[str] = ()) -> DataFrame:
    """A row with `kmer` for each window without invalid letters, and the columns in keep.

    For an int windows over invalid letters are never made. For a spaced shape only the letters at
    its offsets must be valid. A null or short sequence has no window.
    """
    offsets = dna.shape(k)
    if offsets[-1] + 1 == len(offsets):
        return _text_windows(_valid_pieces(df, len(offsets), seq, keep), offsets, keep).select(*keep, "kmer")
    found = _text_windows(_all_pieces(df, offsets[-1] + 1, seq, keep), offsets, keep)
    return found.filter(~F.col("kmer").contains("N")).select(*keep, "kmer")


def kmers(df: DataFrame, k: int | Sequence[int], mode: str = "max", seq: str = "seq", keep: Sequence[str] = ()) -> DataFrame:
    """`windows` in the given mode; both gives two rows a window, also for palindromes."""
    found = windows(df, k, seq, keep)
    if dna.mode(mode) == "both":
        return found.select(*keep, F.explode(F.array("kmer", dna.reverse_complement("kmer"))).alias("kmer"))
    return found.withColumn("kmer", dna.canonical("kmer", mode))


def _by_shifts(offsets: Sequence[int]) -> bool:
    return offsets[-1] < HALF


def codes(df: DataFrame, k: int | Sequence[int], mode: str = "max", seq: str = "seq", keep: Sequence[str] = ()) -> DataFrame:
    """keep and `code` of each window without invalid letters, in the given mode.

    For spans of up to HALF letters codes come from two numbers a piece, by shifts in generated
    code; wider ones go by way of text.
    """
    offsets, size = dna.shape(k), len(dna.shape(k))
    if not _by_shifts(offsets):
        return kmers(df, k, mode, seq, keep).select(*keep, dna.code("kmer", size).alias("code"))
    if offsets[-1] + 1 == size:
        return _with_codes(_valid_pieces(df, size, seq, keep), offsets, dna.mode(mode), keep, False).select(*keep, "code")
    found = _with_codes(_all_pieces(df, offsets[-1] + 1, seq, keep), offsets, dna.mode(mode), keep, True)
    return found.filter("code IS NOT NULL").select(*keep, "code")


def positions(df: DataFrame, k: int | Sequence[int], mode: str = "max", seq: str = "seq", keep: Sequence[str] = (), invalid: bool = False) -> DataFrame:
    """keep, pos (0-based) and kmer of each window; invalid ones have a null kmer if asked for, else no row."""
    offsets = dna.shape(k)
    pieces = _all_pieces(df, offsets[-1] + 1, seq, keep, position=True)
    rows = _text_windows(pieces, offsets, [*keep, "_at"])
    rows = rows.select(*keep, (F.col("_at") + F.col("_i")).alias("pos"), F.when(~F.col("kmer").contains("N"), F.col("kmer")).alias("kmer"))
    if dna.mode(mode) == "both":
        out = rows.select(*keep, "pos", F.explode(F.array("kmer", dna.reverse_complement("kmer"))).alias("kmer"))
    else:
        out = rows.select(*keep, "pos", dna.canonical("kmer", mode).alias("kmer"))
    return out if invalid else out.filter("kmer IS NOT NULL")


def position_codes(df: DataFrame, k: int | Sequence[int], mode: str = "max", seq: str = "seq", keep: Sequence[str] = (), invalid: bool = True, spread: bool = False) -> DataFrame:
    """keep, pos and code for every window; the code is null where a letter is invalid, or such windows are left out.

    spread deals blocks of the sequences out by keep and place, for few and long ones.
    """
    offsets = dna.shape(k)
    if not _by_shifts(offsets):
        return positions(df, k, mode, seq, keep, invalid).select(*keep, "pos", dna.code("kmer", len(offsets)).alias("code"))
    pieces = _all_pieces(df, offsets[-1] + 1, seq, keep, position=True, spread=spread)
    rows = _with_codes(pieces, offsets, dna.mode(mode), [*keep, "_at"], True)
    out = rows.select(*keep, (F.col("_at") + F.col("_i")).alias("pos"), "code")
    return out if invalid else out.filter("code IS NOT NULL")


def letters(df: DataFrame, seq: str = "seq", keep: Sequence[str] = (), spread: bool = False) -> DataFrame:
    """keep, pos and letter of every position; U is T and invalid letters are N."""
    pieces = _all_pieces(df, 1, seq, keep, position=True, spread=spread).withColumn("_piece", dna.bases("_piece"))
    rows = pieces.select(*keep, "_at", "_piece", F.explode(F.sequence(F.lit(0), F.length("_piece") - 1)).alias("_i"))
    return rows.select(*keep, (F.col("_at") + F.col("_i")).alias("pos"), F.col("_piece").substr(F.col("_i") + 1, F.lit(1)).alias("letter"))


def subsample(reads: DataFrame, step: int, read_id: str = "read_id") -> DataFrame:
    """Every step-th read of a file, by its index."""
    return reads if step == 1 else reads.filter(F.pmod(F.col(read_id), F.lit(step)) == 0)
