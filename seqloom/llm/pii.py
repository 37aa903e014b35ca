"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textops

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the field finds: keys, tokens and passwords.
FIELD_KINDS = (*KINDS, "secret")
TAGS = ("other", *FIELD_KINDS)
#: Words on each side of a candidate word that form its sequence, within its line.
REACH = 6

_LOCAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits, so the look-behind changes nothing but keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str) -> list[int]:
    return [int(c) for c in _DIGITS.findall(text)]


def is_card(text: str) -> bool:
    d = _digits(text)
    return 13 <= len(d) <= 19 and luhn(d)


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def is_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: a match holds one @ and begins where its run of local characters does."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind, then start; in code points."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for kind, pattern, valid in (("ip", _IP, is_ip), ("card", _CARD, is_card), ("phone", _PHONE, is_phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(m[0])]
    return out


# Words that the features know.
LEXICON = {
    "at": ("(at)", "[at]", "{at}", "<at>"),
    "dot": ("(dot)", "[dot]", "{dot}", "<dot>", "dot"),
    "mail": ("email", "e-mail", "mail", "email:", "e-mail:", "mail:", "contact", "write"),
    "phone": ("phone", "phone:", "tel", "tel:", "tel.", "call", "mobile", "mobile:", "fax", "fax:", "telephone"),
    "card": ("card", "card:", "visa", "mastercard", "credit", "debit"),
    "ip": ("ip", "ip:", "address", "host", "server"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "secret_key", "auth", "bearer", "key"),
    "sign": ("=", ":", ":=", "=>"),
    "prefix": ("akia", "asia", "ghp_", "xoxb", "sk_l", "pk_l"),
    "code": ("commit", "version", "sha", "id", "order", "invoice", "isbn", "file", "model"),
}

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = ord("X")
_SHAPE[97:123] = ord("x")
_SHAPE[48:58] = ord("d")
_SHAPE[128:] = ord("x")
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_IS_CORE = np.zeros(256, bool)
_IS_CORE[[b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b) in "+(["]] = True
#: A bracketed at or dot inside a word.
_BRACKETED = re.compile(rb"[(\[{<](?:at|dot)[)\]}>]", re.I)
#: Lengths, and changes between small letters, capitals and digits, at which the form of a word differs.
LENGTH_STEPS, CHANGE_STEPS = np.array([8, 14, 18, 28]), np.array([2, 4, 7])
_CLASS = np.zeros(256, np.int8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
DIGIT_STEPS = np.array([1, 2, 3, 4, 5, 7, 9, 10, 11, 13, 16, 17, 20])


def _lexicon_hashes() -> tuple[np.ndarray, np.ndarray]:
    words = [(w, i) for i, group in enumerate(LEXICON.values(), 1) for w in group]
    data, offsets = textops.text_bytes(pa.array([w for w, _ in words]))
    h = textops.span_hashes(data, offsets[:-1], offsets[1:], lower=True)
    order = np.argsort(h)
    return h[order], np.array([i for _, i in words])[order]


_LEXICON_KEYS, _LEXICON_IDS = _lexicon_hashes()


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of h in the sorted keys, -1 where absent."""
    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[place] == h, place, -1)


def _lexicon(h: np.ndarray) -> np.ndarray:
    place = _find(_LEXICON_KEYS, h)
    return np.where(place >= 0, _LEXICON_IDS[np.maximum(place, 0)], 0)


def word_features(words: textops.Words, which: np.ndarray) -> dict[str, np.ndarray]:
    """Of the words `which`: hash of the shape with runs shortened to one, bucket of the digit count, lexicon groups of the word and of what is before its first = or : (else of its first four bytes), form."""
    starts, ends, data = words.starts[which], words.ends[which], words.data
    kinds = _SHAPE[data]
    change = np.ones(len(kinds), bool)
    change[1:] = kinds[1:] != kinds[:-1]
    change[starts] = True
    sums = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    at = sums(change)
    shape = textops.span_hashes(kinds[change], at[starts], at[ends])
    count = lambda flags: (lambda x: x[ends] - x[starts])(sums(flags))
    digits = count(_IS_DIGIT[data])
    signs = np.flatnonzero((data == 61) | (data == 58))
    cut = np.append(signs, len(data))[np.searchsorted(signs, starts)]
    inner = (cut > starts) & (cut < ends - 1)
    key = _lexicon(textops.span_hashes(data, starts, np.where(inner, cut, np.minimum(starts + 4, ends)), lower=True))
    classes = _CLASS[data]
    turns = np.zeros(len(classes), bool)
    turns[1:] = (classes[1:] != classes[:-1]) & (classes[1:] > 0) & (classes[:-1] > 0)
    turns[starts] = False
    form = np.searchsorted(LENGTH_STEPS, ends - starts, "right")
    for more, n in ((np.searchsorted(CHANGE_STEPS, count(turns), "right"), 4), (count(classes == 1) > 0, 2), (count(classes == 2) > 0, 2), (digits > 0, 2)):
        form = form * n + more
    return {"shape": shape, "digits": np.searchsorted(DIGIT_STEPS, digits, "right"), "lexicon": _lexicon(textops.span_hashes(data, starts, ends, lower=True)), "key": key, "form": form}


#: Values of the features but shape, whose number the labelled table decides.
SIZES = {"digits": len(DIGIT_STEPS) + 1, "lexicon": len(LEXICON) + 1, "key": len(LEXICON) + 1, "form": (len(LENGTH_STEPS) + 1) * 32}


@dataclass
class Field:
    """Weights of the features of a word and its neighbours, and of tag transitions."""

    shapes: np.ndarray  # sorted hashes; an unknown shape has none of the weights
    emit: dict[str, np.ndarray]  # feature -> (position -1, 0, +1; value; tag)
    move: np.ndarray
    begin: np.ndarray

    def ids(self, words: textops.Words, which: np.ndarray) -> dict[str, np.ndarray]:
        found = word_features(words, which)
        return found | {"shape": _find(self.shapes, found["shape"]) + 1}

    def scores(self, ids: dict[str, np.ndarray], cuts: np.ndarray) -> np.ndarray:
        """(word, tag) scores of sequences laid end to end."""
        n = cuts[-1]
        total = np.zeros((n, len(TAGS)))
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[cuts[:-1]], last[cuts[1:] - 1] = True, True
        for name, values in ids.items():
            w = self.emit[name]
            total += w[1][values]
            total[1:] += np.where(first[1:, None], 0, w[0][values[:-1]])
            total[:-1] += np.where(last[:-1, None], 0, w[2][values[1:]])
        return total

    def decode(self, scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The best tag of each word: Viterbi over batches of sequences of similar length."""
        out = np.zeros(cuts[-1], np.int64)
        lengths = np.diff(cuts)
        for bucket in np.unique(np.ceil(np.log2(np.maximum(lengths, 1)))):
            rows = np.flatnonzero(np.ceil(np.log2(np.maximum(lengths, 1))) == bucket)
            n = int(lengths[rows].max())
            step = max(1, (1 << 20) // n)
            for lo in range(0, len(rows), step):
                own = rows[lo : lo + step]
                at = np.minimum(cuts[own][:, None] + np.arange(n), cuts[own + 1][:, None] - 1)
                valid = np.arange(n) < lengths[own][:, None]
                s = scores[at]
                best, back = self.begin + s[:, 0], np.zeros((len(own), n, len(TAGS)), np.int8)
                for t in range(1, n):
                    paths = best[:, :, None] + self.move
                    back[:, t] = np.where(valid[:, t, None], paths.argmax(axis=1), np.arange(len(TAGS)))
                    best = np.where(valid[:, t, None], paths.max(axis=1) + s[:, t], best)
                tag = best.argmax(axis=1)
                for t in range(n - 1, -1, -1):
                    out[at[valid[:, t], t]] = tag[valid[:, t]]
                    tag = back[np.arange(len(own)), t, tag].astype(np.int64)
        return out


def labelled_table(seed: int = 5, rows: int = 400) -> list[tuple[str, list[str]]]:
    """A small labelled table: sentences and a tag for each word, from a few invented patterns."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: "".join(pick("an", "be", "cor", "da", "el", "fi", "go", "ha", "in", "ka", "lo") for _ in range(rng.integers(1, 4)))

    def phone():
        a, b, c = number(3), number(3), number(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+{number(2)} {number(2)} {b} {c}", f"{a}.{b}.{c}", f"00{number(2)} {a} {b} {c}")

    def email():
        host = pick("example", "mail", "post") + number(rng.integers(0, 2))
        return pick(f"{name()}@{host}.com", f"{name()} (at) {host}.org", f"{name()} [at] {host} [dot] com", f"{name()} (at) {host} (dot) net", f"{name()}.{name()}@{host}.example.com", f"{name()} {{at}} {host} dot com")

    def card():
        d = [int(c) for c in pick("4", "51", "37") + number(13)][:15]
        d.append(next(x for x in range(10) if luhn([*d, x])))
        s = "".join(map(str, d))
        return pick(s, " ".join(s[i : i + 4] for i in range(0, 16, 4)), "-".join(s[i : i + 4] for i in range(0, 16, 4)), ".".join(s[i : i + 4] for i in range(0, 16, 4)))

    def ip():
        p = [str(rng.integers(0, 256)) for _ in range(4)]
        return pick(".".join(p), " . ".join(p), "[.]".join(p))

    def drawn(letters, n):
        return "".join(letters[i] for i in rng.integers(0, len(letters), n))

    def secret():
        hexa, mixed, upper = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
        value = pick(drawn(hexa, rng.integers(16, 45)), drawn(mixed, rng.integers(16, 41)), drawn(mixed, 4) + "-" + drawn(mixed, 20))
        quote = pick("", "", '"', "'")
        said = pick(*LEXICON["secret"][:12])
        return pick(f"{said}={quote}{value}{quote}", f"{said} = {quote}{value}{quote}", f"{said}: {quote}{value}{quote}", f"{said} {value}", pick("AKIA", "ASIA") + drawn(upper, 16), f"{pick('sk_live_', 'pk_live_', 'ghp_', 'xoxb-')}{drawn(mixed, 28)}")

    def code():
        return pick(f"commit {drawn('0123456789abcdef', rng.integers(7, 11))}", f"file{number(8)}.txt", f"img_{number(8)}_{number(4)}.jpg", f"http://host/{name()}{number(3)}", f"{drawn('ABCDEFGH', 2)}-{number(4)}-{drawn('XYZ', 2)}", f"id={number(5)}", f"x={number(2)}", f"version: {number(1)}.{number(2)}", f"{name()}{number(2)}", f"order {drawn('ABCDEF', 3)}{number(6)}", f"{name()}=\"{name()}\"", f"token {name()}", f"password {name()}")

    def plain():
        return code() if rng.random() < 0.4 else pick(f"{rng.integers(1900, 2030)}", f"{number(rng.integers(1, 7))}", f"${number(3)},{number(3)}", f"{number(1)}.{number(2)}", f"{number(2)}/{number(2)}/{number(4)}", f"v{number(1)}.{number(1)}.{number(1)}", f"{number(2)}%", f"{number(2)}:{number(2)}", f"no. {number(8)}", f"{number(20)}", "a0f" + number(6) + "e", f"{number(3)} {number(3)} {number(3)}", f"{number(2)}-{number(2)}-{number(4)}")

    makers, cues = {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret, "other": plain}, {"email": "mail", "ip": "ip", "card": "card", "phone": "phone"}
    table = []
    for _ in range(rows):
        tokens, tags = [], []
        for _ in range(rng.integers(1, 3)):
            fill = [(name() if rng.random() < 0.8 else name().capitalize()) + pick("", "", "", "", ".", ",", "###", "***") for _ in range(rng.integers(0, 6))]
            kind = pick("email", "ip", "card", "phone", "secret", "other", "other", "other")
            if kind in cues and rng.random() < 0.4:
                fill.append(pick(*LEXICON[cues[kind]]))
            value = (makers[kind]() + pick("", "", "", ".", ",", *(["###", "***"] if kind == "secret" else []))).split(" ")
            tokens += fill + value
            tags += ["other"] * len(fill) + [kind] * len(value)
        tokens += (after := [name() for _ in range(rng.integers(0, 5))])
        tags += ["other"] * len(after)
        table.append((" ".join(tokens), tags))
    # Addresses written out without blanks, one word each, among other words.
    for _ in range(rows):
        a, b = pick("()", "[]", "{}", "<>")
        host = pick("example", "mail", "post") + number(rng.integers(0, 2))
        big = rng.random() < 0.3
        case = (lambda x: x.capitalize()) if big else (lambda x: x)
        value = case(name()) + pick("", "." + case(name())) + pick(f"{a}at{b}", f"{a}AT{b}") + host + pick(f"{a}dot{b}", f"{a}DOT{b}" if big else f"{a}dot{b}", ".") + pick("com", "org", "net") + pick("", "", "", "", ".", ",")
        before = [pick(name(), name().capitalize(), *LEXICON["mail"]) for _ in range(rng.integers(0, 6))]
        after = [name() for _ in range(rng.integers(0, 6))]
        table.append((" ".join([*before, value, *after]), ["other"] * len(before) + ["email"] + ["other"] * len(after)))
    return table


def train(table: list[tuple[str, list[str]]], steps: int = 120, rate: float = 0.2, l2: float = 0.02) -> Field:
    """Weights of greatest penalised likelihood of the labelled table, by gradient steps over batches of all rows."""
    data, offsets = textops.text_bytes(pa.array([t for t, _ in table]))
    words = textops.Words(data, offsets)
    cuts, every = words.rows, np.arange(len(words))
    gold = np.array([TAGS.index(t) for _, tags in table for t in tags])
    if len(gold) != len(words):
        raise ValueError("each word needs one tag")
    shape = word_features(words, every)["shape"]
    values, counts = np.unique(shape, return_counts=True)
    k = len(TAGS)
    sizes = {"shape": int((counts > 1).sum()) + 1, **SIZES}
    field = Field(values[counts > 1], {f: np.zeros((3, n, k)) for f, n in sizes.items()}, np.zeros((k, k)), np.zeros(k))
    ids = field.ids(words, every)
    n, longest = len(table), int(np.diff(cuts).max())
    at = np.minimum(cuts[:-1, None] + np.arange(longest), cuts[1:, None] - 1)
    valid = np.arange(longest) < np.diff(cuts)[:, None]
    first, last = np.zeros(len(words), bool), np.zeros(len(words), bool)
    first[cuts[:-1]], last[cuts[1:] - 1] = True, True
    params = [*field.emit.values(), field.move, field.begin]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        s = field.scores(ids, cuts)[at]
        forward = np.zeros((n, longest, k))
        forward[:, 0] = field.begin + s[:, 0]
        for t in range(1, longest):
            paths = np.logaddexp.reduce(forward[:, t - 1, :, None] + field.move, axis=1) + s[:, t]
            forward[:, t] = np.where(valid[:, t, None], paths, forward[:, t - 1])
        z = np.logaddexp.reduce(forward[:, -1], axis=1)
        backward, pair = np.zeros((n, longest, k)), np.zeros((k, k))
        for t in range(longest - 2, -1, -1):
            ahead = field.move + (s[:, t + 1] + backward[:, t + 1])[:, None, :]
            on = valid[:, t + 1]
            backward[:, t] = np.where(on[:, None], np.logaddexp.reduce(ahead, axis=2), 0)
            pair += np.exp(forward[on, t, :, None] + ahead[on] - z[on, None, None]).sum(axis=0)
        marginal = np.exp(forward + backward - z[:, None, None])[valid]
        error = -marginal
        error[np.arange(len(gold)), gold] += 1
        grads = []
        for name, size in sizes.items():
            g = np.zeros((3, size, k))
            np.add.at(g[1], ids[name], error)
            np.add.at(g[0], ids[name][:-1][~first[1:]], error[1:][~first[1:]])
            np.add.at(g[2], ids[name][1:][~last[:-1]], error[:-1][~last[:-1]])
            grads.append(g)
        inner = ~first[1:]
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[:-1][inner], gold[1:][inner]), 1)
        grads += [seen - pair, error[first].sum(axis=0)]
        for p, g, a, b in zip(params, grads, m, v):
            g = g / n - l2 * p / 10
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return field


@lru_cache(1)
def default_field() -> Field:
    return train(labelled_table())


def _sequences(words: textops.Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word indexes of all sequences, cuts): words within REACH of a word with a digit, an @, or a written-out at or dot, alone or bracketed inside the word, in its line."""
    mark = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_IS_DIGIT[data] | (data == 64), out=mark[1:])
    flag = mark[words.ends] > mark[words.starts]
    place = _find(_LEXICON_KEYS, words.hashes(lower=True))
    flag |= (place >= 0) & (_LEXICON_IDS[np.maximum(place, 0)] <= 2)
    inner = np.array([m.start() for m in _BRACKETED.finditer(data.tobytes())], np.int64)
    # Such a mark holds no space, so it lies inside the last word that begins before it or with it.
    flag[np.searchsorted(words.starts, inner, "right") - 1] = True
    found = np.flatnonzero(flag)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.maximum(found - REACH, 0), 1)
    np.add.at(cover, np.minimum(found + REACH + 1, len(words)), -1)
    inside = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    if not len(inside):
        return inside, np.zeros(1, np.int64)
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    group = breaks[words.starts[inside]]
    row = words.row_of()[inside]
    new = np.flatnonzero((np.diff(inside) > 1) | (np.diff(group) > 0) | (np.diff(row) > 0)) + 1
    return inside, np.concatenate(([0], new, [len(inside)]))


def _plausible(kind: str, text: str) -> bool:
    if kind == "phone":
        return is_phone(text)
    if kind == "card":
        return is_card(text)
    if kind == "ip":
        parts = re.split(r"\D+", text.strip("[]() ."))
        return len(parts) == 4 and all(parts) and is_ip(".".join(parts)) and not re.search(r"[A-Za-z,:/]", text)
    if kind == "secret":
        value = re.split(r"[=:\s]", text.strip("\"'.,;"))[-1].strip("\"'")
        return len(value) >= 12 and _TOKEN.fullmatch(value) is not None and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    # The text begins and ends with no white space, so something stands before and after what is inside it.
    at = any(m.start() > 0 and m.end() < len(text) for m in _AT.finditer(text))
    return at and any(m.start() > 0 and (m[0][0] != "." or not text[m.start() - 1].isspace()) for m in _DOT.finditer(text))


# What makes a written-out address; nothing in them is tried twice.
_AT = re.compile(r"@|[(\[{<]\s*+at\s*+[)\]}>]", re.I)
_DOT = re.compile(r"\.[A-Za-z]{2}|dot\s*+[)\]}>]?+\s*+[A-Za-z]{2}", re.I)
_TOKEN = re.compile(r"[A-Za-z0-9_+/.=-]+")


def find(column: pa.Array, field: Field) -> Iterator[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each row, in code points, by kind, then start."""
    order = {k: i for i, k in enumerate(FIELD_KINDS)}
    for lo, hi, data, offsets in textops.chunks(column):
        words = textops.Words(data, offsets)
        raw = data.tobytes()
        which, cuts = _sequences(words, data)
        extra: dict[int, list[tuple[str, int, int]]] = {}
        if len(which):
            tags = field.decode(field.scores(field.ids(words, which), cuts), cuts)
            change = np.ones(len(tags), bool)
            change[1:] = tags[1:] != tags[:-1]
            change[cuts[:-1]] = True
            runs = np.flatnonzero(change)
            row_of = words.row_of()
            for a, b in zip(runs, np.append(runs[1:], len(tags))):
                if tags[a]:
                    s, e = int(words.starts[which[a]]), int(words.ends[which[b - 1]])
                    core = np.flatnonzero(_IS_CORE[data[s:e]])
                    if not len(core):
                        continue
                    s, e = s + int(core[0]), s + int(core[-1]) + 1
                    if data[e - 1] in b"+([":
                        continue
                    if e < words.ends[which[b - 1]] and data[e] in b")]":
                        e += 1
                    kind = TAGS[tags[a]]
                    if _plausible(kind, raw[s:e].decode("utf-8", "replace")):
                        extra.setdefault(int(row_of[which[a]]), []).append((kind, s, e))
        special = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_IS_DIGIT[data] | (data == 64), out=special[1:])
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        for r in range(hi - lo):
            a, b = int(offsets[r]), int(offsets[r + 1])
            base = base_spans(raw[a:b].decode()) if special[b] > special[a] else []
            spans = list(base)
            for kind, s, e in extra.get(r, ()):
                s, e = int(lead[s] - lead[a]), int(lead[e] - lead[a])
                if all(e <= x or y <= s for _, x, y in base):
                    spans.append((kind, s, e))
            yield base, sorted(spans, key=lambda x: (order[x[0]], x[1], x[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans and n_spans of every row of docs (doc_id, text).

    Base spans come from the fixed patterns and always stay. The field adds spans that no pattern
    finds (written-out addresses, numbers with other marks, secrets) if they overlap no base span
    and hold what their kind needs; n_spans counts all. A null text is empty; a null id stays null;
    rows that repeat are read each. Texts of any length are read whole. Other columns are not read.
    """
    field = field or default_field()
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts, sums, spans, numbers = [], [], [], []
            for base, every in find(batch.column(1), shared.value):
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                sums.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
                numbers.append(len(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in zip(*counts)], pa.array(sums), pa.array(spans), pa.array(numbers, pa.int64())], schema.names)

    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
