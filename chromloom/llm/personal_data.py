"""Personal data: fixed rules, and a semi-Markov conditional random field over whole spans.

Rules find e-mail addresses, IP addresses, payment cards and telephone numbers; their spans always
stay. A rule takes the longest run of its characters and gives up when that fails, so a number that
touches another is lost. The field looks at every stretch of text that could hold such data, cut
into atoms (runs of digits, runs of letters, single other characters), and scores whole candidate
spans: digits, groups, check sum, separators, what touches the span. Dynamic programming over spans
of at most ``MOST_ATOMS`` atoms chooses borders and types together; its spans are added.

Atoms outside such stretches can only be plain text, so leaving them out changes no segmentation.
The field is trained on a bounded sample of stretches from the corpus (``SAMPLE`` of each type and
of none, labelled by the rules) and on generated ones, which hold neighbouring and oddly written
data that the rules miss, and numbers that are nobody's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromloom.llm.common import bound_batches, stored, with_columns
from chromloom.llm.words import byte_pieces

KINDS = ("email", "ip", "card", "phone")
#: The types of the field: plain text, then the kinds.
PLAIN, EMAIL, IP, CARD, PHONE = range(5)
TYPES = 5

# Fixed values of the rules.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # no match starts inside a run of digits: its first digit would do as well
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Stretches of each type that the field learns from, at most, and generated ones.
SAMPLE, GENERATED = 300, 900
#: Longest candidate span, in atoms and in characters.
MOST_ATOMS, MOST_CHARS = 40, 254
#: Digits below which no stretch of numbers can be an entity.
LEAST_DIGITS = 4


# --- rules -----------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octets(s: str) -> bool:
    return all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the rules, ordered, in time linear in the text."""
    out = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        # the local part reaches back over its characters to the last match or another character
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            done = at = found.end()
        else:
            at += 1
            done = at
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# --- stretches, atoms and candidate spans ----------------------------------------------------

_NUMBER = np.isin(np.arange(128), list(b"0123456789 +().-"))
_ADDRESS = np.isin(np.arange(128), list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._%+@-"))
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([False], flag, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts that may hold an entity: runs of number characters with enough digits and runs of
    address characters with an ``@``; those that touch are one."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(codes < 128, codes, 0).astype(np.uint8)
    parts = []
    for table, wanted, least in ((_NUMBER, (codes >= 48) & (codes < 58), LEAST_DIGITS), (_ADDRESS, codes == 64, 1)):
        start, end = _runs(table[codes])
        seen = np.concatenate(([0], np.cumsum(wanted)))
        good = seen[end] - seen[start] >= least
        parts += zip(start[good].tolist(), end[good].tolist())
    out: list[list[int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: Names of the features of a span; their places in the vector.
FEATURES = (
    "one", "digits<7", "digits 7-9", "digits 10", "digits 11-12", "digits 13", "digits 14-15", "digits 16", "digits 17-19", "digits>19",
    "check sum right", "check sum wrong", "plus first", "plus inside", "brackets match", "brackets don't match", "octets", "dots but no octets",
    "digits only", "groups of four", "last groups 3-4 or 4", "separators meet", "blank", "hyphen", "more than six groups", "letter or digit before",
    "letter or digit after", "joined to digits before", "joined to digits after", "plus or bracket before", "one at sign", "address form",
    "last label of letters", "dot at an edge", "address goes on before", "address goes on after", "single digits",
)
_AT = {name: k for k, name in enumerate(FEATURES)}
DIM = len(FEATURES)
_COUNTS = ((7, "digits<7"), (10, "digits 7-9"), (11, "digits 10"), (13, "digits 11-12"), (14, "digits 13"), (16, "digits 14-15"), (17, "digits 16"), (20, "digits 17-19"))
_ADDRESS_FORM = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MEETING = re.compile(r"[ .()+-]{2,}")
_FINE_MEETING = {") ", " (", "+(", ")-"}


def span_features(text: str, a: int, b: int) -> list[int]:
    """Places of the features that a candidate span has, all of them of the span as a whole."""
    s = text[a:b]
    before, after = text[a - 1:a], text[b:b + 1]
    groups = [g for g in _NOT_DIGIT.split(s) if g]
    digits = "".join(groups)
    n = len(digits)
    on = ["one", next((name for most, name in _COUNTS if n < most), "digits>19")]
    if 14 <= n <= 19:
        on.append("check sum right" if luhn(digits) else "check sum wrong")
    if "+" in s:
        on.append("plus first" if s.rfind("+") == 0 else "plus inside")
    if "(" in s or ")" in s:
        on.append("brackets match" if s.count("(") == s.count(")") == 1 and s.find("(") < s.find(")") else "brackets don't match")
    if "." in s and "@" not in s:
        on.append("octets" if s.count(".") == 3 and len(groups) == 4 and len(s) == n + 3 and _octets(s) else "dots but no octets")
    if len(s) == n:
        on.append("digits only")
    elif len(groups) > 2 and all(len(g) == 4 for g in groups):
        on.append("groups of four")
    if len(groups) > 1 and len(groups[-1]) == 4:
        on.append("last groups 3-4 or 4")
    if any(m not in _FINE_MEETING for m in _MEETING.findall(s)):
        on.append("separators meet")
    on += [name for c, name in ((" ", "blank"), ("-", "hyphen")) if c in s]
    if len(groups) > 6:
        on.append("more than six groups")
    if len(groups) > 6 and len(groups) == n:
        on.append("single digits")
    if before.isalnum():
        on.append("letter or digit before")
    elif before in (".", "-", "/", ":") and text[max(0, a - 2):a - 1].isdigit():
        on.append("joined to digits before")
    elif before in ("+", "("):
        on.append("plus or bracket before")
    if after.isalnum():
        on.append("letter or digit after")
    elif after in (".", "-", "/", ":") and text[b + 1:b + 2].isdigit():
        on.append("joined to digits after")
    if "@" in s:
        on.append("one at sign")
        if _ADDRESS_FORM.fullmatch(s):
            on.append("address form")
        if len(label := s[s.rfind(".") + 1:]) > 1 and label.isalpha():
            on.append("last label of letters")
        if s[0] == "." or s[-1] in ".-":
            on.append("dot at an edge")
        if before and before.isascii() and (before.isalnum() or before in "._%+-@"):
            on.append("address goes on before")
        if after and after.isascii() and (after.isalnum() or after in "_@" or after in ".-" and text[b + 1:b + 2].isalnum()):
            on.append("address goes on after")
    return [_AT[x] for x in on]


def _plain_features(atom: str) -> list[int]:
    on = ["one"]
    if atom.isdigit() and atom.isascii():
        on.append(next((name for most, name in _COUNTS if len(atom) < most), "digits>19"))
    elif atom == "@":
        on.append("one at sign")
    elif atom == "+":
        on.append("plus first")
    return [_AT[x] for x in on]


class Part(NamedTuple):
    """A stretch: borders of its atoms in the text, and its candidate segments."""

    borders: list[int]
    segments: list[tuple[int, int, int, list[int]]]  # first atom, atom after the last, type, features


def part_of(text: str, a: int, b: int) -> Part | None:
    """Atoms and candidates of a stretch; None if nothing in it can be an entity."""
    borders = [a + m.start() for m in _ATOM.finditer(text[a:b])] + [b]
    m = len(borders) - 1
    atoms = [text[x:y] for x, y in zip(borders, borders[1:])]
    found = []
    for i in range(m):
        if not (atoms[i].isdigit() or atoms[i] in "+("):
            continue
        digits = dots = other = 0
        for j in range(i, min(m, i + MOST_ATOMS)):
            s = atoms[j]
            if s.isdigit():
                digits += len(s)
                if digits > 19:
                    break
                types = []
                if dots == 3 and not other and digits >= LEAST_DIGITS and atoms[i].isdigit():
                    types.append(IP)
                if 12 <= digits and not dots and "(" not in (span := text[borders[i]:borders[j + 1]]) and ")" not in span and "+" not in span:
                    types.append(CARD)
                if 7 <= digits <= 15:
                    types.append(PHONE)
                if types:
                    on = span_features(text, borders[i], borders[j + 1])
                    found += [(i, j + 1, t, on) for t in types]
            elif s == ".":
                dots += 1
            elif s in " ()-" or s == "+" and j == i:
                other += 1
            else:
                break
    for at in (k for k, s in enumerate(atoms) if s == "@"):
        first = at
        while first > 0 and at - first < MOST_ATOMS and _ADDRESS[min(ord(atoms[first - 1][0]), 0x7F)] and atoms[first - 1] not in "@\x7f":
            first -= 1
        last = at + 1
        while last < m and last - at < MOST_ATOMS and (atoms[last].isalnum() and atoms[last].isascii() or atoms[last] in ".-"):
            last += 1
        for i in range(first, at):
            for j in range(at + 4, min(last, i + MOST_ATOMS) + 1):  # a label, a dot and a label at least
                if atoms[j - 1] != "." and borders[j] - borders[i] <= MOST_CHARS and "." in atoms[at + 2:j - 1]:
                    found.append((i, j, EMAIL, span_features(text, borders[i], borders[j])))
    if not found:
        return None
    return Part(borders, found + [(k, k + 1, PLAIN, _plain_features(s)) for k, s in enumerate(atoms)])


# --- the field -------------------------------------------------------------------------------


class Field(NamedTuple):
    """Weights of span features by type, and of a type following another."""

    weights: np.ndarray
    moves: np.ndarray


class Lattice:
    """Segments of many stretches as arrays, so that one step of a sweep serves all of them."""

    def __init__(self, parts: list[Part]):
        rows = [(k, *s) for k, p in enumerate(parts) for s in p.segments]
        self.n, self.lengths = len(parts), np.array([len(p.borders) - 1 for p in parts])
        self.of, self.start, self.end, self.kind = (np.array([r[c] for r in rows], np.int64) for c in range(4))
        self.on = np.concatenate([np.array(r[4], np.int64) for r in rows])
        self.owner = np.repeat(np.arange(len(rows)), [len(r[4]) for r in rows])
        most = int(self.lengths.max())
        self.by_end, self.by_start = np.argsort(self.end, kind="stable"), np.argsort(self.start, kind="stable")
        self.end_cut = np.searchsorted(self.end[self.by_end], np.arange(most + 2))
        self.start_cut = np.searchsorted(self.start[self.by_start], np.arange(most + 2))
        self.most = most

    def scores(self, field: Field) -> np.ndarray:
        return np.bincount(self.owner, field.weights[self.kind[self.owner], self.on], len(self.of))


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


#: Stands for the logarithm of nothing.
_NONE = -1e9


def marginals(lat: Lattice, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(logarithm of each stretch's total, probability of each segment, expected moves)``."""
    score = lat.scores(field)
    ahead = np.full((lat.n, lat.most + 1, TYPES), _NONE)
    ahead[:, 0, PLAIN] = 0
    came = np.empty((len(score), TYPES))
    for j in range(1, lat.most + 1):
        at = lat.by_end[lat.end_cut[j]:lat.end_cut[j + 1]]
        came[at] = ahead[lat.of[at], lat.start[at]] + field.moves[:, lat.kind[at]].T + score[at, None]
        np.logaddexp.at(ahead, (lat.of[at], j, lat.kind[at]), _log_sum(came[at]))
    total = _log_sum(ahead[np.arange(lat.n), lat.lengths])
    back = np.full((lat.n, lat.most + 1, TYPES), _NONE)
    back[np.arange(lat.n), lat.lengths] = 0
    for i in range(lat.most - 1, -1, -1):
        at = lat.by_start[lat.start_cut[i]:lat.start_cut[i + 1]]
        went = field.moves[:, lat.kind[at]].T + (score[at] + back[lat.of[at], lat.end[at], lat.kind[at]])[:, None]
        np.logaddexp.at(back, (lat.of[at][:, None], i, np.arange(TYPES)[None, :]), went)
    each = np.exp(np.minimum(came + (back[lat.of, lat.end, lat.kind] - total[lat.of])[:, None], 0))
    moves = np.zeros((TYPES, TYPES))
    np.add.at(moves.T, lat.kind, each)
    return total, each.sum(axis=1), moves


def best_segments(lat: Lattice, field: Field) -> list[list[tuple[int, int, int]]]:
    """Entities ``(first atom, atom after the last, type)`` of each stretch's best segmentation."""
    score = lat.scores(field)
    best = np.full((lat.n, lat.most + 1, TYPES), _NONE)
    best[:, 0, PLAIN] = 0
    by = np.full((lat.n, lat.most + 1, TYPES), -1, np.int64)
    before = np.empty(len(score), np.int64)
    for j in range(1, lat.most + 1):
        at = lat.by_end[lat.end_cut[j]:lat.end_cut[j + 1]]
        came = best[lat.of[at], lat.start[at]] + field.moves[:, lat.kind[at]].T
        before[at] = came.argmax(axis=1)
        value = came.max(axis=1) + score[at]
        order = np.lexsort((at, -value, lat.kind[at], lat.of[at]))
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(lat.of[at][order]) != 0) | (np.diff(lat.kind[at][order]) != 0)
        win = order[first]
        best[lat.of[at[win]], j, lat.kind[at[win]]] = value[win]
        by[lat.of[at[win]], j, lat.kind[at[win]]] = at[win]
    out = []
    for k in range(lat.n):
        j, t, found = int(lat.lengths[k]), int(best[k, lat.lengths[k]].argmax()), []
        while j > 0:
            s = by[k, j, t]
            if t != PLAIN:
                found.append((int(lat.start[s]), j, t))
            j, t = int(lat.start[s]), int(before[s])
        out.append(found[::-1])
    return out


def learn(parts: list[Part], gold: list[set[tuple[int, int, int]]], steps: int = 160, rate: float = 0.15, decay: float = 2e-3) -> Field:
    """Adam steps on the conditional likelihood of whole segmentations, with a quadratic penalty."""
    lat = Lattice(parts)
    right = np.zeros(len(lat.of), bool)
    right_moves = np.zeros((TYPES, TYPES))
    place = {(k, a, b, t): n for n, (k, a, b, t) in enumerate(zip(lat.of.tolist(), lat.start.tolist(), lat.end.tolist(), lat.kind.tolist()))}
    for k, (part, spans) in enumerate(zip(parts, gold)):
        covered = {i for a, b, _ in spans for i in range(a, b)}
        path = sorted([*spans, *((i, i + 1, PLAIN) for i in range(len(part.borders) - 1) if i not in covered)])
        for (_, _, p), (a, b, t) in zip([(0, 0, PLAIN), *path], path):
            right[place[k, a, b, t]] = True
            right_moves[p, t] += 1
    field = Field(np.zeros((TYPES, DIM)), np.zeros((TYPES, TYPES)))
    mean, square = ([np.zeros_like(x) for x in field] for _ in range(2))
    for step in range(1, steps + 1):
        _, chance, moves = marginals(lat, field)
        off = np.zeros((TYPES, DIM))
        np.add.at(off, (lat.kind[lat.owner], lat.on), (chance - right)[lat.owner])
        new = []
        for k, (x, g) in enumerate(zip(field, (off / lat.n + decay * field.weights, (moves - right_moves) / lat.n + decay * field.moves))):
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            new.append(x - rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8))
        field = Field(*new)
    return field


# --- what it learns from ---------------------------------------------------------------------


def _check_digit(body: str) -> str:
    return next(d for d in "0123456789" if luhn(body + d))


def generated(n: int = GENERATED, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Invented texts with their entities ``(start, end, type)``: alone, side by side, in many
    spellings, among numbers that are nobody's."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick(*"abcdefghiklmnoprstuvz") for _ in range(rng.integers(2, 9)))

    def card() -> str:
        body = pick("4", "5", "37", "6011") + number(20)
        body = body[:pick(13, 14, 15, 15, 15, 15, 18)]
        s = body + _check_digit(body)
        return pick(s, s, " ".join(s[k:k + 4] for k in range(0, len(s), 4)), "-".join(s[k:k + 4] for k in range(0, len(s), 4)))

    def phone() -> str:
        area, mid, end = pick(*"23456789") + number(2), number(3), number(4)
        land = pick("1", "1", "44", "49", "33", "351")
        return pick(f"+{land} ({area}) {mid}-{end}", f"+{land} {area} {mid} {end}", f"+{land}-{area}-{mid}-{end}", f"+{land}.{area}.{mid}.{end}",
                    f"+{land}{area}{mid}{end}", f"({area}) {mid}-{end}", f"+{land} ({area}) {mid}-{end}")

    def ip() -> str:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))

    def email() -> str:
        local = pick(word(), f"{word()}.{number(2)}", f"{word()}_{word()}", f"{word()}+{word()}", word() + number(rng.integers(1, 4)))
        return f"{local}@{pick('', word() + '.', word() + number(1) + '.')}{word()}.{pick('com', 'org', 'de', 'co.uk', 'net')}"

    def nobody() -> str:
        year = str(rng.integers(1900, 2100))
        bad = number(pick(14, 15, 16))
        bad = bad[:-1] + str((int(_check_digit(bad[:-1])) + rng.integers(1, 10)) % 10)
        return pick(year, f"{year}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}.{year}", f"{number(1)}.{number(2)}.{number(1)}", f"{number(3)}.{number(2)}",
                    f"{year}-{year}", number(pick(6, 7, 8, 9, 10, 11, 12, 13)), f"{number(3)} {number(3)} {number(3)}", f"{number(2)}-{number(5)}-{number(2)}-{number(1)}",
                    f"{number(3)}.{rng.integers(256, 999)}.{number(1)}.{number(2)}", bad, number(rng.integers(20, 40)), f"{number(4)} {number(4)}", f"{year} {year} {year} {year}",
                    f"({year}) {number(2)}-{number(3)}", f"@{word()}", f"{word()}@{word()}", f"{number(2)} - {number(2)} - {number(2)}", word() + number(12))

    makers = (email, ip, card, phone)
    out = []
    for _ in range(n):
        text, spans = pick("", word() + " ", word() + ". ", '"', "(", "### "), []
        for _ in range(pick(1, 1, 2, 2, 3)):
            kind = rng.integers(0, 6)
            value = makers[kind]() if kind < 4 else nobody()
            if kind < 4:
                spans.append((len(text), len(text) + len(value), int(kind) + 1))
            text += value + pick(" ", " ", " ", " ", ", ", " - ", ". ", "  ", f" {word()} ", ";\n")
        out.append((text + pick("", word(), ".", "***"), spans))
    return out


def _lesson(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[Part], list[set[tuple[int, int, int]]]]:
    """Stretches of a text with their entities in atoms; a stretch with an entity that is no
    candidate (too long, or cut by other atoms) is left out."""
    parts, gold = [], []
    for a, b in stretches(text):
        part = part_of(text, a, b)
        if part is None:
            continue
        place = {x: k for k, x in enumerate(part.borders)}
        own = {(place.get(s, -1), place.get(e, -1), t) for s, e, t in spans if s < b and a < e}
        if own <= {x[:3] for x in part.segments}:
            parts.append(part)
            gold.append(own)
    return parts, gold


#: Types of a sampled stretch: none, one of the kinds, or several.
_NO_TYPE, _SEVERAL = 0, 5


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches labelled by the rules. One in which rules overlap, or a match failed its check,
    is doubtful and teaches nothing."""
    for batch in batches:
        types, texts, spans = [], [], []
        for _, text in _texts(batch.column(0)):
            base = base_spans(text)
            for a, b in stretches(text):
                if b - a > 2 * MOST_CHARS:
                    continue
                own = [(s, e, k + 1) for s, k, e in base if s < b and a < e]
                if any(y[0] < x[1] for x, y in zip(own, own[1:])) or any(s < a or e > b for s, e, _ in own):
                    continue
                free, last = [], a
                for s, e, _ in own:
                    free.append(text[last:s])
                    last = e
                free.append(text[last:b])
                if any(len(_NOT_DIGIT.sub("", x)) > 9 or "@" in x for x in free):
                    continue
                edge = max(0, a - 1)
                types.append(own[0][2] if len(own) == 1 else _SEVERAL if own else _NO_TYPE)
                texts.append(text[edge:b + 1])
                spans.append(",".join(f"{s - edge}:{e - edge}:{t}" for s, e, t in own))
        yield pa.RecordBatch.from_arrays([pa.array(types, pa.int32()), pa.array(texts, pa.string()), pa.array(spans, pa.string())], ["type", "part", "spans"])


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE, n_generated: int = GENERATED) -> Field:
    """A field from generated texts and at most ``sample`` distinct stretches of each type."""
    bound_batches(docs.sparkSession)
    parts, gold = [], []
    lessons = generated(n_generated)
    if sample:
        every = stored(docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_samples, "type int, part string, spans string").distinct(), "op11-samples")
        for t in range(_SEVERAL + 1):
            some = every.filter(F.col("type") == t).orderBy(F.xxhash64("part"), "part", "spans").limit(sample)
            lessons += [(r.part, [tuple(map(int, x.split(":"))) for x in r.spans.split(",") if x]) for r in some.collect()]
    for lesson in lessons:
        more = _lesson(*lesson)
        parts += more[0]
        gold += more[1]
    return learn(parts, gold)


# --- the scan --------------------------------------------------------------------------------

_SIGN = np.isin(np.arange(256), list(b"0123456789@"))


def _texts(texts: pa.Array) -> Iterator[tuple[int, str]]:
    """``(row, text)`` of texts with a digit or an ``@``; no other holds anything."""
    for first, data, offsets in byte_pieces(texts):
        seen = np.concatenate(([0], np.cumsum(_SIGN[data], dtype=np.int32)))
        for k in np.flatnonzero(seen[offsets[1:]] > seen[offsets[:-1]]):
            yield first + int(k), data[offsets[k]:offsets[k + 1]].tobytes().decode("utf-8", "replace")


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


#: Segments that one sweep holds at most (one stretch at least).
_SEGMENTS = 200_000


def field_spans(parts: list[tuple[int, Part]], field: Field) -> list[tuple[int, int, int, int]]:
    """``(row, start, kind, end)`` of the best entities; stretches of like length share a sweep."""
    out, held = [], []

    def flush():
        for (row, part), found in zip(held, best_segments(Lattice([p for _, p in held]), field)):
            out.extend((row, part.borders[a], t - 1, part.borders[b]) for a, b, t in found)
        held.clear()

    size = 0
    for row, part in sorted(parts, key=lambda x: len(x[1].borders)):
        cost = len(part.segments) + TYPES * len(part.borders)
        if held and size + cost > _SEGMENTS:
            flush()
            size = 0
        held.append((row, part))
        size += cost
    if held:
        flush()
    return out


_NOTHING = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
COLUMNS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
RESULT = "struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string>"


def scan_texts(texts: pa.Array, field: Field | None) -> list[tuple]:
    """A row of ``COLUMNS`` for each text; without a field the rules alone."""
    out = [_NOTHING] * len(texts)
    bases, parts = {}, []
    for k, text in _texts(texts):
        bases[k] = base_spans(text)
        if field is not None:
            parts += [(k, p) for a, b in stretches(text) if (p := part_of(text, a, b)) is not None]
    added: dict[int, list] = {}
    for k, a, kind, b in field_spans(parts, field):
        if not any(s <= a and b <= e for s, _, e in bases[k]):
            added.setdefault(k, []).append((a, kind, b))
    for k, base in bases.items():
        count = [sum(kind == c for _, kind, _ in base) for c in range(len(KINDS))]
        out[k] = (*count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + added.get(k, []))))
    return out


def scan(docs: DataFrame, text: str = "text", field: Field | None = None, fit: bool = True) -> DataFrame:
    """Add n_email, n_ip, n_card, n_phone, base_sha256 and spans to every row.

    The counts and the hash are of the rules' spans; ``spans`` also holds those of the field that
    lie in none of the rules' spans, by start, then kind, then end. Without ``field`` one is
    trained on the texts themselves and on generated ones, unless ``fit`` is false. Null and empty
    texts hold nothing. Repeated rows get equal results, an empty table gives no rows. Whole texts
    are read, whatever their length; only a single entity is bounded for the field (``MOST_ATOMS``
    atoms). Input columns with one of the added names give way.
    """
    bound_batches(docs.sparkSession)
    if field is None and fit:
        field = train(docs, text)

    @F.arrow_udf(RESULT)
    def found(texts: pa.Array) -> pa.Array:
        rows = scan_texts(texts, field)
        kinds = (pa.int64(),) * 4 + (pa.string(),) * 2
        return pa.StructArray.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], list(COLUMNS))

    made = docs.withColumn("__found", found(F.col(f"`{text}`").cast("string")))
    return with_columns(made, {c: F.col(f"__found.{c}") for c in COLUMNS}).drop("__found")
