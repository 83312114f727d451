"""Secret scan: fixed rules, and a character convolutional network over every candidate.

Rules find assignments, access keys and long hexadecimal runs; their spans always stay. Candidates
are runs of key characters with digits or mixed case inside, and long runs of one case. The network sees a candidate and the
text around it, character by character, and adds spans that look like the rules' findings.

It is trained on labelled findings: candidates that a rule covers against all others, every distinct
one of the texts, every covered one also with its surroundings blanked, so that a value alone can be
enough, and generated ones: keys of many makes that no rule knows, and long names, paths and numbers
that are none. Findings are dealt into parts by a hash; in each of a few rounds all parts learn on
from the same weights, chunk by chunk, and their weights are averaged. Some three tenths of the
findings are kept back: all their scores calibrate probabilities (a logistic fit of the raw score),
and the threshold is the highest that still finds ``RECALL`` of their secrets, however low that is.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromloom.llm.common import bound_batches, stored, with_columns
from chromloom.llm.words import byte_pieces

# Fixed values of the rules.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of at least 24 is where [0-9a-f]+ matches too
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "learned")

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
LEAST_CANDIDATE, LEAST_RULE = 12, 20

#: Share of the secrets kept back that the threshold finds.
RECALL = 0.98
#: Generated findings, of both labels, beside each chunk.
GENERATED = 2_000
#: Findings of a chunk, parts that learn side by side at most, and rounds, each over all findings.
CHUNK, PARTS, ROUNDS = 4_096, 32, 6
#: Raw scores come in steps, within bounds: a count for each step holds all of them.
STEPS, BOUND = 4_096, 64
#: Characters of a candidate seen at once, and of its surroundings on each side.
BODY, SIDE = 64, 24
WIDTH = BODY + 2 * SIDE
_DIM, _SPAN, _FILTERS, _HIDDEN = 16, 5, 48, 32
_OTHER = 96  # id of characters outside printable ASCII; 0 is padding


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the rules' findings, in code points, by start and kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters that hold a digit, or both cases after their first letter, or are
    longer than words are."""
    out = []
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        if len(s) >= LEAST_RULE or any(c.isdigit() for c in s) or (s[1:].lower() != s[1:] and s.upper() != s):
            out.append(m.span())
    return out


_DIGIT, _UPPER, _LOWER = (np.isin(np.arange(256), list(r)) for r in (range(48, 58), range(65, 91), range(97, 123)))
_KEY = _DIGIT | _UPPER | _LOWER | np.isin(np.arange(256), list(b"+/_.=-"))


def worth_reading(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts of a piece may hold a candidate, an access key or a hexadecimal run."""
    n = len(offsets) - 1
    flags = np.zeros(n, bool)
    if not len(data):
        return flags
    key = _KEY[data]
    edge = np.diff(np.concatenate(([False], key, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= LEAST_CANDIDATE
    start, end = start[long], end[long]
    if not len(start):
        return flags
    digits, upper, lower = (np.concatenate(([0], np.cumsum(m[data], dtype=np.int32))) for m in (_DIGIT, _UPPER, _LOWER))
    holds = (digits[end] > digits[start]) | ((upper[end] > upper[start + 1]) & (lower[end] > lower[start])) | (end - start >= LEAST_RULE)
    # a run may cross into the next text: every text it touches is read
    first = np.searchsorted(offsets, start[holds], "right") - 1
    last = np.searchsorted(offsets, end[holds] - 1, "right") - 1
    for a, b in zip(first, last):
        flags[a:b + 1] = True
    return flags


def _ids(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where((codes >= 32) & (codes < 127), codes - 31, _OTHER).astype(np.uint8)


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Character ids of a candidate and its surroundings; a long one gives several windows."""
    out = []
    for at in range(start, max(start + 1, end - SIDE), BODY - 16):
        stop = min(end, at + BODY)
        left, body, right = _ids(text[max(0, at - SIDE):at]), _ids(text[at:stop]), _ids(text[stop:stop + SIDE])
        row = np.zeros(WIDTH, np.uint8)
        row[SIDE - len(left):SIDE] = left
        row[SIDE:SIDE + len(body)] = body
        row[SIDE + BODY:SIDE + BODY + len(right)] = right
        out.append(row)
    return out


class Net(NamedTuple):
    """Weights, and what turns a raw score into a probability and a decision."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5
    taught: int = 0
    kept_back: int = 0


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    scaled = lambda *shape: rng.normal(0, np.sqrt(2 / shape[0]), shape)
    return {
        "embed": rng.normal(0, 0.3, (_OTHER + 1, _DIM)), "conv": scaled(_SPAN * _DIM, _FILTERS), "conv_b": np.zeros(_FILTERS),
        "deep": scaled(3 * _FILTERS, _HIDDEN), "deep_b": np.zeros(_HIDDEN), "top": scaled(_HIDDEN, 1), "top_b": np.zeros(1),
    }


_PART = np.zeros(WIDTH - _SPAN + 1, np.int8)
_PART[SIDE:SIDE + BODY - _SPAN + 1] = 1
_BODY_AT = np.flatnonzero(_PART == 1)
_SIDE_AT = np.flatnonzero(_PART == 0)


def _forward(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Raw scores of windows and what the backward pass needs."""
    e = w["embed"][x] * (x != 0)[:, :, None]
    cols = np.lib.stride_tricks.sliding_window_view(e, _SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - _SPAN + 1, -1)
    c = np.maximum(cols @ w["conv"] + w["conv_b"], 0)
    body, side = c[:, _BODY_AT], c[:, _SIDE_AT]
    at_body, at_side = body.argmax(1), side.argmax(1)
    pooled = np.concatenate([np.take_along_axis(body, at_body[:, None], 1)[:, 0], np.take_along_axis(side, at_side[:, None], 1)[:, 0], body.mean(1)], 1)
    h = np.maximum(pooled @ w["deep"] + w["deep_b"], 0)
    return (h @ w["top"] + w["top_b"])[:, 0], (cols, c, at_body, at_side, pooled, h)


def raw_scores(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    z = np.concatenate([_forward(w, x[k:k + 256])[0] for k in range(0, len(x), 256)]) if len(x) else np.zeros(0)
    return np.clip(np.floor(z * STEPS) / STEPS, -BOUND, BOUND)


def _backward(w: dict[str, np.ndarray], x: np.ndarray, d: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
    cols, c, at_body, at_side, pooled, h = kept
    g = {"top": h.T @ d[:, None], "top_b": d.sum(keepdims=True)}
    dh = d[:, None] @ w["top"].T * (h > 0)
    g["deep"], g["deep_b"] = pooled.T @ dh, dh.sum(0)
    dp = dh @ w["deep"].T
    dc = np.zeros_like(c)
    dc[:, _BODY_AT] = dp[:, None, 2 * _FILTERS:] / len(_BODY_AT)
    row, f = np.arange(len(x))[:, None], np.arange(_FILTERS)[None, :]
    dc[row, _BODY_AT[at_body], f] += dp[:, :_FILTERS]
    dc[row, _SIDE_AT[at_side], f] += dp[:, _FILTERS:2 * _FILTERS]
    dc *= c > 0
    flat = dc.reshape(-1, _FILTERS)
    g["conv"], g["conv_b"] = cols.reshape(-1, _SPAN * _DIM).T @ flat, flat.sum(0)
    de = (flat @ w["conv"].T).reshape(len(x), -1, _SPAN, _DIM)
    dx = np.zeros((len(x), WIDTH, _DIM))
    for k in range(_SPAN):
        dx[:, k:k + de.shape[1]] += de[:, :, k]
    g["embed"] = np.zeros_like(w["embed"])
    seen = x.ravel() != 0
    np.add.at(g["embed"], x.ravel()[seen], dx.reshape(-1, _DIM)[seen])
    return g


class Course(NamedTuple):
    """Where learning stands: weights, Adam's running means, steps taken."""

    weights: dict[str, np.ndarray]
    mean: dict[str, np.ndarray]
    square: dict[str, np.ndarray]
    step: int = 0


def learn(course: Course, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, batch: int = 64, rate: float = 2e-3) -> Course:
    """The course after one pass of Adam steps on log loss, both labels weighing the same."""
    w, mean, square = ({k: v.copy() for k, v in part.items()} for part in course[:3])
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    step, order = course.step, rng.permutation(len(x))
    for k in range(0, len(x), batch):
        rows = order[k:k + batch]
        z, kept = _forward(w, x[rows])
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
        step += 1
        for name, g in _backward(w, x[rows], d, kept).items():
            mean[name] += 0.1 * (g - mean[name])
            square[name] += 0.001 * (g * g - square[name])
            w[name] = w[name] - rate * (mean[name] / (1 - 0.9 ** step)) / (np.sqrt(square[name] / (1 - 0.999 ** step)) + 1e-8)
    return Course(w, mean, square, step)


def calibrate(z: np.ndarray, y: np.ndarray, recall: float = RECALL, n: np.ndarray | None = None) -> tuple[float, float, float]:
    """``(slope, offset, threshold)``: a logistic fit of raw scores by Newton steps, and the highest
    threshold that still finds ``recall`` of the secrets. ``n`` tells how often each row counts."""
    a, b = 1.0, 0.0
    n = np.ones(len(z)) if n is None else n
    goal = np.where(y > 0, ((n * y).sum() + 1) / ((n * y).sum() + 2), 1 / ((n * (1 - y)).sum() + 2))  # never quite 0 or 1
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        v, d = n * np.maximum(p * (1 - p), 1e-6), n * (p - goal)
        grad = np.array([(d * z).sum() + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-9]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - move[0], b - move[1]
    p = 1 / (1 + np.exp(-np.clip(a * z[y > 0] + b, -30, 30)))
    order = np.argsort(p, kind="stable")
    upto = np.cumsum(n[y > 0][order])
    return float(a), float(b), float(p[order[int(np.searchsorted(upto, (1 - recall) * upto[-1], "right"))]])


def _probability(net: Net, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.slope * raw_scores(net.weights, x) + net.offset, -30, 30)))


def _texts(texts: pa.Array) -> Iterator[tuple[int, str, bool]]:
    """``(row, text, may hold candidates)`` of texts that need a look."""
    for first, data, offsets in byte_pieces(texts):
        flags = worth_reading(data, offsets)
        raw = data.tobytes()
        low = raw.lower()
        named = any(w.encode() in low for w in _WORDS)
        for k in range(len(flags)):
            a, b = offsets[k], offsets[k + 1]
            if flags[k] or named and any(low.find(w.encode(), a, b) >= 0 for w in _WORDS):
                yield first + k, raw[a:b].decode("utf-8", "replace"), bool(flags[k])


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, rows = [], []
        for _, text, holds in _texts(batch.column(0)):
            if not holds:
                continue
            covered = base_spans(text)
            for a, b in candidates(text):
                label = int(any(s < b and a < e for s, _, e in covered))
                for row in windows(text, a, b):
                    rows.append(row.tobytes())
                    labels.append(label)
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(rows, pa.binary())], ["label", "window"])


def generated(n: int = GENERATED, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """``(windows, labels)`` of invented candidates amid invented words."""
    rng = np.random.default_rng(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda *x: x[rng.integers(len(x))]
    drawn = lambda letters, k: "".join(letters[i] for i in rng.integers(0, len(letters), k))

    def word() -> str:
        return "".join(pick("an", "er", "the", "on", "st", "ing", "re", "ou", "le", "de", "ti", "ha", "sch", "ver", "ment") for _ in range(rng.integers(1, 5)))

    def key() -> str:
        mixed = lower + lower.upper() + digits
        k = int(rng.integers(16, 48))
        return pick(
            drawn(mixed, k), drawn(mixed + "+/", k) + pick("", "=", "=="), drawn(lower.upper() + digits, k), drawn("0123456789ABCDEF", max(k, 24)),
            f"{pick('sk', 'pk', 'rk')}_{pick('live', 'test')}_{drawn(mixed, 24)}", f"{pick('ghp', 'gho', 'xoxb', 'glpat')}{pick('_', '-')}{drawn(mixed, 30)}",
            f"ey{drawn(mixed, 18)}.ey{drawn(mixed, 30)}.{drawn(mixed + '-_', 30)}", "-".join(drawn("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
            drawn(lower, k + 8), drawn(lower.upper(), k + 4))

    def other() -> str:
        return pick(
            "_".join(word() for _ in range(rng.integers(3, 6))), "".join(word().capitalize() for _ in range(rng.integers(3, 5))), "/".join(word() for _ in range(rng.integers(3, 7))),
            f"{word()}/{word()}-{rng.integers(1, 99)}.{pick('html', 'py', 'tar.gz')}", f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{drawn(digits, 6)}",
            drawn(digits, int(rng.integers(12, 24))), "-".join(word() for _ in range(rng.integers(3, 6))), word() + word() + word() + word() + word(),
            f"v{rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 99)}-{word()}.{rng.integers(1, 9)}", pick("=", "-", "_", ".") * int(rng.integers(12, 40)),
            f"www.{word()}{word()}.{pick('com', 'org')}/{word()}", (word() + word() + word() + word()).upper())

    rows, labels = [], []
    while len(rows) < n:
        label = int(rng.integers(0, 2))
        left = " ".join(word() for _ in range(rng.integers(0, 5))) + pick(" ", " ", ": ", ' "', "=", "\n", " (")
        value = key() if label else other()
        text = left + value + pick(" ", ".", '" ', ") ", "\n", ", ") + word()
        for a, b in candidates(text):
            if a < len(left) + len(value) and b > len(left):
                for row in windows(text, a, b):
                    rows.append(row)
                    labels.append(float(label))
    return np.stack(rows[:n]), np.array(labels[:n])


def _rows(windows: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(windows.to_pylist()), np.uint8).reshape(-1, WIDTH)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(part, windows, labels)`` of rows sorted by part; ``size`` rows, at the end of a part up to
    half as many more."""
    part, held = None, []

    def cut(last: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        while held and (last or sum(len(y) for _, y in held) >= size + size // 2):
            x, y = (np.concatenate(c) for c in zip(*held))
            at = len(y) if len(y) < size + size // 2 else size
            held[:] = [(x[at:], y[at:])] if at < len(y) else []
            yield part, x[:at], y[:at]

    for batch in batches:
        parts = batch.column(0).to_numpy()
        x, y = _rows(batch.column(2)), batch.column(1).to_numpy().astype(float)
        for p in np.unique(parts):
            if p != part:
                yield from cut(True)
                part = int(p)
            held.append((x[parts == p], y[parts == p]))
            yield from cut(False)
    yield from cut(True)


def _teach(course: Course, turn: int, more_x: np.ndarray, more_y: np.ndarray, chunk: int):
    """mapInArrow function: findings in, the course of each part out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, list] = {}
        for part, x, y in _chunks(batches, chunk):
            n, k, at = done.get(part, (0, 0, course))
            bare = x[y > 0].copy()
            bare[:, :SIDE] = bare[:, SIDE + BODY:] = 0
            # what rules leave uncovered need not be harmless: generated keys teach against that
            at = learn(at, np.concatenate([x, bare, more_x]), np.concatenate([y, np.ones(len(bare)), more_y]), np.random.default_rng([7, turn, part, k]))
            done[part] = [n + len(y), k + 1, at]
        for part, (n, _, at) in done.items():
            yield pa.RecordBatch.from_pylist([{"part": part, "n": n, "course": pickle.dumps(tuple(at))}], _COURSE)

    return run


_COURSE = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("course", pa.binary())])


def _averaged(found: list[dict]) -> Course:
    """One course from those of all parts, weighing as many findings as each has seen."""
    found = sorted(found, key=lambda r: r["part"])
    total, courses = sum(r["n"] for r in found), [Course(*pickle.loads(r["course"])) for r in found]
    share = [r["n"] / total for r in found]
    mixed = [{k: sum(f * c[at][k] for f, c in zip(share, courses)) for k in courses[0][at]} for at in range(3)]
    return Course(*mixed, max(c.step for c in courses))


def train(docs: DataFrame, text: str = "text", n_generated: int = GENERATED, chunk: int = CHUNK, most_parts: int = PARTS) -> Net | None:
    """A network trained and calibrated on all distinct labelled findings; None if the texts don't
    hold ten of each label.

    A task holds a chunk of findings at a time; the driver sees the weights of at most
    ``most_parts`` parts a round, and counts of the scores of those kept back.
    """
    bound_batches(docs.sparkSession)
    # read the texts once
    found = docs.select(F.col(text).alias("text")).mapInArrow(_findings, "label int, window binary").distinct()
    every = stored(found.withColumn("hash", F.xxhash64("window")), "op8-findings")
    kept_back = F.pmod("hash", F.lit(10)) < 3
    sizes = {r["label"]: (r["n"], r["kept"]) for r in every.groupBy("label").agg(F.count("*").alias("n"), F.count_if(kept_back).alias("kept")).collect()}
    if min(sizes.get(label, (0, 0))[0] for label in (0, 1)) < 10:
        return None
    kept = sum(k for _, k in sizes.values())
    taught = sum(n for n, _ in sizes.values()) - kept
    parts = min(max(1, round(taught / chunk)), most_parts)
    part = F.pmod(F.shiftright("hash", 8), F.lit(parts)).cast("int").alias("part")
    dealt = every.filter(~kept_back).select(part, "label", "window", "hash").repartitionById(parts, F.col("part")).sortWithinPartitions(
        "part", "hash", "window", "label").select("part", "label", "window")

    more_x, more_y = generated(n_generated)
    back = np.arange(len(more_x)) % 10 < 3
    start = _start(np.random.default_rng(7))
    course = Course(start, *({k: np.zeros_like(v) for k, v in start.items()} for _ in range(2)))
    for turn in range(ROUNDS):
        taught_parts = dealt.mapInArrow(_teach(course, turn, more_x[~back], more_y[~back], chunk), "part int, n long, course binary")
        course = _averaged(taught_parts.toArrow().to_pylist())
    weights = course.weights

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw_scores(weights, _rows(batch.column(1))))], ["label", "z"])

    steps = every.filter(kept_back).select("label", "window").mapInArrow(scored, "label int, z double").groupBy("label", "z").agg(
        F.count("*").alias("n")).orderBy("label", "z").toArrow().to_pydict()
    # generated findings count in the threshold: a fourth of all, or more where the texts hold few
    z, y = np.concatenate([steps["z"], raw_scores(weights, more_x[back])]), np.concatenate([steps["label"], more_y[back]]).astype(float)
    n = np.concatenate([steps["n"], np.full(int(back.sum()), max(1.0, kept / (3 * max(1, back.sum()))))])
    return Net(weights, *calibrate(z, y, n=n), taught, kept)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_NOTHING = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
RESULT = "struct<n_assign:long,n_access:long,n_hex:long,base_sha256:string,spans:string>"


def scan_texts(texts: pa.Array, net: Net | None) -> list[tuple]:
    """``(n_assign, n_access, n_hex, base_sha256, spans)`` of each text."""
    out = [_NOTHING] * len(texts)
    bases: dict[int, list] = {}
    asked: list[tuple[int, int, int]] = []
    rows: list[np.ndarray] = []
    of: list[int] = []
    for k, text, holds in _texts(texts):
        base = bases[k] = base_spans(text)
        if holds and net is not None:
            for a, b in candidates(text):
                if not any(s <= a and b <= e for s, _, e in base):
                    mine = windows(text, a, b)
                    of += [len(asked)] * len(mine)
                    rows += mine
                    asked.append((k, a, b))
    learned: dict[int, list] = {}
    if rows:
        best = np.zeros(len(asked))
        np.maximum.at(best, of, _probability(net, np.stack(rows)))
        for (k, a, b), p in zip(asked, best):
            if p >= net.threshold:
                learned.setdefault(k, []).append((a, 3, b))
    for k, base in bases.items():
        count = [sum(kind == c for _, kind, _ in base) for c in range(3)]
        out[k] = (*count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + learned.get(k, []))))
    return out


def scan(docs: DataFrame, text: str = "text", net: Net | None = None, fit: bool = True) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256 and spans to every row.

    Without ``net`` one is trained on the texts themselves unless ``fit`` is false; without enough
    findings only the rules speak. Null and empty texts hold nothing. Repeated rows get equal
    results. Whole texts are read; a candidate longer than a window is seen in several. An empty
    table gives no rows. Input columns with one of the added names give way.
    """
    bound_batches(docs.sparkSession)
    if net is None and fit:
        net = train(docs, text)

    @F.arrow_udf(RESULT)
    def found(texts: pa.Array) -> pa.Array:
        rows = scan_texts(texts, net)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
        return pa.StructArray.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names)

    made = docs.withColumn("__found", found(F.col(text)))
    parts = {c: F.col(f"__found.{c}") for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
    return with_columns(made, parts).drop("__found")
