"""Secrets in texts: three patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens as outside, begin or inside of a secret. Its features are the shape of the
token, the words around it and the file it is in; Viterbi decoding finds the best tags. It is
fitted on windows of a bounded sample of documents, in which the patterns' values are the truth.

A text is decoded only around tokens that could matter. After fitting it is checked that a plain
word in plain surroundings is outside in every best tagging, whatever stands further away: its
margin exceeds all that transitions can gain. Such words cut the chain, so decoding the stretches
between them gives the tags of the whole text. If the check fails, whole texts are decoded.

Positions are code points, ends exclusive. Defined cases: a null text counts as empty and has no
spans; an empty table gives an empty result; without any secret in the sample the field tags
nothing; a text that holds more than one span at a place keeps all of them; rows that repeat an
id are scanned one by one; an input column named like a result is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carewise.llm.common import sliced

# kind, pattern, least length of the decisive group, that group
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

TOKEN = re.compile(r"[A-Za-z0-9_+/=.\-]+|[^\s]", re.ASCII)
KEYWORDS = ("passw", "secret", "token", "api", "key", "auth", "bearer", "credential")
KEYWORD = re.compile("|".join(KEYWORDS), re.IGNORECASE)
WHITE = " \t\n\r\x0b\x0c"
NEXT_WORD = re.compile(rf"[{WHITE}]*[^{WHITE}]*")
STANDS_OUT = re.compile(r"[0-9=:+/_\"']+")
AROUND = 6  # words on either side of what stands out

FIT_DOCUMENTS = 4_000
FIT_WINDOWS = 2_000
WINDOW_TOKENS = 32
OUTSIDE, BEGIN, INSIDE = 0, 1, 2

LENGTHS = (2, 4, 8, 12, 16)
CHANGES = (1, 2, 4, 8)
NAMES = (
    ["bias", "letters", "digits", "both", "other"]
    + [f"word_length{i}" for i in range(len(LENGTHS) + 1)]
    + [f"code_length{i}" for i in range(len(LENGTHS) + 1)]
    + [f"changes{i}" for i in range(len(CHANGES) + 1)]
    + ["hex", "keyword", "separator", "quote"]
    + [f"{what}{at:+d}" for what in ("keyword", "separator", "quote") for at in (-3, -2, -1, 1, 2)]
    + ["file_long", "file_digits", "file_separators"]
)
PLACE = {name: i for i, name in enumerate(NAMES)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def secret_values(text: str) -> list[tuple[int, int]]:
    """The values inside the patterns' matches."""
    values = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    values += [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return sorted(values + [m.span() for m in HEX.finditer(text)])


# ------------------------------------------------------------ features

def file_features(text: str) -> list[bool]:
    size = max(len(text), 1)
    return [len(text) > 2000, text.count("0") + text.count("1") + text.count("2") > size / 100, text.count("=") + text.count(":") > size / 200]


def token_features(tokens: list[str], file: list[bool]) -> np.ndarray:
    """One row of zeros and ones per token, in the order of NAMES."""
    at = PLACE
    rows = np.zeros((len(tokens), len(NAMES)), dtype=np.float32)
    rows[:, at["bias"]] = 1
    flags = {"keyword": [], "separator": [], "quote": []}
    for i, token in enumerate(tokens):
        body = token.strip(".-=")
        digit = any("0" <= c <= "9" for c in body)
        letter = any(c.isalpha() for c in body)
        if digit or letter:
            rows[i, at["both" if digit and letter else "digits" if digit else "letters"]] = 1
        rows[i, at["other"]] = not body.replace("_", "").replace("-", "").isalnum()
        rows[i, at[f"{'code' if digit else 'word'}_length{sum(len(body) >= b for b in LENGTHS)}"]] = 1
        kinds = [c.isdigit() for c in body]
        changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
        rows[i, at[f"changes{sum(changes >= b for b in CHANGES)}"]] = 1
        rows[i, at["hex"]] = digit and letter and all(c in "0123456789abcdef" for c in body)
        flags["keyword"].append(bool(KEYWORD.search(token)) and len(token) < 20)
        flags["separator"].append(token in (":", "=") or (token.endswith("=") and len(token) < 20))
        flags["quote"].append(token in ("\"", "'"))
    for what, values in flags.items():
        v = np.array(values, dtype=np.float32)
        rows[:, at[what]] = v
        for shift in (-3, -2, -1, 1, 2):
            moved = np.zeros(len(v), dtype=np.float32)
            if shift < 0:
                moved[-shift:] = v[: len(v) + shift]
            else:
                moved[: max(len(v) - shift, 0)] = v[shift:]
            rows[:, at[f"{what}{shift:+d}"]] = moved
    for name, value in zip(("file_long", "file_digits", "file_separators"), file):
        rows[:, at[name]] = value
    return rows


def split_value(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Token positions in a stretch; a leading "name=" is a token of its own, so that the value is one."""
    out = []
    for m in TOKEN.finditer(text, start, end):
        a, b = m.span()
        cut = text.find("=", a, b)
        if a < cut < b - 1 and KEYWORD.search(text, a, cut):
            out += [(a, cut + 1), (cut + 1, b)]
        else:
            out.append((a, b))
    return out


def stretches(text: str, whole: bool = False) -> list[tuple[int, int]]:
    """Parts of a text that hold all tokens which need decoding, with plain words around them."""
    if whole:
        return [(0, len(text))] if text else []
    places = [m.span() for m in STANDS_OUT.finditer(text)]
    low = text.lower()
    if len(low) == len(text):
        for word in KEYWORDS:
            at = low.find(word)
            while at >= 0:
                places.append((at, at + len(word)))
                at = low.find(word, at + 1)
    else:  # lower-casing can lengthen a text, which would shift positions
        places += [m.span() for m in KEYWORD.finditer(text)]
    out: list[list[int]] = []
    for start, end in sorted(places):
        if out and end <= out[-1][2]:
            continue  # within the word that was widened already
        word_end = _blank_after(text, end)
        for _ in range(AROUND):
            start = _blank_before(text, start)
        end = word_end
        for _ in range(AROUND):
            end = _blank_after(text, end)
        if out and start <= out[-1][1]:
            out[-1][1:] = [max(out[-1][1], end), word_end]
        else:
            out.append([start, end, word_end])
    return [(a, b) for a, b, _ in out]


def plain_stretch(text: str, order: int) -> tuple[int, int]:
    """Some words anywhere in the text, mostly plain ones."""
    start = order % max(len(text) - 200, 1)
    return _blank_before(text, start), _blank_after(text, start + 200)


def _blank_after(text: str, at: int) -> int:
    """The end of the word at a position, or of the next one where that is white space."""
    return NEXT_WORD.match(text, at).end()


def _blank_before(text: str, at: int) -> int:
    """The start of the word before a position, across any white space."""
    while at and text[at - 1] in WHITE:
        at -= 1
    while at and text[at - 1] not in WHITE:
        at -= 1
    return at


# ------------------------------------------------------------ the field

@dataclass
class Field:
    """Weights (feature, tag), transitions (tag, tag), and whether plain words cut the chain."""

    weights: np.ndarray
    moves: np.ndarray
    cuts: bool

    def decode(self, tokens: list[str], file: list[bool]) -> list[int]:
        """The best tags by Viterbi; the stretch starts and ends outside."""
        scores = token_features(tokens, file) @ self.weights
        return viterbi(scores, self.moves)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    best = moves[OUTSIDE] + scores[0]
    back = []
    for row in scores[1:]:
        through = best[:, None] + moves
        back.append(through.argmax(axis=0))
        best = through.max(axis=0) + row
    tag = int((best + moves[:, OUTSIDE]).argmax())
    tags = [tag]
    for step in reversed(back):
        tag = int(step[tag])
        tags.append(tag)
    return tags[::-1]


# An inside tag needs a begin or an inside before it.
FORBIDDEN = np.zeros((3, 3))
FORBIDDEN[OUTSIDE, INSIDE] = -1e4


def fit_field(windows: list[tuple[np.ndarray, list[int]]], steps: int = 200, rate: float = 0.15, ridge: float = 3e-4) -> Field:
    """Maximum likelihood by gradient steps; windows are (features, tags)."""
    size, features = len(windows), len(NAMES)
    weights, moves = np.zeros((features, 3)), np.zeros((3, 3))
    if not size or not any(BEGIN in tags for _, tags in windows):
        weights[0, OUTSIDE] = 10.0
        return Field(weights, moves + FORBIDDEN, True)
    most = max(len(t) for _, t in windows)
    x = np.zeros((size, most, features), dtype=np.float32)
    y = np.zeros((size, most), dtype=np.int64)
    there = np.zeros((size, most), dtype=bool)
    for i, (rows, tags) in enumerate(windows):
        x[i, : len(tags)], y[i, : len(tags)], there[i, : len(tags)] = rows, tags, True
    truth = np.eye(3)[y] * there[:, :, None]
    flat = x.reshape(-1, features)
    before = np.concatenate((np.zeros((size, 1), dtype=np.int64), y[:, :-1]), axis=1)
    seen_moves = np.zeros((3, 3))
    np.add.at(seen_moves, (before[there], y[there]), 1)
    memory = [np.zeros((features, 3)), np.zeros((features, 3)), np.zeros((3, 3)), np.zeros((3, 3))]
    for step in range(1, steps + 1):
        scores = (flat @ weights.astype(np.float32)).reshape(size, most, 3).astype(np.float64)
        share, pair_sums = marginals(scores, moves + FORBIDDEN, there)
        g_weights = (flat.T @ (truth - share).reshape(-1, 3).astype(np.float32)) / size - ridge * weights
        g_moves = (seen_moves - pair_sums) / size - ridge * moves
        for value, gradient, m, v in ((weights, g_weights, *memory[:2]), (moves, g_moves, *memory[2:])):
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient**2 - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field = Field(weights, moves + FORBIDDEN, False)
    return Field(field.weights, field.moves, plain_words_cut(field))


def marginals(scores: np.ndarray, moves: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag probabilities and expected transitions under the field, for padded windows."""
    size, most, _ = scores.shape
    step = np.exp(moves)
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    # padding leaves the state as it is; every step is scaled to sum to one
    forward = np.empty((size, most, 3))
    forward[:, 0] = step[OUTSIDE] * local[:, 0]
    forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, most):
        moved = (forward[:, t - 1] @ step) * local[:, t]
        moved /= moved.sum(axis=1, keepdims=True)
        forward[:, t] = np.where(there[:, t, None], moved, forward[:, t - 1])
    backward = np.ones((size, most, 3))
    for t in range(most - 2, -1, -1):
        moved = (local[:, t + 1] * backward[:, t + 1]) @ step.T
        moved /= moved.sum(axis=1, keepdims=True)
        backward[:, t] = np.where(there[:, t + 1, None], moved, 1.0)
    share = forward * backward
    share *= there[:, :, None] / share.sum(axis=2, keepdims=True)
    pairs = np.zeros((3, 3))
    pairs[OUTSIDE] += share[:, 0].sum(axis=0)
    joint = forward[:, :-1, :, None] * step * (local[:, 1:] * backward[:, 1:])[:, :, None, :]
    joint *= there[:, 1:, None, None] / joint.sum(axis=(2, 3), keepdims=True)
    return share, pairs + joint.sum(axis=(0, 1))


def plain_words_cut(field: Field) -> bool:
    """Whether words of letters among such words are outside in every best tagging.

    Compares the least margin of such a token over all its possible features with the most that
    other tags could gain by transitions on both sides.
    """
    least = np.inf
    for tag in (BEGIN, INSIDE):
        gap = dict(zip(NAMES, field.weights[:, OUTSIDE] - field.weights[:, tag]))
        optional = ("other", "file_long", "file_digits", "file_separators")
        words = min(gap["letters"] + min(gap[f"word_length{i}"] for i in range(len(LENGTHS) + 1)), gap["other"] + gap["word_length0"])
        least = min(least, gap["bias"] + words + gap["changes0"] + sum(min(0.0, gap[n]) for n in optional))
    into, out = field.moves, field.moves
    gain = max(
        (into[a, y] + out[y, b]) - (into[a, OUTSIDE] + out[OUTSIDE, b if b != INSIDE else OUTSIDE])
        for a in range(3) for b in range(3) for y in (BEGIN, INSIDE)
    )
    return bool(least > gain)


# ------------------------------------------------------------ operators

def _windows(docs: DataFrame, seed: int) -> DataFrame:
    """(order, tokens, file, tags) of the stretches of documents, the patterns' values as tags."""

    def work(batches):
        for part in sliced(batches):
            rows = []
            for text, order in zip(part.column("text").to_pylist(), part.column("order").to_pylist()):
                values, file = secret_values(text), file_features(text)
                for number, (start, end) in enumerate([*stretches(text), plain_stretch(text, order)]):
                    places = split_value(text, start, end)[:WINDOW_TOKENS]
                    tags, held = [], None
                    for a, b in places:
                        value = next((v for v in values if a < v[1] and v[0] < b), None)
                        tags.append(OUTSIDE if value is None else INSIDE if value == held else BEGIN)
                        held = value
                    rows.append((order * 1000 + number % 1000, [text[a:b] for a, b in places], file, tags))
            if rows:
                kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["order", "tokens", "file", "tags"])

    return docs.mapInArrow(work, "order long, tokens array<string>, file array<boolean>, tags array<int>")


def learn(docs: DataFrame, text: str = "text", documents: int = FIT_DOCUMENTS, windows: int = FIT_WINDOWS, seed: int = 29) -> Field:
    """A field from at most ``windows`` stretches of about ``documents`` distinct texts, taken by hash."""
    total = docs.agg(F.approx_count_distinct(F.xxhash64(F.col(text).cast("string")), 0.02)).first()[0]
    share = min(1.0, documents / max(total, 1))
    order = F.pmod(F.xxhash64(F.col(text), F.lit(seed)), F.lit(1 << 40))
    sample = docs.select(F.col(text).cast("string").alias("text"), order.alias("order")).filter(
        F.col("text").isNotNull() & (F.col("order") < int(share * (1 << 40)))
    ).dropDuplicates(["text"])  # copies share an order, and would take all places
    rows = _windows(sample, seed).orderBy("order", "tokens").limit(windows).collect()
    return fit_field([(token_features(r["tokens"], r["file"]), r["tags"]) for r in rows if r["tokens"]])


def added_spans(text: str, field: Field, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Secrets that only the field finds."""
    file, out = None, []
    for start, end in stretches(text, not field.cuts):
        places = split_value(text, start, end)
        if not places:
            continue
        file = file or file_features(text)
        tags = field.decode([text[a:b] for a, b in places], file)
        span = None
        for (a, b), tag in zip([*places, (len(text) + 1, len(text) + 1)], [*tags, OUTSIDE]):
            if span and tag != INSIDE:
                if not any(s < span[1] and span[0] < e for s, _, e in base):
                    out.append((span[0], 3, span[1]))
                span = None
            if tag == BEGIN:
                span = (a, b)
            elif tag == INSIDE and span:
                span = (span[0], b)
    return out


def secrets_of(text: str | None, field: Field) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' and the field's spans, in order."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + added_spans(text, field, base))


def redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    """The text with a mark in place of its spans; overlapping spans share one."""
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The documents with ``secrets``: structs (kind, start, end) by start, then kind."""
    docs = docs.drop("secrets")
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(docs.schema.fields + [T.StructField("secrets", span)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        for part in sliced(batches, text):
            found = [
                [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in secrets_of(value, field)] for value in part.column(text).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, "secrets"])

    return docs.mapInArrow(work, schema)


def redact(docs: DataFrame, field: Field, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with a mark in place of every secret."""

    def work(batches):
        for part in sliced(batches, text):
            texts = [redacted(value, secrets_of(value, field), mark) for value in part.column(text).to_pylist()]
            columns = [pa.array(texts, pa.string()) if n == text else part.column(n) for n in part.schema.names]
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(work, docs.schema)
