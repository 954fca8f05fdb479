"""Secrets in texts: three patterns, and a linear-chain conditional random field for what no pattern names.

Tokens are runs of the characters that secrets are made of. The field gives each the tag outside, begin or inside by its shape, the words beside it, what stands between, and features of the whole
text. A word of letters alone is no part of a secret: its tag is fixed to outside, so a text falls into islands of other tokens, and Viterbi's search through each island gives the
best tags of the whole text. All islands of a slice are decoded side by side.

Nothing in the tables marks secrets, so the field learns from the patterns' own matches in a bounded sample of the texts and from secrets of many shapes planted there, among decoys (addresses, dates, paths,
versions, numbers). Spans by patterns stay as they are; the field adds those that overlap none.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm import textwords as tw

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The least length of an assigned value, and of a whole match of the others.
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "field")
#: A match of hexadecimal digits is a maximal run of them, so only long ones need be sought.
LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
#: A text without any of these, in small letters, holds no assignment.
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Texts of the sample that the field is fitted on, about; bytes and tokens of each that are looked at.
SAMPLE, SAMPLE_BYTES, SAMPLE_TOKENS = 4000, 20_000, 256
OUTSIDE, BEGIN, INSIDE = range(3)


def base_matches(text: str) -> list[tuple[int, str, int, int]]:
    """``(start, kind, end, start of the value)`` of the patterns' matches, leftmost and non-overlapping by kind, in code points; those that are too short are dropped after matching."""
    found, low = [], text.lower()
    if any(k in low for k in KEYS):
        found += [(m.start(), "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), "hex", m.end(), m.start()) for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda m: (m[0], KINDS.index(m[1])))


# ---- tokens and their features

LETTER, UPPER, DIGIT, SIGN = 1, 2, 4, 8
CLASS = np.zeros(256, np.uint8)
CLASS[97:123] = CLASS[128:] = LETTER
CLASS[65:91] = UPPER
CLASS[48:58] = DIGIT
for _c in b"+/_@~":
    CLASS[_c] = SIGN
TOKEN = CLASS > 0
for _c in b".-":
    TOKEN[_c] = True
#: What may stand between tokens, by bits.
GAP = np.zeros(256, np.uint8)
for _bit, _chars in enumerate((b"=", b":", b"\"'`", b"\n\r", b"<>", b"()[]{}")):
    for _c in _chars:
        GAP[_c] = 1 << _bit
HEXADECIMAL = np.zeros(256, bool)
for _c in b"0123456789abcdefABCDEF":
    HEXADECIMAL[_c] = True

#: A letters-only run of so many bytes is long enough to be looked at.
LONG_WORD = 24
BINS = 1 << 15
FEATURES = 16


@dataclass
class Tokens:
    """Tokens of some texts that may be part of secrets: byte starts and ends, the text each is of, and whether each follows the one before directly."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    follows: np.ndarray
    features: np.ndarray


def _bucket(share: np.ndarray, n: int) -> np.ndarray:
    return np.minimum((share * n).astype(np.int64), n - 1)


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def tokens(data: np.ndarray, offs: np.ndarray) -> Tokens:
    """The tokens of texts (bytes and offsets) that aren't fixed to outside, with ``FEATURES`` hashed features each."""
    starts, ends, by_row = tw.word_spans(data, offs, TOKEN)
    kind = CLASS[data]
    inner = np.zeros(len(data), bool)
    inner[1:] = (kind[1:] == UPPER) & TOKEN[data[:-1]]
    odd = _sums((kind == DIGIT) | (kind == SIGN) | inner)
    upper = _sums(kind == UPPER)
    plain = (odd[ends] == odd[starts]) & (ends - starts < LONG_WORD)
    # words in capitals are words
    capitals = (upper[ends] - upper[starts] >= ends - starts) & (ends - starts < LONG_WORD)
    at = np.flatnonzero(~plain & ~capitals)
    row = np.searchsorted(by_row, at, side="right") - 1
    start, end = starts[at], ends[at]
    follows = np.zeros(len(at), bool)
    follows[1:] = (at[1:] == at[:-1] + 1) & (row[1:] == row[:-1])
    if not len(at):
        return Tokens(start, end, row, follows, np.zeros((0, FEATURES), np.int64))

    length = end - start
    count = {k: _sums(kind == c) for k, c in (("digit", DIGIT), ("sign", SIGN))} | {"upper": upper, "hex": _sums(HEXADECIMAL[data]), "dot": _sums(data == 46), "at": _sums(data == 64), "slash": _sums(data == 47)}
    share = {k: (s[end] - s[start]) / length for k, s in count.items()}
    lower = 1 - share["digit"] - share["upper"] - share["sign"] - share["dot"]
    size = np.minimum(np.log2(length + 1) * 4, 31).astype(np.int64)
    mask = (share["digit"] > 0) * 1 + (share["upper"] > 0) * 2 + (lower > 0.001) * 4 + (share["sign"] > 0) * 8 + (share["dot"] > 0) * 16 + (share["hex"] == 1) * 32 + (share["at"] > 0) * 64 + (share["slash"] > 0) * 128
    turns = _sums(np.concatenate([[False], kind[1:] != kind[:-1]]))
    turning = (turns[end] - turns[np.minimum(start + 1, end)]) / length

    hashes = tw.spans_hash(tw.lowered(data), starts, ends, tw.BASES[0])
    nothing = np.uint64(1)
    first, last = by_row[row], by_row[row + 1]

    def beside(step: int) -> np.ndarray:
        to = at + step
        inside = (to >= first) & (to < last)
        return np.where(inside, hashes[np.clip(to, 0, len(hashes) - 1)], nothing)

    gap_bits = [_sums(GAP[data] == 1 << b) for b in range(6)]

    def gap(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return sum(((s[right] - s[left]) > 0).astype(np.int64) << b for b, s in enumerate(gap_bits))

    before = gap(np.where(at > first, ends[np.maximum(at - 1, 0)], offs[row]), start)
    after = gap(end, np.where(at + 1 < last, starts[np.minimum(at + 1, len(starts) - 1)], offs[row + 1]))
    begins = tw.spans_hash(data, start, np.minimum(start + 4, end), tw.BASES[1])
    whole = np.maximum(np.diff(offs), 1)
    text_digits, text_signs = (_bucket((s[offs[1:]] - s[offs[:-1]]) / whole * 5, 5) for s in (count["digit"], _sums(GAP[data] > 0)))
    texts = (text_digits * 5 + text_signs)[row]

    discrete = [
        np.zeros(len(at), np.int64),
        size,
        mask,
        size * 256 + mask,
        _bucket(share["digit"], 8) * 8 + _bucket(share["upper"], 8),
        _bucket(turning, 10) * 32 + size,
        _bucket(share["hex"], 5) * 8 + _bucket(share["digit"], 8),
        before,
        after,
        (before * 64 + after) * 32 + size,
        begins,
        beside(-1),
        beside(-2),
        beside(1),
        tw.mixed(beside(-1) + (before.astype(np.uint64) << np.uint64(3))),
        texts * 32 + size,
    ]
    hashed = [tw.mixed(x.astype(np.uint64) * np.uint64(FEATURES) + np.uint64(i)) >> np.uint64(49) for i, x in enumerate(discrete)]
    return Tokens(start, end, row, follows, np.stack(hashed, 1).astype(np.int64))


# ---- the field


@dataclass
class Field:
    """Scores of tags by features, and of a tag after another; outside stands before and after every island."""

    weights: np.ndarray
    steps: np.ndarray

    def unary(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for i in range(features.shape[1]):
            out += self.weights[features[:, i]]
        return out


IMPOSSIBLE = -1e4


def islands(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and lengths of runs of tokens, the longest first."""
    begin = np.flatnonzero(~follows)
    length = np.diff(np.append(begin, len(follows)))
    order = np.argsort(-length, kind="stable")
    return begin[order], length[order]


def viterbi(unary: np.ndarray, steps: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """The best tags, all islands step by step together."""
    tags = np.zeros(len(unary), np.int8)
    begin, length = islands(follows)
    if not len(begin):
        return tags
    back = np.zeros((len(unary), 3), np.int8)
    score = steps[OUTSIDE] + unary[begin]
    for t in range(1, int(length[0])):
        n = int(np.searchsorted(-length, -t, side="left"))
        ways = score[:n, :, None] + steps[None]
        at = begin[:n] + t
        back[at] = ways.argmax(1)
        score[:n] = ways.max(1) + unary[at]
    here = (score + steps[:, OUTSIDE]).argmax(1).astype(np.int8)
    for t in range(int(length[0]) - 1, -1, -1):
        n = int(np.searchsorted(-length, -t, side="left"))
        at = begin[:n] + t
        tags[at] = here[:n]
        here[:n] = back[at, here[:n]]
    return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def likelihood(unary: np.ndarray, mask: np.ndarray, tags: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(negative log-likelihood, its gradients by unary scores and by steps) of padded islands (island, place, tag), by forward and backward sums."""
    n, length, _ = unary.shape
    forward, backward = np.zeros((n, length, 3)), np.zeros((n, length, 3))
    forward[:, 0] = steps[OUTSIDE] + unary[:, 0]
    for t in range(1, length):
        on = _logsum(forward[:, t - 1, :, None] + steps[None], 1) + unary[:, t]
        forward[:, t] = np.where(mask[:, t, None], on, forward[:, t - 1])
    whole = _logsum(forward[:, -1] + steps[:, OUTSIDE], 1)
    backward[:, -1] = steps[:, OUTSIDE]
    for t in range(length - 2, -1, -1):
        on = _logsum(steps[None] + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(mask[:, t + 1, None], on, steps[:, OUTSIDE])
    expected = np.exp(forward + backward - whole[:, None, None]) * mask[:, :, None]
    by_steps = np.zeros((3, 3))
    known = np.take_along_axis(unary, tags[:, :, None], 2)[:, :, 0]
    given = (known * mask).sum() + steps[OUTSIDE, tags[:, 0]].sum()
    by_steps[OUTSIDE] += expected[:, 0].sum(0) - np.bincount(tags[:, 0], minlength=3)
    for t in range(1, length):
        live = mask[:, t]
        pair = np.exp(forward[live, t - 1, :, None] + steps[None] + (unary[live, t] + backward[live, t])[:, None, :] - whole[live, None, None])
        by_steps += pair.sum(0)
        np.add.at(by_steps, (tags[live, t - 1], tags[live, t]), -1)
        given += steps[tags[live, t - 1], tags[live, t]].sum()
    last = tags[np.arange(n), mask.sum(1) - 1]
    end = np.exp(forward[np.arange(n), mask.sum(1) - 1] + steps[:, OUTSIDE] - whole[:, None]).sum(0)
    by_steps[:, OUTSIDE] += end - np.bincount(last, minlength=3)
    given += steps[last, OUTSIDE].sum()
    by_unary = expected.copy()
    np.put_along_axis(by_unary, tags[:, :, None], np.take_along_axis(by_unary, tags[:, :, None], 2) - mask[:, :, None], 2)
    return float(whole.sum() - given), by_unary, by_steps


def train(features: np.ndarray, follows: np.ndarray, tags: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.25, shrink: float = 2e-5, longest: int = 12, seed: int = 7) -> Field:
    """A field by adaptive gradient descent on the likelihood of ``tags``; islands longer than ``longest`` are cut. Without tokens all tags are outside."""
    weights, steps = np.zeros((BINS, 3)), np.zeros((3, 3))
    weights[:, BEGIN:] -= 0.02
    steps[OUTSIDE, INSIDE] = IMPOSSIBLE
    begin, length = islands(follows)
    pieces = [(b + k, min(longest, n - k)) for b, n in zip(begin.tolist(), length.tolist(), strict=True) for k in range(0, n, longest)]
    seen, seen_steps, order = np.full_like(weights, 1e-6), np.full_like(steps, 1e-6), np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(pieces)), max(1, len(pieces) // batch)):
            if not len(part):
                continue
            first, size = np.array([pieces[i] for i in part]).T
            place = np.arange(size.max())
            mask = place[None] < size[:, None]
            at = np.where(mask, first[:, None] + place[None], first[:, None])
            used = features[at]
            own = np.where(mask, tags[at], OUTSIDE)
            # a piece that was cut off begins anew
            own[:, 0] = np.where(own[:, 0] == INSIDE, BEGIN, own[:, 0])
            _, by_unary, by_steps = likelihood(weights[used].sum(2), mask, own, steps)
            live, where = np.unique(used[mask], return_inverse=True)
            grad = np.zeros((len(live), 3))
            np.add.at(grad, where.reshape(-1), np.repeat(by_unary[mask], features.shape[1], axis=0))
            grad = grad / len(part) + shrink * weights[live]
            seen[live] += grad**2
            weights[live] -= rate * grad / np.sqrt(seen[live])
            by_steps = by_steps / len(part)
            by_steps[OUTSIDE, INSIDE] = 0
            seen_steps += by_steps**2
            steps -= rate * by_steps / np.sqrt(seen_steps)
    return Field(weights.astype(np.float32), steps)


# ---- what the field learns from

NAMES = ("password", "pwd", "passphrase", "secret", "client_secret", "token", "access token", "bearer", "Authorization: Bearer", "apikey", "api key", "private_key", "auth", "credential", "credentials", "key", "aws_secret_access_key", "session", "signature", "login")
JOINS = (" = ", "=", ": ", ":", " ", " is ", ' = "', '="', ": '", "\n")
PREFIXES = ("", "", "", "", "ghp_", "sk-", "sk_live_", "xoxb-", "eyJ", "AIza", "glpat-", "npm_")


def planted(rng: random.Random) -> tuple[str, str, str]:
    """(before, secret, after): a random secret, most often after a word that announces one."""
    pick = lambda letters, low, high: "".join(rng.choices(letters, k=rng.randint(low, high)))
    alphabet = string.ascii_letters + string.digits
    value = rng.choice(
        [
            lambda: pick("0123456789abcdef", 16, 64),
            lambda: pick("0123456789ABCDEF", 16, 64),
            lambda: rng.choice(PREFIXES) + pick(alphabet, 16, 48),
            lambda: rng.choice(PREFIXES) + pick(alphabet + "+/", 24, 64),
            lambda: pick(alphabet + "_-", 20, 48),
            lambda: pick(string.ascii_uppercase + string.digits, 16, 32),
            lambda: rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16, 16),
            lambda: "eyJ" + pick(alphabet, 16, 30) + ".eyJ" + pick(alphabet, 20, 60) + "." + pick(alphabet + "_-", 20, 43),
            lambda: "-".join(pick(string.ascii_uppercase + string.digits, 5, 5) for _ in range(rng.randint(4, 5))),
        ]
    )()
    if rng.random() < 0.75:
        join = rng.choice(JOINS)
        return rng.choice(NAMES) + join, value, {'"': '"', "'": "'"}.get(join[-1], "")
    quote = rng.choice(["", "", '"'])
    return quote, value, quote


def decoy(rng: random.Random) -> str:
    """Something odd that is no secret."""
    digits = lambda n: "".join(rng.choices(string.digits, k=n))
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9)))
    return rng.choice(
        [
            lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com",
            lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
            lambda: digits(rng.randint(5, 20)),
            lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}",
            lambda: f"20{digits(2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
            lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}",
            lambda: f"https://www.{word()}.org/{word()}/{word()}_{digits(3)}.html",
            lambda: f"/usr/{word()}/{word()}_{word()}.py",
            lambda: f"{word()}{word().title()}{word().title()}",
            lambda: f"{word()}_{word()}_{digits(2)}",
            lambda: f"{digits(3)}.{digits(2)}.{digits(3)}.{digits(1)}",
            lambda: f"#{digits(2)}abcd",
            lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
            lambda: f"{word()}-{digits(2)}-{word()}",
            lambda: f"{word()} = {digits(rng.randint(1, 6))}",
            lambda: f"{word()}: {word()}{digits(2)}",
            lambda: f"1,{digits(3)},{digits(3)}.{digits(2)}",
        ]
    )()


def with_plants(text: str, rng: random.Random, plants: int = 2, decoys: int = 6) -> tuple[str, list[tuple[int, int]]]:
    """A text with secrets and decoys put between its words, and where the secrets are."""
    breaks = [m.start() for m in re.finditer(r"[ \n]", text)] or [len(text)]
    made = [planted(rng) for _ in range(plants)] + [("", None, decoy(rng)) for _ in range(decoys)]
    rng.shuffle(made)
    out, size, spans, last = [], 0, [], 0
    for cut, (before, secret, after) in zip(sorted(rng.choices(breaks, k=len(made))), made, strict=True):
        parts = [text[last:cut], " ", before]
        size += sum(map(len, parts))
        if secret is not None:
            spans.append((size, size + len(secret)))
            parts.append(secret)
            size += len(secret)
        out += [*parts, after]
        size += len(after)
        last = cut
    return "".join([*out, text[last:]]), spans


def code_points(data: np.ndarray) -> np.ndarray:
    """How many characters begin before each byte, and before the end."""
    return _sums((data & 0xC0) != 0x80)


def lesson(text: str) -> bytes:
    """Features, whether each follows the one before, and tags of the tokens of a text with plants, as 32-bit integers."""
    raw = text.encode()[:SAMPLE_BYTES].decode(errors="ignore")
    made, spans = with_plants(raw, random.Random(zlib.crc32(raw.encode())))
    spans += [(m[3], m[2]) for m in base_matches(made)]
    data = np.frombuffer(made.encode(), np.uint8)
    found = tokens(data, np.array([0, len(data)]))
    points = code_points(data)
    start, end = points[found.start], points[found.end]
    tags = np.zeros(len(start), np.int32)
    for a, b in sorted(spans):
        inside = np.flatnonzero((start < b) & (end > a))
        tags[inside] = INSIDE
        tags[inside[:1]] = BEGIN
    keep = slice(0, SAMPLE_TOKENS)
    return np.column_stack([found.features, found.follows, tags])[keep].astype("<i4").tobytes()


def fit(documents: DataFrame, sample: int = SAMPLE) -> Field:
    """A field fitted on about ``sample`` texts of ``documents`` (doc_id, text), those whose hashes are below a bound; tasks make the lessons, whose size is bounded."""

    @F.arrow_udf(returnType=T.BinaryType())
    def lessons(column: pa.Array) -> pa.Array:
        return pa.array([lesson(x or "") for x in column.to_pylist()], pa.binary())

    n, whole = documents.count(), float(1 << 40)
    chosen = documents.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_BYTES).alias("text")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).cast("double") * n <= sample * whole)
    table = chosen.select(F.xxhash64("doc_id").alias("_a"), F.xxhash64("text").alias("_b"), lessons(F.col("text")).alias("_x")).toArrow()
    order = np.lexsort([table["_b"].to_numpy(), table["_a"].to_numpy()])
    held = table["_x"].to_pylist()
    rows = np.frombuffer(b"".join(held[i] for i in order), "<i4").reshape(-1, FEATURES + 2).astype(np.int64)
    follows = rows[:, FEATURES] > 0
    return train(rows[:, :FEATURES], follows, rows[:, FEATURES + 1])


# ---- scanning

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def field_spans(column: pa.Array, field: Field) -> Iterator[tuple[int, int, int]]:
    """``(row, start, end)``, in code points, of what the field finds, row by row; padding behind a secret belongs to it."""
    for first, _, data, offs in tw.slices(column):
        found = tokens(data, offs)
        tags = viterbi(field.unary(found.features), field.steps, found.follows)
        begin = np.flatnonzero(tags == BEGIN)
        if not len(begin):
            continue
        points = code_points(data)
        for b in begin.tolist():
            e = b
            while e + 1 < len(tags) and tags[e + 1] == INSIDE:
                e += 1
            row, start, end = int(found.row[b]), int(found.start[b]), int(found.end[e])
            while end < offs[row + 1] and data[end] == 61 and end - found.end[e] < 2:
                end += 1
            yield first + row, int(points[start] - points[offs[row]]), int(points[end] - points[offs[row]])


def spans(text: Column, field: object) -> Column:
    """``array<struct<kind, start, end>>`` of each text, by start and kind; ``field`` is a broadcast one."""

    @F.arrow_udf(returnType=SPANS)
    def scan(column: pa.Array) -> pa.Array:
        added: dict[int, list[tuple[int, int]]] = {}
        for row, start, end in field_spans(column, field.value):
            added.setdefault(row, []).append((start, end))
        out = []
        for row, text in enumerate(column):
            found = [(start, kind, end) for start, kind, end, _ in base_matches(text.as_py())] if text.is_valid else []
            new = [(a, "field", b) for a, b in added.get(row, ()) if not any(a < end and b > start for start, _, end in found)]
            out.append([{"kind": kind, "start": start, "end": end} for start, kind, end in (sorted(found + new, key=lambda x: (x[0], KINDS.index(x[1]))) if new else found)])
        return pa.array(out, ARROW_SPANS)

    return scan(text)


def with_secrets(documents: DataFrame, field: Field, column: str = "secrets") -> DataFrame:
    """``documents`` with all spans of secrets in their whole texts; of kind ``field`` those that no pattern found. Null texts count as empty."""
    return documents.withColumn(column, spans(F.col("text"), documents.sparkSession.sparkContext.broadcast(field)))


def digest(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of every document: how many matches each pattern has, a checksum of them, and all spans.

    A span is ``kind:start:end`` of a whole match, in code points, the end exclusive; spans are joined by commas, in the order of their starts and then as kinds are
    listed. A null text is empty; a repeated row comes back as often as it occurs, a null id as null; other columns aren't read.
    """
    rows = documents.select("doc_id", "text")
    found = with_secrets(rows, fit(rows, sample), "_s").select("doc_id", "_s")
    joined = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))))
    number = lambda kind: F.size(F.filter("_s", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("_s", lambda x: x.kind != "field")
    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_s")).alias("spans"))
