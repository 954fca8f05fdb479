"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model's parts are compiled once: the normaliser (a space put before the text, spaces written as
U+2581; a model that specifies another one is refused), a trie of the pieces, and a fallback from characters without a piece to their UTF-8 bytes. For a
byte-pair model the cost of a piece is not its own: a segmentation is the model's if and only if no two neighbours would have been
merged otherwise. So the pieces are composed with an automaton whose states are pieces and whose arc from p to q
weighs 0 if merging p + q alone gives p, q again, and infinity if not; arcs are compiled when first
needed. An input is composed with the result and the shortest path of the tropical semiring (min, +) is its encoding.
No piece goes on after a space mark has followed a letter, so the composition falls apart at
words, and the paths of words seen before are remembered, a bounded number of them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm import textwords as tw

MARK = "▁"
#: Bytes of words and of their ids that are remembered at most, and the longest word that is.
MEMO, LONGEST = 1 << 26, 64
#: Compiled arcs that are kept at most.
ARCS = 1 << 20
#: What an entry takes beside its characters and ids.
OVERHEAD = 160
START, FALLBACK, NONE = -1, -2, -3
EMPTY: dict[int, bool] = {}
#: The score where nothing is left to merge.
NO_MERGE = float("-inf")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; fixed-width values come as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, data[at : at + size]
        at += size


def check_model(data: bytes) -> None:
    """Raises ValueError unless a model is a byte-pair one whose normaliser leaves characters as they are, marks every space and puts one before the text.

    Those are what the transducer's normaliser is compiled for: other specifications would give other ids.
    """
    # fixed values of the model's format: numbers of fields, and what they mean where they are left out
    model = dict(fields(data))
    trainer, normaliser = dict(fields(model.get(2, b""))), dict(fields(model.get(3, b"")))
    said = {
        "model type": trainer.get(3, 1) == 2,
        "byte fallback": trainer.get(35, 0) == 1,
        "character map": not normaliser.get(2, b""),
        "space before the text": normaliser.get(3, 1) == 1,
        "extra white space": normaliser.get(4, 1) == 0,
        "space marks": normaliser.get(5, 1) == 1,
    }
    wrong = [name for name, fine in said.items() if not fine]
    if wrong:
        raise ValueError(f"the transducer can't follow this model's {', '.join(wrong)}")


class Transducer:
    """Texts to piece ids and back, for a byte-pair model with byte fallback and the identity as character map."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        check_model(model.serialized_model_proto())
        ids = range(model.get_piece_size())
        self.names = [model.id_to_piece(i) for i in ids]
        self.score = [model.get_score(i) for i in ids]
        self.bytes = {int(self.names[i][3:5], 16): i for i in ids if model.is_byte(i)}
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {self.names[i]: i for i in normal}
        #: The trie: of each state the next by character, and the piece that ends there or ``NONE``.
        self.next: list[dict[str, int]] = [{}]
        self.final: list[int] = [NONE]
        for name, i in self.pieces.items():
            at = 0
            for c in name:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.final.append(NONE)
                at = self.next[at][c]
            self.final[at] = i
        #: The lengths of pieces, and of each the next shorter one that starts it: the fallback where not even its first character is a piece.
        self.longest = max(map(len, self.pieces), default=1)
        self.size = {FALLBACK: 1} | {i: len(name) for name, i in self.pieces.items()}
        self.shorter = {FALLBACK: NONE}
        for name, i in self.pieces.items():
            starts = (self.pieces[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in self.pieces)
            self.shorter[i] = next(starts, NONE if len(name) == 1 else FALLBACK)
        self.spelled = [self.names[i].replace(MARK, " ").encode() for i in ids]
        for byte, i in self.bytes.items():
            self.spelled[i] = bytes([byte])
        for i in ids:
            if model.is_control(i):
                self.spelled[i] = b""
        self.arcs: dict[int, dict[int, bool]] = {}
        self.compiled = 0
        self.histories: dict[int, tuple[list[float], list[str], list[str]] | None] = {}
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def merged(self, text: str, log: list[tuple[float, str, str]] | None = None) -> list[str]:
        """The model's merges: again and again the pair of neighbours whose union has the highest score, the leftmost of equals. ``log`` gets the score of each, and the first and the last part after it."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.pieces.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if log is not None:
                log.append((best, parts[0], parts[-1]))

    def history(self, piece: int) -> tuple[list[float], list[str], list[str]] | None:
        """The merges that make a piece of its characters: their scores, then ``NO_MERGE``, and the first and the last part before each and at the end. None where they don't make it."""
        if piece not in self.histories:
            name, log = self.names[piece], []
            whole = self.merged(name, log) == [name]
            self.histories[piece] = ([x[0] for x in log] + [NO_MERGE], [name[0], *(x[1] for x in log)], [name[-1], *(x[2] for x in log)]) if whole else None
        return self.histories[piece]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces together gives the two. As long as nothing is merged across, each side goes its own way, the side of the higher score first, the left one of equals."""
        one, two = self.history(left), self.history(right)
        if one is None or two is None:
            return False
        (scores, _, lasts), (others, firsts, _) = one, two
        a = b = 0
        while True:
            piece = self.pieces.get(lasts[a] + firsts[b])
            across = NO_MERGE if piece is None else self.score[piece]
            last, first = lasts[a], firsts[b]
            while lasts[a] is last and firsts[b] is first:
                x, y = scores[a], others[b]
                if across > x and across >= y:
                    return False
                if x == y == NO_MERGE:
                    return True
                if x >= y:
                    a += 1
                else:
                    b += 1

    def finite(self, left: int, right: int) -> bool:
        """Whether the arc from one piece to the next weighs 0, not infinity. Compiles it."""
        if left < 0 or right < 0:
            return True
        if self.compiled >= ARCS:
            self.arcs.clear()
            self.compiled = 0
        self.compiled += 1
        known = self.arcs.setdefault(left, {})[right] = self.apart(left, right)
        return known

    def shortest(self, text: str) -> list[int]:
        """Piece ids of the shortest path through the composition with a normalised text.

        Arcs weigh 0 or infinity, and each prefix of a text has one segmentation, so each position has one state
        that a path of finite weight reaches. Longer pieces are tried first; a position from which no path of weight 0
        goes on is left once and for all, so each is entered once at most.
        """
        n, nexts, final, all_arcs, size, shorter = len(text), self.next, self.final, self.arcs, self.size, self.shorter
        states, ends, dead, i = [START], [0], set(), 0
        while i < n:
            # the longest piece the text goes on with; all others that it goes on with are that one's prefixes
            at, piece = 0, FALLBACK
            for c in text[i : i + self.longest]:
                at = nexts[at].get(c)
                if at is None:
                    break
                if final[at] != NONE:
                    piece = final[at]
            while True:
                last = states[-1]
                arcs = all_arcs.get(last, EMPTY)
                while piece != NONE:
                    end = i + size[piece]
                    if end not in dead:
                        finite = arcs.get(piece)
                        if self.finite(last, piece) if finite is None else finite:
                            break
                    piece = shorter[piece]
                if piece != NONE:
                    states.append(piece)
                    ends.append(end)
                    i = end
                    break
                dead.add(i)
                piece = shorter[states.pop()]
                del ends[-1]
                i = ends[-1]
        path = []
        for k in range(1, len(states)):
            path += [states[k]] if states[k] >= 0 else [self.bytes[b] for b in text[ends[k - 1] : ends[k]].encode()]
        return path

    def learned(self, segment: str) -> bytes:
        path = self.shortest(segment)
        ids = struct.pack(f"<{len(path)}I", *path)
        if len(segment) <= LONGEST:
            if self.held >= MEMO:
                self.memo.clear()
                self.held = 0
            self.memo[segment] = ids
            self.held += 4 * len(segment) + len(ids) + OVERHEAD
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes; the empty text has none."""
        if not text:
            return b""
        get, out, gap = self.memo.get, [], 0
        for word in text.replace(MARK, " ").split(" "):
            gap += 1
            if word:
                segment = MARK * gap + word
                ids = get(segment)
                out.append(self.learned(segment) if ids is None else ids)
                gap = 0
        if gap:
            out.append(self.learned(MARK * gap))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the space put before it; bytes that are no UTF-8 become U+FFFD."""
        spelled = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return spelled.removeprefix(b" ").decode(errors="replace")


@cache
def transducer(path: str) -> Transducer:
    """One a process."""
    return Transducer(path)


def encoded(text: Column, path: str) -> Column:
    """Binary: the ids of each text; null stays null."""

    @F.arrow_udf(returnType=T.BinaryType())
    def encode(column: pa.Array) -> pa.Array:
        machine, out, valid = transducer(path), [], column.is_valid().to_pylist()
        for a, _, data, offs in tw.slices(column):
            raw = data.tobytes()
            out += [machine.encode(raw[x:y].decode()) if valid[a + i] else None for i, (x, y) in enumerate(zip(offs[:-1], offs[1:], strict=True))]
        return pa.array(out, pa.binary())

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of each row of ids."""

    @F.arrow_udf(returnType=T.StringType())
    def decode(column: pa.Array) -> pa.Array:
        machine = transducer(path)
        return pa.array([machine.decode(x.as_py()) if x.is_valid else None for x in column], pa.string())

    return decode(ids)


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_ids, ids_crc32, n_chars, decoded_sha256)`` of every document: its encoding, and what that decodes to.

    ``ids_crc32``: of the ids as little-endian unsigned 32-bit integers. ``n_chars`` and ``decoded_sha256`` are those of the decoded
    text, which equals the text but for U+2581, which comes back as a space. A null text counts as empty and has no ids;
    repeated rows and null ids get a row each.
    """
    path = path or model_path()
    ids = documents.select("doc_id", encoded(F.coalesce("text", F.lit("")), path).alias("ids"))
    text = ids.select("doc_id", F.col("ids"), decoded(F.col("ids"), path).alias("decoded"))
    return text.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.length("decoded").cast("long").alias("n_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))
