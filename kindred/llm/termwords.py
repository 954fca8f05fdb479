"""Lower-case words of whole texts: runs of ASCII letters and digits and of all characters beyond ASCII, with only A-Z made small.

Every byte of a character beyond ASCII is 0x80 or more, so words of bytes are words of characters. Texts are cut into pieces between words, so a
very long text needs no list of all its words at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a piece, which a longer word exceeds.
PIECE = 1 << 18
#: Each byte of a word in lower case; a space for every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    for text in column:
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of one text in their order, in lists of about ``size`` bytes."""
    text, at = text.translate(LOWER), 0
    while len(text) - at > size:
        end = text.rfind(b" ", at, at + size) + 1 or text.find(b" ", at + size) + 1 or len(text)
        yield text[at:end].split()
        at = end
    yield text[at:].split()
