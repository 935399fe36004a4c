"""Word-memoised tokenisation that equals the ``tokenizers`` library.

Both public vocabularies split a text with a pattern and run BPE on each piece
by itself, so a piece's ids do not depend on its neighbours.  A worker keeps
the ids of the pieces it has seen and asks the library once for each new one.
The split is done here only for texts made of characters on which the two
pattern engines agree; any other text goes to the library as a whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Character classes below U+0180, as the vocabularies' patterns see them.
_L = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_N = "0-9²³¹¼½¾"
_S = "\\t-\\r \\x85\\xa0"

#: Texts with any other character are left to the library.
_OTHER = re.compile("[^\x00-\x1b -įı-ſ‐-‧‰-⁞₠-₿←-⇿\U0001f300-\U0001faff]")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_BYTE = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)

#: Pieces of a generation (a worker remembers two), and the longest one worth it.
MEMO_PIECES = 500_000
MEMO_CHARS = 64

# The byte-level alphabet: printable Latin-1 bytes stand for themselves, the
# others for the characters from U+0100 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SWAP = sys.byteorder != "little"
_ALPHABET = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def byte_level(piece: str) -> str:
    if piece.isascii() and piece.isprintable():  # all but the space stand for themselves
        return piece.replace(" ", _ALPHABET[32])
    return piece.encode().decode("latin-1").translate(_ALPHABET)


class _Memo(dict):
    """piece -> its ids as little-endian bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
        return ids

    def age(self) -> None:
        """Forget the pieces not met since the last time."""
        self.old = dict(self)
        self.clear()


class Pieces:
    """Encoder for one vocabulary file; ids come as packed unsigned integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.lower = "</w>" in self._suffix()
        self.pattern = _WORD if self.lower else _BYTE
        self.memo = _Memo(self._of_piece)
        self.model = self.lib.model
        self.special = re.compile("|".join(re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values()) or "(?!)")

    def _suffix(self) -> str:
        return getattr(self.lib.model, "end_of_word_suffix", None) or ""

    def _of_piece(self, piece: str) -> bytes:
        ids = array(self.code, [t.id for t in self.model.tokenize(byte_level(piece))])
        if _SWAP:
            ids.byteswap()
        return ids.tobytes()

    def _of_text(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def split(self, text: str) -> list[str] | None:
        """The pieces in order, or None if only the library can split this text."""
        if _OTHER.search(text) or self.special.search(text):
            return None
        return self.pattern.findall(text.lower() if self.lower else text)

    def encode(self, text: str) -> bytes:
        pieces = self.split(text)
        if pieces is None:
            return self._of_text(text)
        if len(self.memo) > MEMO_PIECES:
            self.memo.age()
        return b"".join(map(self.memo.__getitem__, pieces))


_open: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One encoder a worker and file."""
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
