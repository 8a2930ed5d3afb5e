"""Token ids of whole texts by the tokenizers library, with a memo of the pieces between spaces.

For two families of tokenizers a text may be cut at single spaces and the pieces encoded one by one:
byte-level BPE that splits with its built-in pattern (a space starts a piece), and BPE over
lower-cased words that drops white space (that one is cut at newlines too, which are dropped as well;
plain Latin texts are cut into its words at once).  Frequent pieces are then looked up.  A missing piece
goes to the library: plain Latin pieces straight to its BPE model, all others through its whole chain; a
word before punctuation is looked up by itself.  Texts with runs of white space that matter, and other
tokenizers, are encoded whole.

The ids are those of the library's plain call on the file with ``add_special_tokens=False``: where a
special token's string stands in a text, the text has its id, and is encoded whole.  With
``specials_as_text`` such strings are ordinary text.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable

import numpy as np
import regex
from tokenizers import Tokenizer

from threatlake.llm.common import kept

MEMO_PIECES = 600_000
MEMO_TOKENS = 100_000
_LONG = 64

# Fixed value: the public pattern that byte-level BPE splits text with.
_BYTE_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# Letters whose normal form and lower case are the same for every library.
_PLAIN = regex.compile("[\n\x20-\x7eÀ-ÿ]*")
# Fixed value: the pattern that the BPE over words splits with, and the same for lower-case plain text.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\na-zß-öø-ÿ0-9 ]+").findall
# Plain texts as Latin-1 bytes: what is left of one without letters and white space, and all of one with
# its letters as "a", its digits and white space as " " and every other mark as ".".
_LETTERS = bytes(b for b in range(256) if chr(b).isalpha() and (b < 0x80 or b >= 0xC0))
_PLAIN_SPACE = b" \n"
_MARK_CLASSES = bytes(
    97 if b in _LETTERS else 32 if b in _PLAIN_SPACE or b in b"0123456789" else 46 for b in range(256)
)
_NOT_EASY = bytes(b for b in range(256) if not (0x20 <= b <= 0x7E or b in (0xD7, 0xF7)) or b == 0x27)
_EASY_MARKS = 6
# What either pattern takes as one match of its own after letters; an apostrophe may start a contraction.
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_symbols() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in kept}
    others = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + i) for i, b in enumerate(others)}


class _Memo(dict):
    """Values by key, computed when missing; starts anew when full and keeps no long keys."""

    def __init__(self, compute: Callable[[str], bytes], limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key: str) -> bytes:
        value = self.compute(key)
        if len(key) <= _LONG:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def _plain_words(text: str) -> list[str] | None:
    """The lower-case words of a plain text; None if it is not plain.

    Where every mark is a match of its own (no two side by side, no apostrophe), spaces around the marks
    and one split give the matches of the pattern.
    """
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    marks = set(raw.translate(None, _LETTERS + _PLAIN_SPACE))
    hard = marks.intersection(_NOT_EASY)
    if hard and hard != {0x27}:
        return None
    text = text.lower()
    if hard or len(marks) > _EASY_MARKS or b".." in raw.translate(_MARK_CLASSES):
        return _PLAIN_WORDS(text)
    for mark in map(chr, marks):
        text = text.replace(mark, f" {mark} ")
    return text.split()


class _SpaceMatters(Exception):
    """A piece cannot be encoded without its neighbours."""


class TextEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES, specials_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self._specials = [t.content for t in added if not (specials_as_text and t.special)]
        largest = max(self.tokenizer.get_vocab().values(), default=0)
        self._packed = [struct.pack("<I", i) for i in range(largest + 1)]
        self._pieces = _Memo(self._piece, memo_pieces)
        self._tokenize = self.tokenizer.model.tokenize
        self._symbols = _byte_symbols()
        self._space = self._symbols[0x20]
        self._find, self._spaced, self._lower = self._family()
        self._words = self._lower and self._find.__self__.pattern == _WORD_PATTERN
        self._tokens = _Memo(self._token, memo_pieces if self._words else min(memo_pieces, MEMO_TOKENS))

    def _family(self):
        """Pattern, whether a space belongs to the piece after it, whether to lower-case."""
        spec = json.loads(self.tokenizer.to_str())
        if spec["model"]["type"] != "BPE":
            return None, False, False
        norm, pre = spec["normalizer"], spec["pre_tokenizer"] or {}
        if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return regex.compile(_BYTE_PATTERN).findall, True, False
        steps = [n["type"] for n in (norm or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]:
            if parts[0]["behavior"] == "Removed" and parts[0]["invert"]:
                return regex.compile(parts[0]["pattern"]["Regex"]).findall, False, True
        return None, False, False

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _bpe(self, symbols: str) -> bytes:
        packed = self._packed
        return b"".join([packed[t.id] for t in self._tokenize(symbols)])

    def _token(self, token: str) -> bytes:
        if token.isascii() and token.isalpha():
            return self._bpe(token)  # its bytes are their own symbols
        return self._bpe("".join(map(self._symbols.__getitem__, token.encode())))

    def _run(self, text: str) -> bytes:
        """Any text of which the pattern's matches can be taken alone."""
        if not _PLAIN.fullmatch(text):
            return self._whole(text)
        if self._lower:
            text = text.lower()
        return b"".join(map(self._tokens.__getitem__, self._find(text)))

    def _piece(self, piece: str) -> bytes:
        """What follows a space, up to the next."""
        word = piece.rstrip(_PUNCTUATION)
        if word.isalpha() and _PLAIN.fullmatch(word):
            if len(word) < len(piece):
                return self._pieces[word] + self._tokens[piece[len(word) :]]
            # One match of either pattern.
            if word.isascii() and self._spaced:
                return self._bpe(self._space + word)
            return self._token(" " + word if self._spaced else word.lower())
        if self._spaced and (not piece or piece[0].isspace() or piece[-1].isspace()):
            raise _SpaceMatters
        return self._run(" " + piece if self._spaced else piece)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self._find is None or any(s in text for s in self._specials):
            return self._whole(text)
        words = _plain_words(text) if self._words else None
        if words is not None:
            return b"".join(map(self._tokens.__getitem__, words))
        if self._lower:
            # White space only parts the pieces.
            return b"".join(map(self._pieces.__getitem__, text.replace("\n", " ").split(" ")))
        first, *pieces = text.split(" ")
        if not first or first[-1].isspace():
            return self._run(text)
        try:
            return self._run(first) + b"".join(map(self._pieces.__getitem__, pieces))
        except _SpaceMatters:
            return self._run(text)


def encoder(path: str) -> TextEncoder:
    """The encoder of a tokenizer file; a worker process keeps it, so that the memo lasts over tasks."""
    return kept(("encoder", path), lambda: TextEncoder(path))
