"""Exact token ids of the public byte-level tokenizers, with a bounded cache of pre-tokens.

The library's ``encode`` spends nearly all its time on pre-tokens that it has met
before. Here a text is cut into pre-tokens, and each distinct one is encoded by the
library once while it stays in the cache. The cut itself uses ``re`` where every
character of the text lies in blocks on which ``re`` and the library agree about
letters, digits and white space; any other text is cut by the library's own pre-tokenizer, which is
slower. So the ids are the library's own in every case, and none is made twice.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

#: Characters on which Python's classes equal the library's: ASCII, Latin, Cyrillic, common
#: punctuation, kana, CJK and Hangul. Superscript digits, fractions, unusual controls and
#: combining marks are left out.
_OUTSIDE = re.compile(
    "[^\\x09-\\x0d\\x20-\\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏЀ-ҁҊ-ԯ"
    "‐-‧‰-⁞₠-₿、。ぁ-ゖァ-ヺ一-龥가-힣]"
)
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ɏЀ-ҁҊ-ԯぁ-ゖァ-ヺ一-龥가-힣"
#: How the two files cut a text, with the letters and digits of the blocks above.
_BYTE_CUT = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")
_WORD_CUT = re.compile(rf"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s0-9{_LETTER}]+")
#: Entries that a worker keeps; the cache starts anew beyond it, so its memory is bounded.
CACHE_ENTRIES = 800_000
#: Longer pre-tokens are encoded each time, so that entries stay small.
CACHE_LENGTH = 64


def _byte_letters() -> list[str]:
    """The letter that stands for each byte inside byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others, in order, for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


_LETTERS = dict(enumerate(_byte_letters()))
_BYTES_OF = {c: chr(b) for b, c in _LETTERS.items()}


def _letters(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_LETTERS)


class _Cache(dict):
    """Pre-token to the bytes of its ids (little-endian, 32 bits)."""

    def __init__(self, model):
        super().__init__()
        self._tokenize = model.tokenize

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", [t.id for t in self._tokenize(_letters(piece))]).tobytes()
        if len(piece) <= CACHE_LENGTH:
            self[piece] = ids
        return ids


class PieceTokenizer:
    """One of the two ``.json`` tokenizers; ``kind`` is told from the file itself."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.lowers = self.library.normalizer is not None
        self._cut = (_WORD_CUT if self.lowers else _BYTE_CUT).findall
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self._specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        self._cache = _Cache(self.library.model)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        lower = text.lower() if self.lowers else text
        # some capitals have their small letter in another block
        if _OUTSIDE.search(text) or (self.lowers and _OUTSIDE.search(lower)):
            if self.lowers:
                text = self.library.normalizer.normalize_str(text)
            return ["".join(map(_BYTES_OF.__getitem__, x)).encode("latin-1").decode() for x, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self._cut(lower)

    def spans(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings, which the library takes as single ids by default."""
        if "<|" not in text:
            return [(text, False)]
        return [(x, x in self.special) for x in self._specials.split(text) if x]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, without added special tokens."""
        if len(self._cache) > CACHE_ENTRIES:
            self._cache.clear()
        out = []
        for part, special in self.spans(text):
            if special:
                out.append(array("I", [self.special[part]]).tobytes())
            else:
                out.extend(map(self._cache.__getitem__, self.pieces(part)))
        return b"".join(out)

    def count(self, piece: str) -> int:
        """Ids of one pre-token, as ``pieces`` gives it."""
        return len(self.library.model.tokenize(_letters(piece)))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer for each Python worker."""
    return PieceTokenizer(path)
