"""Token ids of whole texts by a public tokenizer file (``tokenizers`` library).

A word-level tokenizer of the kind of ``word_bpe_49k.json`` never joins what
white space parts, so a text's ids are its words' ids one after the other, and
a word met before costs one look-up.  Words are looked up as UTF-8 between ASCII
white space; a new word is cut into pieces as the file's own rules do, and the
library's model encodes each piece.  Whatever is out of the plain case (special
tokens' strings, characters beyond Latin, a file with other rules) goes through
the library's ``encode`` unchanged.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
import regex

#: The split pattern and normalizer kinds of the files for which words can be encoded alone.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_LATIN = regex.compile(_PATTERN)
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,]*)")
#: Words of these characters only are normalized by lower case alone.
_PRINTABLE = re.compile("[!-~¡-\u024f]+")
#: Words and pieces remembered by a Python worker.
REMEMBERED = 600_000


def default_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """A dict that makes a missing value from its key."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        got = self[key] = self.make(key)
        return got


class Encoder:
    """``ids(text)``: a whole text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        norm = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        pre = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (norm == _NORMALIZERS and [x["type"] for x in pre] == ["Split", "ByteLevel"]
                        and pre[0]["pattern"].get("Regex") == _PATTERN and not pre[1]["use_regex"])
        self.special = tuple(x["content"].encode()[:2] for x in rules.get("added_tokens", []))
        self.remembered = remembered
        self.words = _Memo(self._word)
        self.pieces: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) >= self.remembered // 2:
                self.pieces.clear()
            mapped = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            ids = [t.id for t in self.tokenizer.model.tokenize(mapped)]
            got = self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def _word(self, word: bytes) -> bytes:
        """Ids of one word without white space."""
        text = word.decode("utf-8", "replace")
        low = text.lower()
        plain = _PLAIN.fullmatch(low)
        if plain:  # letters, then full stops or commas
            letters, ending = plain.groups()
            return self._piece(letters) + self._piece(ending) if ending else self._piece(letters)
        if _PRINTABLE.fullmatch(text) and not any(s in word for s in self.special):
            return b"".join(map(self._piece, _LATIN.findall(low)))
        return self._whole(text)

    def ids(self, text: bytes) -> bytes:
        if not self.by_word:
            return self._whole(text.decode("utf-8", "replace"))
        # case does not count, but for the special tokens' strings
        words = (text if any(s in text for s in self.special) else text.lower()).split()
        if len(self.words) >= self.remembered:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file, kept between its tasks."""
    return Encoder(path)
