"""Token ids of a word-based public tokenizer, word by word."""

from __future__ import annotations

import re
from array import array

from tokenizers import Tokenizer

#: Words whose ids are kept at once; the length up to which they stay when the others go; the length up to
#: which a word is kept together with the marks after it.
KEPT, SHORT, WITH_MARKS = 250_000, 6, 12
#: Letters that stay single letters in composed form and in lower case.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿŒœ]+")
#: Marks that form a piece of their own after a letter or digit, whatever stands before.
MARKS = b".,!?;:|*%$&#"


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stays, the rest moves up from 256."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(stays)]
    return {b: chr(256 + i) for i, b in enumerate(moved)}


class WordIds:
    """Ids (little-endian 32-bit, as bytes) of texts, equal to those of the whole text.

    The tokenizer splits at white space and never merges across it, so each word is encoded on its own and kept.
    Plain words skip the tokenizer's normaliser, which would leave them as they are; all others go through it.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known: dict[bytes, bytes] = {}

    def _piece(self, word: bytes) -> bytes:
        """A run of letters, or any other word."""
        if word.isalpha():  # ASCII letters only, as these are bytes
            tokens = self.model.tokenize(word.lower().decode())
        elif not word.isascii() and PLAIN.fullmatch(text := word.decode("utf-8")):
            low = text.lower().encode()
            tokens = self.model.tokenize(low.decode("latin-1").translate(self.letters))
        else:
            ids = self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids
            return array("I", ids).tobytes()
        return array("I", [t.id for t in tokens]).tobytes()

    def _splits_before_marks(self, stem: bytes) -> bool:
        """The stem ends in a letter or digit that stays one in lower case, so marks after it are their own piece."""
        if stem.isalnum():
            return True
        last = stem[-4:].decode("utf-8", "ignore")[-1:] if stem and stem[-1] > 127 else ""
        return bool(last) and "\xbf" < last < "ɐ" and last not in "×÷İ"

    def _word(self, word: bytes) -> bytes:
        known = self.known
        if len(known) >= KEPT:  # short words are the frequent ones
            short = {w: i for w, i in known.items() if len(w) <= SHORT}
            known.clear()
            known.update(short)
        stem = word.rstrip(MARKS)
        if len(stem) < len(word) and self._splits_before_marks(stem):
            parts = []
            for piece in (stem, word[len(stem) :]):
                ids = known.get(piece)
                if ids is None:
                    ids = known[piece] = self._piece(piece)
                parts.append(ids)
            ids = b"".join(parts)
            if len(word) <= WITH_MARKS:
                known[word] = ids
        else:
            ids = known[word] = self._piece(word)
        return ids

    def ids(self, text: bytes) -> bytes:
        get, miss = self.known.get, self._word
        return b"".join([get(w) or miss(w) for w in text.split()])
