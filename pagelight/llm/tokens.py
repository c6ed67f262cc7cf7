"""Token ids of texts from a public tokenizer file, fast enough for a whole corpus.

The word-level vocabulary drops white space and never joins text across it, so a text's ids are
those of its pieces between ASCII spaces and line feeds, in order; A-Z count as a-z. Each distinct
piece is encoded once by the tokenizers library and then looked up.
"""

from __future__ import annotations

import array
import codecs
import functools
import os
import re

from .common import claim

CACHE = 600_000  # distinct pieces that a worker keeps, about 130 MB; then it starts anew


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters a-z and Latin-1 in lower case; ASCII marks without an apostrophe.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


class _Pieces(dict):
    """Piece (bytes, A-Z as a-z) -> its ids as little-endian unsigned 32-bit integers.

    A piece that is one run of letters, or such a run and a run of marks, is one or two of the
    vocabulary's words for sure; those go to its model directly. All others take the whole tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, {}
        self.model = tokenizer.model
        # byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.alphabet = "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))
        self.direct = self._checked()

    def _checked(self) -> bool:
        """Whether the model's own answers are the tokenizer's, for this vocabulary."""
        probes = ["the", "erheation", "éeauxç", "über", "ßä", ".", "...", "!!", "%%%", "$#@", "ÿþ", "zzzzqxj"]
        return all(self._of(x.encode()) == self._whole(x) for x in probes)

    def _whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _of(self, word: bytes) -> bytes:
        """Ids of a word that is in the vocabulary's alphabet."""
        text = word.decode() if word.isascii() else codecs.charmap_decode(word, "strict", self.alphabet)[0]
        found = self.words[word] = array.array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return found

    def clear(self) -> None:
        super().clear()
        self.words.clear()

    def __missing__(self, piece: bytes) -> bytes:
        word = piece.rstrip(_MARKS)
        marks, plain = piece[len(word) :], self.direct and word.isalpha()  # of ASCII letters
        if self.direct and not plain and not word.isascii():
            text = word.decode().lower()
            if _LETTERS.fullmatch(text):
                plain, word = True, text.encode()
        if not plain:
            found = self._whole(piece.decode())
        else:
            found = self.words.get(word) or self._of(word)
            if marks:
                found += self.words.get(marks) or self._of(marks)
        self[piece] = found
        return found


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.seen = _Pieces(self.tokenizer)

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: none) as little-endian unsigned 32-bit integers."""
        if len(self.seen) > CACHE:
            self.seen.clear()
        out, of = [], self.seen.__getitem__
        for t in texts:
            raw = (t or "").encode()
            if b"<|" in raw:  # it may name a special token, which counts in lower case only
                out.append(self.whole(t))
            else:
                out.append(b"".join(map(of, raw.lower().replace(b"\n", b" ").split(b" "))))
        return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    claim("tokens", _encoder.cache_clear)
    return _encoder(path)
