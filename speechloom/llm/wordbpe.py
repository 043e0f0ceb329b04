"""Token ids of texts, with a bounded per-worker memory of words already encoded.

The vocabulary file belongs to the `tokenizers` library and is loaded there; it is never trained.
Its pre-tokens never cross ASCII white space, and its normaliser works inside words, so the ids of a
text are the ids of its words in order. Words are normalised and split here only if the library treats each of
their characters likewise, which is asked once per character; the others go to the library. Natural text repeats its words, hence each worker keeps the
ids of words it has seen (emptied when full: memory is bounded, ids are not affected).
"""

from __future__ import annotations

import os
import re
import unicodedata

#: Words and pre-tokens kept by a worker, at about 200 bytes each.
MEMORY_WORDS = 450_000
#: Words of one text that are looked up together.
WORDS_AT_ONCE = 100_000
#: As the vocabulary file states its pre-tokens (a fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"



def byte_signs() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_SIGNS = byte_signs()
_workers: dict[str, WordEncoder] = {}


class WordEncoder:
    """encode(text bytes) -> little-endian unsigned 32-bit ids, as the tokenizer file defines them."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(PRE_TOKEN).findall
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or b"(?!)").search
        self.tokenize = self.tokenizer.model.tokenize
        self.ids = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.plain: dict[str, bool] = {}

    def _library(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _own(self, text: str) -> bytes:
        """Ids of a word by the vocabulary's model alone, with what is known of its pre-tokens."""
        pieces, ids, tokenize = self.pieces, self.ids, self.tokenize
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        out = b""
        for piece in (text,) if text.isalpha() else self.split(text):
            if (known := pieces.get(piece)) is None:
                known = b"".join([ids[t.id] for t in tokenize(piece.encode().decode("latin-1").translate(BYTE_SIGNS))])
                pieces[piece] = known
            out += known
        return out

    def _is_plain(self, sign: str) -> bool:
        """Whether the library treats a character alone and between letters as _own() does, and it composes with none."""
        known = self.plain.get(sign)
        if known is None:
            joins = unicodedata.combining(sign) or unicodedata.category(sign)[0] == "M" or unicodedata.name(sign, "").startswith("HANGUL J")
            known = not joins and all(self._library(t) == self._own(t) for t in (sign, f"a{sign}b", f"{sign}{sign}", f"1{sign}."))
            self.plain[sign] = known
        return known

    def _learn(self, words: set[bytes]) -> None:
        if len(self.words) + len(words) > MEMORY_WORDS:
            self.words.clear()
        if len(self.pieces) > MEMORY_WORDS:
            self.pieces.clear()
        for word in words:
            text = word.decode("utf-8", "replace")
            own = text.isascii() or all(self._is_plain(c) for c in set(text) if c > "\x7f")
            self.words[word] = self._own(text) if own else self._library(text)

    def encode(self, text: bytes) -> bytes:
        if self.special(text):  # special tokens are cut out of the text before anything else
            return self._library(text.decode("utf-8", "replace"))
        out = []
        words = text.split()
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            if new := set(part).difference(self.words):
                self._learn(new)
                if not self.words.keys() >= (missing := set(part)):  # the memory was emptied meanwhile
                    self._learn(missing.difference(self.words))
            out.append(b"".join([self.words[w] for w in part]))
        return b"".join(out)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of this file."""
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]
