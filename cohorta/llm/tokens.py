"""Token ids of whole texts by a public tokenizer, fast enough for whole corpora.

``TextIds`` gives the ids that ``Tokenizer.encode(text, add_special_tokens=False)``
gives. Texts of ASCII and Latin-1 letters are cut at white space and each distinct
piece is tokenised once and remembered; any other text goes through ``encode`` whole.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

from cohorta.llm.common import kept, quiet_threads

#: The words of the vocabulary file that the shortcut below was checked against.
_LATIN = "a-zß-öø-ÿ"
_PLAIN = re.compile("[\t\n\x0b\x0c\r -~À-ÖØ-öø-ÿ]*").fullmatch
_PIECES = re.compile(rf"[{_LATIN}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9ß-öø-ÿ]+").findall


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read_tokenizer(path: str | None = None) -> str:
    """The tokenizer's file as a string of fixed size, to be sent to the executors."""
    with open(path or default_tokenizer(), encoding="utf-8") as f:
        return f.read()


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each UTF-8 byte as a printable letter."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    letter = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


class _Pieces(dict):
    """Ids of pieces of text, worked out once; the least recent half is dropped in turn."""

    #: Pieces remembered, some 50 MB; twice as many before the older half goes.
    HALF = 250_000

    def __init__(self, model, dtype):
        super().__init__()
        self.model, self.letters, self.old = model, _byte_letters(), {}
        self.form = "<%d" + dtype.char

    def word(self, w: str) -> bytes:
        """The ids of a run of letters, a digit or a run of signs."""
        ids = self.get(w) or self.old.get(w)
        if ids is None:
            plain = w if w.isascii() else w.translate(self.letters)
            tokens = [t.id for t in self.model.tokenize(plain)]
            ids = struct.pack(self.form % len(tokens), *tokens)
        self[w] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            if chunk.isalpha():
                return self.word(chunk)
            ids = b"".join(map(self.word, _PIECES(chunk)))
        self[chunk] = ids
        return ids

    def turn(self) -> None:
        if len(self) > self.HALF:
            self.old = dict(self)
            self.clear()


class TextIds:
    """Ids as little-endian bytes of ``self.dtype``: 2 bytes an id where the vocabulary allows."""

    def __init__(self, spec: str):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces = _Pieces(self.tokenizer.model, self.dtype)
        kind = json.loads(spec)
        split = json.dumps(kind.get("pre_tokenizer"))
        self.short = "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in split and [x["type"] for x in (kind.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]

    def __call__(self, text: str) -> bytes:
        """Null and empty texts have no ids."""
        if not text:
            return b""
        if not (self.short and _PLAIN(text) and "<|" not in text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        self.pieces.turn()
        return b"".join(map(self.pieces.__getitem__, text.lower().split()))


def text_ids(spec: str) -> TextIds:
    """One per Python worker and tokenizer, so its memory of pieces outlives a task."""
    return kept(("tokens", spec), lambda: TextIds(spec))
