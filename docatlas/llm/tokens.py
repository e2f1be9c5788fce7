"""Token ids of whole texts by a public tokenizer, with what words encode to kept in each worker."""

from __future__ import annotations

from array import array

import numpy as np

from . import common

VOCABULARY = "word_bpe_49k.json"
#: Pieces between blanks that a worker keeps in each of two generations.
KEPT = 500_000
#: Characters that end a piece as a token of their own if they follow a letter.
_ENDS = frozenset(",.;:!?|()")


class Pieces(dict):
    """Ids of pieces as bytes. A full generation becomes the old one, from which pieces in use come back."""

    def __init__(self, tok):
        super().__init__({"": b""})
        self.tok, self.model, self.old = tok, tok.model, {}
        self.code = "H" if tok.get_vocab_size() <= 65536 else "I"

    def __missing__(self, p: str) -> bytes:
        v = self.old.get(p)
        if v is None:
            if len(p) > 1 and p[-1] in _ENDS and p[-2].isalpha():
                v = self[p[:-1]] + self[p[-1]]
            elif p.isascii() and p.isalpha():
                v = array(self.code, [t.id for t in self.model.tokenize(p)]).tobytes()
            else:
                v = array(self.code, self.tok.encode(p, add_special_tokens=False).ids).tobytes()
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        self[p] = v
        return v


class Encoder:
    """Blanks never join two tokens here and leave none, so a text's ids are its pieces' ids in a row.

    Pieces are cut at space and newline only; the tokenizer itself handles whatever else they hold. The vocabulary
    is of lower case, so pieces are kept in lower case; texts with the two letters whose lower case depends on how
    it is made, or with special tokens, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kept = Pieces(self.tok)
        self.dtype = np.uint16 if self.kept.code == "H" else np.uint32

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if "\u03a3" in text or "\u0130" in text or "<|" in text:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)
        return np.frombuffer(b"".join(map(self.kept.__getitem__, text.lower().replace("\n", " ").split(" "))), self.dtype)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    common.keeping("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
