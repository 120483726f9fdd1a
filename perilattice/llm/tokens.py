"""Exact tokenisation with a public tokenizer file, by white-space chunk with a bounded memo."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: Chunks that a worker remembers, of ENTRY bytes each on average; the memo never holds more bytes than that. Longer chunks than LONGEST aren't kept.
MEMO, ENTRY, LONGEST = 400_000, 200, 256
#: Fixed values of the tokenizer file: the pattern that cuts pieces.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks of printable ASCII and precomposed Latin-1 letters, and SPLIT for their lower-cased form.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Byte-level alphabet: bytes that are printable in Latin-1 stand for themselves, the others follow from code point 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
_STATE: dict[tuple[str, int], "Encoder"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """Token ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    With the normaliser and the pattern of word_bpe_49k, whose pieces never span white space, the text is cut at
    space, tab, line feed and carriage return, and the ids of its chunks are joined. A chunk is encoded once while the
    memo holds it: plain ones by piece through the model, others by the whole pipeline. Any other tokenizer gets each text whole.
    A piece is remembered as the chunk that it would be alone. The memo has two halves: once the new one is full it
    becomes the old one, whose chunks move back when they are met, so frequent ones stay.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        super().__init__()
        self.most, self.held, self.old = memo * ENTRY // 2, 0, {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        # chunks hold for this normaliser and this pattern only
        spec = json.loads(self.tokenizer.to_str())
        self.plain = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and SPLIT in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")

    def encode(self, text: str | None) -> np.ndarray:
        if not self.plain:
            return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")
        chunks = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return np.frombuffer(b"".join(map(self.__getitem__, chunks)), "<u4")

    def __missing__(self, chunk: str) -> bytes:
        out = self.old.pop(chunk, None)
        if out is None:
            if PLAIN.fullmatch(chunk) and "<|" not in chunk:
                pieces = PIECE.findall(chunk.lower())
                out = b"".join(map(self.__getitem__, pieces)) if pieces != [chunk] else self.piece(chunk)
            else:
                out = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= LONGEST:
            if self.held > self.most:
                self.old = self.copy()
                self.clear()
                self.held = 0
            self[chunk] = out
            self.held += 120 + len(chunk) + len(out)
        return out

    def piece(self, piece: str) -> bytes:
        known = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_CHARS)
        return array("I", [t.id for t in self.tokenize(known)]).tobytes()

    def forget(self) -> None:
        """Empty the memo, so that an idle worker holds the tokenizer only."""
        self.old = {}
        self.clear()
        self.held = 0


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """The worker's encoder for a file and a memo's size; kept between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, memo) not in _STATE:
        _STATE[path, memo] = Encoder(path, memo)
    return _STATE[path, memo]
