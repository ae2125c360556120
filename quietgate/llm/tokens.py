"""Token ids of whole texts by the ``tokenizers`` library, each distinct piece of text encoded once.

Encoding a text whole spends most of its time on words seen many times before.  A text is therefore cut where the
tokenizer always cuts, at a single white-space character between two others, and the ids of known pieces are looked up.
New pieces of Latin letters go through the tokenizer's own split pattern and its BPE model; all other pieces, texts with
other white space, and tokenizers of another build go through its whole pipeline.  Equality is tested.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from quietgate.llm.common import give_back

_KNOWN_PIECES = 200_000  # remembered per worker in each of three tables, about 40 MB
_NOT_LATIN = re.compile("[^\x00-ɏ]|İ")
_loaded: dict[str, Coder] = {}


def vocabulary(name: str) -> str:
    """Place of an installed vocabulary file."""
    return public_tokenizers.path(name)


def _printable_bytes() -> list[str]:
    """One visible character for every byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    out, spare = [], 0x100
    for b in range(256):
        shown = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF
        out.append(chr(b if shown else spare))
        spare += not shown
    return out


class _Known(dict):
    """Ids of pieces after a space, or their line feed; what is not known is looked up in the table before, or made."""

    def __init__(self, coder: Coder, before: dict[str, bytes]):
        super().__init__()
        self.coder, self.before = coder, before

    def __missing__(self, piece: str) -> bytes:
        made = self.before.get(piece)
        if made is None:
            made = self.coder.after_space(piece)
        if len(piece) < 64:
            self[piece] = made
        return made


class Coder:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known = _Known(self, {})
        self.tokens: dict[str, bytes] = {}
        self.visible = dict(enumerate(_printable_bytes()))
        self.lower, self.split = self._plan(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def of(path: str) -> Coder:
        """One coder per worker process and vocabulary."""
        if path not in _loaded:
            _loaded[path] = Coder(path)
        return _loaded[path]

    def forget(self) -> None:
        """Workers live on between tasks and should not keep a task's memory."""
        self.known = _Known(self, {})
        self.tokens.clear()
        give_back()

    @staticmethod
    def _plan(spec: dict):
        """Whether letters are lowered, and the split pattern; no pattern for a tokenizer of another build."""
        norm, pre = spec["normalizer"], spec["pre_tokenizer"]
        steps = [s["type"] for s in norm["normalizers"]] if norm and norm["type"] == "Sequence" else [norm["type"]] if norm else []
        parts = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
        plain = not any(p.get("add_prefix_space") for p in parts) and parts[-1]["type"] == "ByteLevel"
        if plain and len(parts) == 1 and parts[0]["use_regex"] and not steps:
            return False, regex.compile(public_tokenizers.PATTERN)
        if plain and len(parts) == 2 and parts[0].get("invert") and not parts[1]["use_regex"] and steps == ["NFC", "Replace", "Lowercase"]:
            return True, regex.compile(parts[0]["pattern"]["Regex"])
        return False, None

    def _token(self, token: str) -> bytes:
        """Ids of one pre-token of Latin letters, digits or signs."""
        if (made := self.tokens.get(token)) is None:
            shown = token.encode().decode("latin-1").translate(self.visible)
            made = self.tokens[token] = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        return made

    def _plain(self, letters: str) -> bytes:
        """Ids of ASCII letters after a space; in a vocabulary they are their own bytes."""
        shown = letters.lower() if self.lower else "\u0120" + letters
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def after_space(self, piece: str) -> bytes:
        """Ids of a piece and the space before it, or the line feed it starts with."""
        if self.split is not None and len(piece) <= 1000 and piece.isascii():
            if piece.isalpha():
                return self._plain(piece)
            if piece[-1] in ",." and (letters := piece[:-1]).isalpha():
                return self.known[letters] + self._token(piece[-1])
            if piece[0] == "\n" and (letters := piece[1:]).isalpha():  # a line feed before letters stands alone
                return self._token(letters.lower()) if self.lower else self._token("\n") + self._token(letters)
        made = self._piece(piece, "" if piece[0] == "\n" else " ")
        return self._whole([piece if piece[0] == "\n" else " " + piece])[0] if made is None else made

    def _piece(self, piece: str, space: str) -> bytes | None:
        """Ids of a piece and the space before it, or None where only the whole pipeline knows."""
        if self.split is None or len(piece) > 1000 or not piece.isascii() and _NOT_LATIN.search(piece):
            return None
        if self.lower:
            piece, space = piece.lower(), ""
        if piece.isalpha():
            return self._token(space + piece)
        return b"".join(map(self._token, self.split.findall(space + piece)))

    def _whole(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(m.ids, "<u4").tobytes() for m in made]

    @staticmethod
    def _cut(text: str | None) -> list[str] | None:
        """Pieces, each after a space but for the first one and those that start with their line feed.

        None for a text with white space other than single spaces and line feeds between words.
        """
        if not text:
            return []
        words, gaps = text.split(), text.count(" ") + text.count("\n")
        if len(words) != gaps + 1 or len("".join(words)) != len(text) - gaps:
            return None
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text; a null text has none."""
        if len(self.known) > _KNOWN_PIECES:  # pieces in use go over to the next table when they are met again
            self.known.before = {}
            self.known = _Known(self, self.known)
        if len(self.tokens) > _KNOWN_PIECES:
            self.tokens.clear()
        cut = [self._cut(t) for t in texts]
        odd = [i for i, c in enumerate(cut) if c is None]
        out: list[bytes] = [b""] * len(texts)
        for at in range(0, len(odd), 256):
            for i, made in zip(odd[at:at + 256], self._whole([texts[i] for i in odd[at:at + 256]])):
                out[i] = made
        find = self.known.__getitem__
        for i, pieces in enumerate(cut):
            if pieces:
                first = self._piece(pieces[0], "")
                out[i] = b"".join([self._whole(pieces[:1])[0] if first is None else first, *map(find, pieces[1:])])
        return out
