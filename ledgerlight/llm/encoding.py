"""Byte-level BPE ids of many texts.

Latin text is encoded by tiktoken from the vocabulary's own file (its ids are in merge order, so
they serve as ranks), which is four times as fast as the tokenizers library and gives the same
ids.  Words with other characters go to the tokenizers library itself, whose tables of letters and
spaces may differ there.  The pre-tokeniser never joins a character that is not white space with
white space after it, so a text may be cut before a run of white space and its parts encoded apart.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import groupby

#: The pre-tokeniser's pattern; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER = re.compile("[^\x00-ɏ]")
_UNITS = re.compile(r"(?<=\S)(?=[ \n])")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Encoder:
    """``plain``: strings of special tokens inside a text are ordinary text."""

    def __init__(self, path: str, plain: bool = False) -> None:
        self.path, self.plain, self.library = path, plain, None

    def __getstate__(self):
        return {"path": self.path, "plain": self.plain, "library": None}

    def open(self) -> Encoder:
        if self.library is not None:
            return self
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(self.path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = self.plain
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.special = [] if self.plain else sorted(added)
        with open(self.path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = byte_letters()
        ranks = {bytes(map(letters.get, t)): i for t, i in vocabulary.items() if t not in added}
        self.latin = tiktoken.Encoding("latin", pat_str=PATTERN, special_tokens={}, mergeable_ranks=ranks)
        self.pieces = {i: t for t, i in ranks.items()}
        return self

    def encode(self, text: str) -> array:
        """The ids of a text as unsigned 32-bit integers."""
        self.open()
        if self.special and any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids)
        if not _OTHER.search(text):
            return array("I", self.latin.encode_ordinary(text))
        ids = array("I")
        for other, units in groupby(_UNITS.split(text), lambda unit: bool(_OTHER.search(unit))):
            part = "".join(units)
            ids.extend(
                self.library.encode(part, add_special_tokens=False).ids if other
                else self.latin.encode_ordinary(part)
            )
        return ids

    def decode(self, ids) -> str:
        """The text that plain encoding turned into ``ids``."""
        self.open()
        return b"".join([self.pieces[i] for i in ids]).decode("utf-8")
