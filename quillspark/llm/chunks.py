"""Exact splitting of texts at places where no pre-token of a tokenizer can span.

Encoding the chunks one by one then gives what encoding the whole text gives,
and as texts repeat their chunks, a table of chunks saves most of the work.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

# Above U+024F, and at U+0130, lower-casing, normal forms and character classes differ between libraries.
_EXOTIC = re.compile("[^\x00-įı-ɏ]").search
_ODD_SPACE = re.compile("[\x1c-\x1f]").search
_SPACES = re.compile(r"\s \s|\s $|^ ").search
_BEFORE_WORD = re.compile(r"(?= \S)").split

#: Chunks that one worker keeps; at this many it starts anew, so that its memory stays bounded.
CACHE = 250_000
#: Characters of a chunk that is kept at most; longer ones are looked up anew each time, which bounds a table's bytes too.
LONGEST = 64


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Table(dict):
    """Value of each chunk, made at the first look-up and kept unless the chunk is long. ``fixed`` entries survive a restart."""

    def __init__(self, make: Callable, fixed: dict | None = None, most: int = CACHE):
        super().__init__(fixed or {})
        self.make, self.fixed, self.most = make, fixed or {}, most

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        if len(self) >= self.most + len(self.fixed):
            self.clear()
            self.update(self.fixed)
        self[key] = value = self.make(key)
        return value


def spaced_chunks(text: str) -> list[str] | None:
    """Chunks for byte-level pre-tokens (a word takes the one space before it), or None where the whole text must be encoded.

    A pre-token boundary stands before every space that a non-space follows:
    a run of white space gives up its last character to what follows.
    """
    if "<|" in text or _ODD_SPACE(text):
        return None
    if _SPACES(text):
        return _BEFORE_WORD(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


def worded_chunks(text: str) -> list[str] | None:
    """Chunks for lower-casing pre-tokens that hold no white space, or None where the whole text must be encoded."""
    if "<|" in text or not text.isascii() and _EXOTIC(text) or _ODD_SPACE(text):
        return None
    return text.lower().split()
