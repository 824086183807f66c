"""Texts cut into words as a tokenizer file with lower-casing and regex words does it.

The steps are those that the file names: NFC, white space to one space, lower case, and
words by the pattern below. White space ends every word, so texts are cut at white space
first and the pattern is only needed for cuts not met before.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import regex
from tokenizers import Tokenizer

# Fixed values of the tokenizer file: its word pattern, which decides every id.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# White space that str.split takes and the tokenizer doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def cuts(text: str) -> list[str]:
    """The normalised text cut at white space."""
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # each letter is lowered by itself, also at a word's end
        text = text.replace("Σ", "σ")
    text = text.lower()
    if SEPARATORS.search(text):
        return [c for c in SPACE.split(text) if c]
    return text.split()


def words(cut: str, library: Callable[[], Tokenizer]) -> list[str]:
    """The words of a cut. Letters newer than Python's tables are left to the library."""
    if cut.isalpha():
        return [cut]
    if cut[:-1].isalpha() and cut[-1] in ".,;:!?":
        return [cut[:-1], cut[-1]]
    if cut.isascii() or "Cn" not in map(unicodedata.category, cut):
        return WORD.findall(cut)
    cut = library().normalizer.normalize_str(cut)
    return [cut[a:b] for _, (a, b) in library().pre_tokenizer.pre_tokenize_str(cut)]
