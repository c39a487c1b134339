"""Texts cut into units whose tokens don't depend on their neighbours, so that the tokens of each unit can be kept.

For the byte-level pattern, a single space or line feed between two characters that aren't white space always starts a
match: a space joins the match that follows it, a line feed is a match of its own. Texts with any other white space
take the slow path, over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: What may be white space for any of the libraries; Python's own class has a few more characters.
_BLANK = re.compile(r"\s")


def cut(text: str) -> list[str]:
    """Units of a text without NUL; whether each is regular is for is_regular to say."""
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


def long_parts(text: str, size: int = 1 << 22) -> Iterator[str]:
    """A long text in parts of about so many characters, cut before single spaces between other characters: tokens stay the same."""
    start = 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and (at + 1 == len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:] if start else text


def is_regular(unit: str) -> bool:
    """A line feed, or an optional space and then characters of which none is white space."""
    if unit == "\n":
        return True
    rest = unit[1:] if unit[:1] == " " else unit
    return bool(rest) and not _BLANK.search(rest)


def words(text: str) -> list[str]:
    """Units for tokenizers that drop white space: spaces and line feeds never join what stands beside them."""
    return text.replace("\n", " ").split(" ")
