"""Cutting a text where byte-level BPE patterns of this family always cut: before a space and around white space."""

from __future__ import annotations

import re

#: The white space of Unicode, which is what \\s means in the tokenizers' pattern (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_UNEVEN = re.compile(rf" [{WHITE}]|[{WHITE}] |^[{WHITE}]|[{WHITE}]$")
_RARE = re.compile(f"[{WHITE.replace(' ', '').replace(chr(10), '')}]")


def _uneven(text: str) -> bool:
    """Whether a space stands next to other white space, or white space at either end."""
    if _RARE.search(text):
        return _UNEVEN.search(text) is not None
    return "  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"


def chunks(text: str) -> list[str]:
    """Pieces of the text, in order, that no token of the pattern crosses; each may be tokenised by itself.

    A text without a space next to other white space is cut at its spaces, which is quicker and gives larger pieces."""
    if not text:
        return []
    if _uneven(text):
        return _CHUNK.findall(text)
    return text.replace(" ", "\0 ").split("\0") if "\0" not in text else _CHUNK.findall(text)


class Recent:
    """A bounded memory of strings: what has not been asked for during two fills is forgotten. get() is the young
    half's; find() looks in both and brings back what it finds."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def find(self, key: str):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value
