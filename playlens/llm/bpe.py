"""Cutting texts into pieces that a byte-level BPE tokenizer treats one by one.

The pre-tokenizer of the vocabulary never lets a token start before a blank and end behind
it, unless the blank belongs to a longer run of white space. So a text may be cut in front
of every single blank between two visible characters, and equal pieces need their tokens
computed only once.
"""

from __future__ import annotations

import re

_RUN = re.compile(r"\s ")


def pieces(text: str) -> list[str]:
    """Keys of the pieces of `text`, in order; `piece(key)` gives each back.

    A piece that is one blank and what follows has as its key what follows, so that cutting
    is a plain split. Any other piece has itself and a blank as its key.
    """
    parts = text.split(" ")
    if not _RUN.search(text):
        parts[0] += " "
        return parts
    merged = [parts[0]]
    for part in (" " + p for p in parts[1:]):
        # What is white space, or comes behind white space, stays with what is before it.
        if len(part) == 1 or part[1].isspace() or merged[-1][-1:].isspace():
            merged[-1] += part
        else:
            merged.append(part)
    return [part + " " for part in merged]


def piece(key: str) -> str:
    """The piece of a key from `pieces`."""
    return key[:-1] if key.endswith(" ") else " " + key


class Recent(dict):
    """A memory for what `compute` gives for keys; it holds `limit` of them at most.

    `compute` takes a list of keys and returns as many values. When `limit` would be passed,
    all is forgotten and starts anew.
    """

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def learn(self, groups: list[list[str]]) -> None:
        """Make sure that the keys of all `groups` are present until the next call."""
        missing = set().union(*groups).difference(self.keys())
        if len(self) + len(missing) > self.limit:
            self.clear()
            missing = set().union(*groups)
        new = sorted(missing)
        if new:
            self.update(zip(new, self.compute(new)))
