"""Cutting text for byte-level BPE.

No match of the pre-token pattern crosses from a non-space to a space: all its
alternatives take white space at their start or consist of it.  A *unit*, that
is a run of white space and the run of non-space after it, is therefore cut
into the same pre-tokens wherever it stands, and can be looked up whole.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import regex

# The characters of Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """The pre-token pattern, with white space as the property has it."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
