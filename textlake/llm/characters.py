"""Characters that libraries with different Unicode versions treat alike."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

#: Characters beyond the second supplementary plane's letters are unsettled.
LAST = 0x2FFFF


@lru_cache(maxsize=2)
def unsettled(normalizing: bool) -> Callable[[str], re.Match | None]:
    """A search for a character that is not settled: one that Unicode 3.2 had in its present category is. With
    `normalizing`, marks and conjoining letters, which normal forms reorder or compose, are unsettled as well."""
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category

    def settled(c: str) -> bool:
        kind = new(c)
        return old(c) == kind != "Cn" and not (normalizing and (kind[0] == "M" or "ᄀ" <= c <= "ᇿ"))

    spans: list[list[int]] = []
    for at in range(LAST + 1):
        if 0xD800 <= at < 0xE000 or not settled(chr(at)):
            continue
        if spans and spans[-1][1] == at - 1:
            spans[-1][1] = at
        else:
            spans.append([at, at])
    return re.compile("[^" + "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in spans) + "]").search
