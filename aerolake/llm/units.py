"""Cut a text where byte-level BPE patterns always cut, so that each unit can be encoded on its own and remembered."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable

#: White space and controls besides the single space and newline; texts that hold one are not cut here.
_OTHER = re.compile("[\x00\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    　]")


def cut(text: str) -> list[str] | None:
    """Words with the space before them, and newlines; None if the text has other white space or runs of it.

    The public patterns put one space in front of the word that follows and let no match reach over a space or newline
    otherwise, except in runs of white space.
    """
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _OTHER.search(text):
        return None
    units = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
    return units if "" not in units else [u for u in units if u]


#: Bytes that a key, its value and their place in a table take besides their own.
_ENTRY = 190


class Memo:
    """Packed results by string in two generations of ``limit`` bytes each: when the younger is full, the older goes.

    The limit bounds memory, not results; strings of more than ``longest`` characters are not kept. The ``HOT`` strings seen most
    often among the first ``COUNTED`` are looked up first, in a table small enough for the processor's cache.
    """

    HOT, COUNTED = 8000, 400_000

    def __init__(self, limit: int, longest: int = 64):
        self.limit, self.longest = limit, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.hot: dict[str, bytes] = {}
        self.counts: Counter[str] = Counter()
        self.left = self.COUNTED

    def _keep(self, key: str, value: bytes) -> None:
        if len(key) <= self.longest:
            self.young[key] = value
            self.held += _ENTRY + len(key) + len(value)

    def _count(self, keys: list[str]) -> None:
        self.counts.update(keys)
        self.left -= len(keys)
        if self.left <= 0:
            known = [(k, self.young.get(k)) for k, _ in self.counts.most_common(self.HOT)]
            self.hot = {str(k): bytes(v) for k, v in known if v}
            self.counts.clear()

    def many(self, keys: list[str], make: Callable[[list[str]], Iterable[bytes]]) -> list[bytes]:
        """The value of each key; ``make`` gives those of unknown keys."""
        if self.left > 0:
            self._count(keys)
        get, hot = self.young.get, self.hot.get
        found = [hot(k) or get(k) for k in keys]
        if None in found:
            at = [i for i, v in enumerate(found) if v is None]
            old, missing = self.old.get, {}
            for i in at:
                found[i] = value = old(keys[i])
                if value is None:
                    missing[keys[i]] = None
                elif keys[i] not in self.young:
                    self._keep(keys[i], value)
            if missing:
                names = list(missing)
                missing = dict(zip(names, make(names), strict=True))
                for k, v in missing.items():
                    self._keep(k, v)
                found = [missing[k] if v is None else v for k, v in zip(keys, found, strict=True)]
            if self.held >= self.limit:
                self.old, self.young, self.held = self.young, {}, 0
        return found
