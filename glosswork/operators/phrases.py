"""The progressive search in one page: all queries at once, each part of a page looked up once."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

Segment = tuple[int, int, int]


@lru_cache(1)
def _apart() -> dict[int, str]:
    """Characters whose lower case differs from that of others that a pattern takes for the same letter."""
    out = {}
    for c in range(128, 0x10000):
        one = chr(c)
        up = one.upper()
        low = up.lower() if len(up) == 1 else one.lower()
        if low != one.lower() and len(low) == 1:
            out[c] = low
    return out


def fold(text: str) -> str:
    """As many characters, equal wherever a pattern that ignores case takes them for equal."""
    # the lower case of one capital has two characters; a final sigma depends on what is before it
    return text.lower() if text.isascii() else text.replace("\u0130", "i").lower().translate(_apart())


class Phrase:
    """One query. chunk(i, k) is the form of its words i .. i + k without white space, and their pattern."""

    def __init__(self, words: list[str], kmax: int = 3, ignore_case: bool = True, max_gap: int = 200, min_words: int = 3):
        self.words, self.kmax, self.ignore_case, self.max_gap, self.min_words = words, max(1, kmax), ignore_case, max_gap, max(1, min_words)
        self.shapes = [fold(w) if ignore_case else w for w in words]
        # a word that normalizing emptied or parted is searched by its pattern alone
        self.plain = all(w and not any(c.isspace() for c in w) for w in words)
        self._patterns: dict[tuple[int, int], re.Pattern] = {}

    def pattern(self, i: int, k: int) -> re.Pattern:
        if (i, k) not in self._patterns:
            self._patterns[i, k] = re.compile(r"\s*".join(map(re.escape, self.words[i:i + k])), re.IGNORECASE if self.ignore_case else 0)
        return self._patterns[i, k]

    def widths(self, i: int) -> range:
        return range(min(self.kmax, len(self.words) - i), 0, -1)

    def candidates(self, page: Page) -> Iterator[list[Segment]]:
        """From each match of the first k0 words, longest k0 first: always the most words found next, words without a
        match skipped. A segment once taken is never given up, so a chain ends at its first wide gap."""
        if len(self.words) < self.min_words:
            return
        where = page.places(self)
        for k0 in self.widths(0):
            last = -1
            for start, end in where.all(0, k0):
                if start < last or start == last == end:
                    continue
                last = end
                segments = self._chain(where, start, end, k0)
                if segments:
                    yield segments

    def _chain(self, where, start: int, end: int, k0: int) -> list[Segment] | None:
        segments, i, at, covered = [(start, end, k0)], k0, end, k0
        while i < len(self.words):
            step = 1
            for k in where.present(i):
                hit = where.next(i, k, at)
                if hit:
                    if hit[0] - at > self.max_gap:
                        return None
                    segments.append((*hit, k))
                    at, covered, step = hit[1], covered + k, k
                    break
            i += step
        return segments if covered >= self.min_words else None


class Page:
    """A page's text, and where what has been looked for in it stands."""

    def __init__(self, text: str):
        self.text = text
        self._forms: dict[bool, tuple] = {}
        self._found: dict[tuple[bool, tuple[str, ...]], tuple[list[int], list[int]]] = {}

    def form(self, ignore_case: bool) -> tuple[str, str, list[int] | None]:
        """(same length, without white space, place of each character of that)."""
        if ignore_case not in self._forms:
            same = fold(self.text) if ignore_case else self.text
            bare = "".join(same.split())
            self._forms[ignore_case] = same, bare, None
        return self._forms[ignore_case]

    def _map(self, ignore_case: bool) -> list[int]:
        same, bare, at = self.form(ignore_case)
        if at is None:
            at = [m for w in re.finditer(r"\S+", same) for m in range(*w.span())]
            self._forms[ignore_case] = same, bare, at
        return at

    def found(self, phrase: Phrase, i: int, k: int) -> tuple[list[int], list[int]]:
        """(starts, ends) of every place where words i .. i + k match, overlapping ones too."""
        shapes = tuple(phrase.shapes[i:i + k])
        key = phrase.ignore_case, shapes
        known = self._found.get(key)
        if known is None:
            known = self._found[key] = self._find(phrase, i, k, shapes)
        return known

    def _find(self, phrase, i, k, shapes):
        same, bare, _ = self.form(phrase.ignore_case)
        starts, ends = [], []
        if k == 1:
            shape = shapes[0]
            exact = not phrase.ignore_case or (same.isascii() and shape.isascii())
            p = same.find(shape)
            while p >= 0:
                if exact or phrase.pattern(i, 1).match(self.text, p):
                    starts.append(p)
                    ends.append(p + len(shape))
                p = same.find(shape, p + 1)
            return starts, ends
        if not all(self.found(phrase, i + j, 1)[0] for j in range(k)):
            return starts, ends
        shape = "".join(shapes)
        p = bare.find(shape)
        if p >= 0:
            at, match = self._map(phrase.ignore_case), phrase.pattern(i, k).match
            while p >= 0:
                hit = match(self.text, at[p])
                if hit:
                    starts.append(hit.start())
                    ends.append(hit.end())
                p = bare.find(shape, p + 1)
        return starts, ends

    def places(self, phrase: Phrase) -> Places | Searches:
        return Places(self, phrase) if phrase.plain else Searches(self, phrase)


class Places:
    """One phrase's parts in one page, by lists of places."""

    def __init__(self, page: Page, phrase: Phrase):
        self.page, self.phrase = page, phrase
        self._present: dict[int, list[int]] = {}

    def all(self, i: int, k: int) -> Iterator[tuple[int, int]]:
        return zip(*self.page.found(self.phrase, i, k))

    def present(self, i: int) -> list[int]:
        if i not in self._present:
            self._present[i] = [k for k in self.phrase.widths(i) if self.page.found(self.phrase, i, k)[0]]
        return self._present[i]

    def next(self, i: int, k: int, at: int) -> tuple[int, int] | None:
        starts, ends = self.page.found(self.phrase, i, k)
        j = bisect_left(starts, at)
        return (starts[j], ends[j]) if j < len(starts) else None


class Searches:
    """The same by patterns, for words that normalizing emptied or parted."""

    def __init__(self, page: Page, phrase: Phrase):
        self.page, self.phrase = page, phrase

    def all(self, i: int, k: int) -> Iterator[tuple[int, int]]:
        return (m.span() for m in self.phrase.pattern(i, k).finditer(self.page.text))

    def present(self, i: int) -> range:
        return self.phrase.widths(i)

    def next(self, i: int, k: int, at: int) -> tuple[int, int] | None:
        hit = self.phrase.pattern(i, k).search(self.page.text, at)
        return hit.span() if hit else None
