"""The progressive search in many pages at once: all chains of all phrases go one step together.

Places of words come from a table of the phrases' words; places of two and more words together from those, as the next
word begins, white space aside, where the last ended. Results are those of phrases.Phrase.candidates, which is used for
what is left out here (see fits and odd).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from .lexicon import Lexicon
from .phrases import Phrase, fold

#: Pages times parts of phrases that are looked at together, and starts that are followed together.
CELLS, STARTS = 3_000_000, 300_000
#: Bits of the first look at a pair of words.
_BITS = 22


@lru_cache(1)
def _odd() -> re.Pattern:
    cased = {chr(c) for c in range(0x20000) if chr(c).lower() != chr(c) or chr(c).upper() != chr(c)}
    alike: dict[str, list[str]] = {}
    for one in sorted(cased.union("".join(map(fold, cased)), (chr(c) for c in range(0x20000) if chr(c).isspace()))):
        alike.setdefault(fold(one), []).append(one)
    out = []
    for form, those in alike.items():
        kept: list[str] = []
        for one in those:
            good = len(form) == 1 and all(re.match(re.escape(x), one, re.IGNORECASE) and re.match(re.escape(one), x, re.IGNORECASE) for x in kept)
            (kept if good and not (one.isspace() and one not in " \t\n\x0b\f\r") else out).append(one)
    return re.compile(f"[{''.join(map(re.escape, out))}]")


def odd(text: str) -> bool:
    """Whether a text holds a character whose folded form isn't all that a pattern goes by."""
    return not text.isascii() and bool(_odd().search(text)) or text.isascii() and bool(re.search("[\x1c-\x1f]", text))


def fits(phrase: Phrase) -> bool:
    return phrase.plain and phrase.kmax <= 6 and not any(map(odd, phrase.words))


def _each(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place within the row) for so many of each row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


class Chains:
    """Phrases that fit, all with the same ignore_case."""

    def __init__(self, phrases: list[Phrase], ignore_case: bool):
        shapes: dict[str, int] = {}
        self.word = np.array([shapes.setdefault(x, len(shapes)) for p in phrases for x in p.shapes], np.int64)
        self.lexicon = Lexicon([(x,) for x in shapes], False, ignore_case)
        size = np.array([len(p.words) for p in phrases], np.int64)
        self.stop = np.cumsum(size)
        self.begin = self.stop - size
        self.gap, self.least = (np.array([getattr(p, x) for p in phrases], np.int64) for x in ("max_gap", "min_words"))
        widest = np.array([p.kmax for p in phrases], np.int64)
        n, self.kmax = len(self.word), int(widest.max())
        room = np.repeat(self.stop, size) - np.arange(n)
        room = np.minimum(room, np.repeat(widest, size))
        # parts[k]: the number of words w .. w + k for each w; the last number stands for those that there aren't
        self.parts, self.steps, at = [self.word], [], len(shapes)
        for k in range(2, self.kmax + 1):
            some = np.flatnonzero(room >= k)
            key = self.parts[-1][some] * len(shapes) + self.word[some + k - 1]
            known, which = np.unique(key, return_inverse=True)
            seen = np.zeros(1 << _BITS, bool)
            seen[known & (1 << _BITS) - 1] = True
            self.steps.append((known, seen, at))
            part = np.full(n, -1, np.int64)
            part[some] = at + which
            self.parts.append(part)
            at += len(known)
        self.size, self.shapes = at + 1, len(shapes)
        for part in self.parts:
            part[part < 0] = at
        owned = [(int(self.parts[k][b]), f, k + 1) for f, (b, p) in enumerate(zip(self.begin.tolist(), phrases)) for k in range(min(p.kmax, len(p.words))) if len(p.words) >= p.min_words]
        part, self.owner, self.k0 = (np.array(x, np.int64) for x in zip(*sorted(owned))) if owned else (np.zeros(0, np.int64),) * 3
        self.owned = np.searchsorted(part, np.arange(self.size + 1))

    def together(self) -> int:
        """Pages that are looked at together, at most."""
        return max(1, CELLS // (self.size + len(self.word)))

    def _places(self, texts: list[str]):
        """(part, page, start, end) of every place of a part, overlapping ones too."""
        n, page, s, e, b = self.lexicon.inside(texts)
        first = np.searchsorted(b, np.arange(int(b[-1]) + 2 if len(b) else 1))
        stop = b + (e - s)
        found, last = [(n, page, s, e)], (n, page, s, e, stop)
        for known, seen, base in self.steps:
            c, p, cs, _, x = last
            x = np.minimum(x, len(first) - 1)
            row, inner = _each(np.where(x + 1 < len(first), first[np.minimum(x + 1, len(first) - 1)] - first[x], 0))
            other = first[x[row]] + inner
            key = c[row] * self.shapes + n[other]
            maybe = np.flatnonzero(seen[key & (1 << _BITS) - 1])
            key = key[maybe]
            at = np.searchsorted(known, key)
            right = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == key) if len(known) else np.zeros(0, np.int64)
            row, other = row[maybe[right]], other[maybe[right]]
            last = base + at[right], p[row], cs[row], e[other], stop[other]
            found.append(last[:4])
        return (np.concatenate(x) for x in zip(*found))

    def search(self, texts: list[str]):
        """(phrase, page, seq, segments) arrays and the segments' (start, end, words) arrays, one after another, in runs."""
        part, page, s, e = self._places(texts)
        span = max(map(len, texts), default=0) + 1
        cell = page * self.size + part
        key = cell * span + s
        order = np.argsort(key)
        key, cell, part, page, s, e = key[order], cell[order], part[order], page[order], s[order], e[order]
        first = np.zeros(len(texts) * self.size + 1, np.int64)
        np.cumsum(np.bincount(cell, minlength=len(texts) * self.size), out=first[1:])
        # where the next word stands that the page holds
        n = len(self.word)
        held = (first[1:] > first[:-1]).reshape(len(texts), self.size)[:, self.word]
        ahead = np.full((len(texts), n + 1), n, np.int64)
        ahead[:, :n] = np.where(held, np.arange(n), n)
        ahead = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1].ravel()
        # starts, as a pattern finds them: none within the last
        many = self.owned[part + 1] - self.owned[part]
        opening = np.flatnonzero(many)
        over = np.flatnonzero((cell[opening[1:]] == cell[opening[:-1]]) & (s[opening[1:]] < e[opening[:-1]])) if len(opening) else opening
        if len(over):
            for c in np.unique(cell[opening[over]]).tolist():
                last = -1
                for i in range(first[c], first[c + 1]):
                    if s[i] < last:
                        many[i] = 0
                    else:
                        last = e[i]
            opening = np.flatnonzero(many)
        row, inner = _each(many[opening])
        row = opening[row]
        own = self.owned[part[row]] + inner
        # as they are found: page, phrase, most words, start (a part's places are in order)
        order = np.argsort(((page[row] * len(self.stop) + self.owner[own]) * (self.kmax + 1) + self.kmax - self.k0[own]) * span + s[row])
        row, own = row[order], own[order]
        before = (-1, 0)
        for i in range(0, len(row), STARTS):
            out = self._follow(row[i:i + STARTS], own[i:i + STARTS], page, s, e, key, first, ahead, span)
            f, p, counts, flat = out
            if not len(f):
                continue
            group = p * len(self.stop) + f
            new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            seq = np.arange(len(f)) - np.repeat(new, np.diff(np.append(new, len(f)))) + np.where(group == before[0], before[1], 0)
            before = int(group[-1]), int(seq[-1]) + 1
            yield f, p, seq, counts, flat

    def _follow(self, row, own, page, s, e, key, first, ahead, span):
        n = len(self.word) + 1
        f, pages, k0 = self.owner[own], page[row], self.k0[own]
        counts, covered, good = np.ones(len(row), np.int64), k0.copy(), np.zeros(len(row), bool)
        kept = [(np.arange(len(row)), np.zeros(len(row), np.int64), s[row], e[row], k0)]
        live, at, w = np.arange(len(row)), e[row], self.begin[f] + k0
        stop, gap, cells, line = self.stop[f], self.gap[f], pages * self.size, pages * n
        while len(live):
            w = ahead[line + w]
            on = w < stop
            if not on.all():
                over = live[~on]
                good[over] = covered[over] >= self.least[f[over]]
                live, at, w, stop, gap, cells, line = (x[on] for x in (live, at, w, stop, gap, cells, line))
                if not len(live):
                    break
            hit, step = np.full(len(live), -1, np.int64), np.ones(len(live), np.int64)
            for k in range(self.kmax, 0, -1):
                cell = cells + self.parts[k - 1][w]
                end = first[cell + 1]
                some = np.flatnonzero((end > first[cell]) & (hit < 0))
                if len(some):
                    j = np.searchsorted(key, cell[some] * span + at[some])
                    there = j < end[some]
                    some, j = some[there], j[there]
                    hit[some], step[some] = j, k
            w = w + step
            got = np.flatnonzero(hit >= 0)
            if len(got):
                j, who, k = hit[got], live[got], step[got]
                near = s[j] - at[got] <= gap[got]
                far = got[~near]
                got, j, who, k = got[near], j[near], who[near], k[near]
                kept.append((who, counts[who], s[j], e[j], k))
                counts[who] += 1
                covered[who] += k
                at[got] = e[j]
                if len(far):
                    on = np.ones(len(live), bool)
                    on[far] = False
                    live, at, w, stop, gap, cells, line = (x[on] for x in (live, at, w, stop, gap, cells, line))
        place = np.flatnonzero(good)
        counts = counts[place]
        begin = np.zeros(len(row), np.int64)
        begin[place] = np.cumsum(counts) - counts
        flat = np.zeros((3, int(counts.sum())), np.int32)
        for who, nth, *values in kept:
            mine = np.flatnonzero(good[who])
            to = begin[who[mine]] + nth[mine]
            for out, v in zip(flat, values):
                out[to] = v[mine]
        return f[place], pages[place], counts, flat
