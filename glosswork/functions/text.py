"""Text and value functions as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that are unified, white space as the text model knows it, colours, mode names.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212\ufe63\uff0d"
SINGLE_QUOTES = "\u2018\u2019\u2032\u275b\uff07"
DOUBLE_QUOTES = "\u201c\u201d\u2033\u275d\uff02"
SPACES = r"[\x09-\x0d\x1c-\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
PALETTE = {"yellow": (1.0, 0.97, 0.0), "mint": (0.31, 0.86, 0.71), "violet": (0.55, 0.47, 1.0), "red": (1.0, 0.2, 0.2), "green": (0.2, 0.8, 0.2), "blue": (0.2, 0.5, 1.0)}
MODES = {"single": "single", "error": "single", "error_on_multiple": "single", "stop_on_multiple": "single", "best": "best", "shortest": "best", "best_only": "best", "all": "all", "all_matches": "all"}
#: Texts with none of these characters are their own compatibility form, character by character.
_COMPATIBLE = r"[\u00a0\u00a8\u00aa\u00af\u00b2-\u00b5\u00b8-\u00ba\u00bc-\u00be\u0132-\uffff\x{10000}-\x{10ffff}]"


@F.pandas_udf(T.StringType())
def _nfkc_by_character(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", c) for c in t))


#: White space that is ASCII, and what else may have to be changed in a text that isn't: without it, characters stay.
_CONTROLS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x20))))
_WIDE_SPACES = "\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_UNUSUAL = r"[\u0085\u00a0\u00ad\u1680\u2000-\uffff]"


def _wide(text: Column) -> Column:
    """Whether a text is not ASCII alone: its bytes are counted, which is less work than a look at each character."""
    return F.octet_length(text) != F.length(text)


def _plain(text: Column, keep_lines: bool = False) -> Column:
    usual = text
    for c in _CONTROLS.replace("\n", "") if keep_lines else _CONTROLS:
        usual = F.replace(usual, F.lit(c), F.lit(" "))
    changed = F.translate(usual, DASHES + SINGLE_QUOTES + DOUBLE_QUOTES + _WIDE_SPACES + "\u00ad", "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + " " * len(_WIDE_SPACES))
    return F.when(_wide(text) & text.rlike(_UNUSUAL), changed).otherwise(usual)


def normalize_chars(text: Column, keep_lines: bool = False) -> Column:
    """Character by character: compatibility form, no soft hyphens, one space for each white space, plain dashes and
    quotes. Only texts with an affected character leave the JVM."""
    return _plain(F.coalesce(_nfkc_by_character(F.when(_wide(text) & text.rlike(_COMPATIBLE), text)), text), keep_lines)


#: Texts without this keep all their hyphens.
_SOFT = r"\p{L} *- +\p{L}"
_CUTS = "array<struct<at:int,n:int>>"
#: Members of a run that are summed one after another; runs are summed among themselves.
_RUN = 512


def running(values: Column) -> Column:
    """Sums of all members before each one. Members go by runs, so that no list grows member by member."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _RUN).cast("int")), lambda r: F.slice(values, r * _RUN + 1, _RUN))
    none = F.array().cast("array<long>")
    grown = lambda xs: F.aggregate(xs, F.struct(F.lit(0).cast("long").alias("sum"), none.alias("out")), lambda a, x: F.struct((a.sum + x).alias("sum"), F.concat(a.out, F.array(a.sum)).alias("out")))
    inside = F.transform(runs, grown)
    before = grown(F.transform(inside, lambda x: x.sum)).out
    listed = F.flatten(F.zip_with(inside, before, lambda x, b: F.transform(x.out, lambda v: v + b)))
    return F.when(F.size(values) > 0, listed).otherwise(none)


def _joints(parts: Column) -> Column:
    """For each part after the first, whether the hyphen before it goes. What is carried along is the last word alone."""
    first = F.substring_index(F.rtrim(F.element_at(parts, 1)), " ", -1)
    ends = F.element_at(parts, 1).endswith(" ")
    start = F.struct(F.when(ends, F.concat(first, F.lit(" "))).otherwise(first).alias("tail"), F.array().cast("array<boolean>").alias("soft"))

    def step(a: Column, part: Column) -> Column:
        word = F.rtrim(a.tail)
        soft = part.rlike(r"^ +\p{L}") & word.rlike(r"\p{L}$") & ~F.contains(word, F.lit("-"))
        grown = F.concat(a.tail, F.when(soft, F.ltrim(part)).otherwise(F.concat(F.lit("-"), part)))
        last = F.substring_index(F.rtrim(grown), " ", -1)
        return F.struct(F.when(grown.endswith(" "), F.concat(last, F.lit(" "))).otherwise(last).alias("tail"), F.concat(a.soft, F.array(soft)).alias("soft"))

    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step).soft


def _pieces(text: Column) -> tuple[Column, Column]:
    """Parts between hyphens, and whether the hyphen before each goes (the first has none)."""
    parts = F.split(text, "-", -1)
    return parts, F.concat(F.array(F.lit(False)), _joints(parts))


def join_hyphens(text: Column) -> Column:
    """Removes a hyphen and the spaces after it between letters, if its word has no hyphen yet."""
    parts, soft = _pieces(text)
    kept = F.zip_with(parts, soft, lambda p, s: F.when(s, F.ltrim(p)).otherwise(F.concat(F.lit("-"), p)))
    return F.when(F.contains(text, F.lit("- ")) & text.rlike(_SOFT), F.substring(F.array_join(kept, ""), 2, 2**31 - 1)).otherwise(text)


def hyphen_cuts(text: Column) -> Column:
    """What join_hyphens takes out: (at in the joined text, n characters), in order."""
    parts, soft = _pieces(text)
    gone = F.zip_with(parts, soft, lambda p, s: F.when(s, F.length(p) - F.length(F.ltrim(p)) + 1).otherwise(0))
    sizes = F.zip_with(parts, gone, lambda p, n: F.length(p) + 1 - n)
    places = F.zip_with(running(sizes), gone, lambda at, n: F.struct((at - 1).cast("int").alias("at"), n.cast("int").alias("n")))
    return F.when(text.rlike(_SOFT), F.filter(places, lambda c: c.n > 0).cast(_CUTS)).otherwise(F.array().cast(_CUTS))


def normal_string(text: str) -> str:
    """The same normal form in Python, of a whole string."""
    plain = unicodedata.normalize("NFKC", text)
    for group, one in ((DASHES, "-"), (SINGLE_QUOTES, "'"), (DOUBLE_QUOTES, '"'), ("\u00ad", "")):
        for c in group:
            plain = plain.replace(c, one)
    return "".join(" " if c.isspace() else c for c in plain)


def page_text(text: Column) -> Column:
    """The form of a page that is searched."""
    # the normal form is worked out once, though joining looks at it several times
    return F.element_at(F.transform(F.array(normalize_chars(text)), join_hyphens), 1)


def tokens(text: Column) -> Column:
    """Words between white space, empties dropped."""
    return F.filter(F.split(text, SPACES + "+"), lambda w: w != "")


@F.pandas_udf(T.StringType())
def _nfkc_by_line(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "\n".join(unicodedata.normalize("NFKC", w) for w in t.split("\n")))


def query_tokens(text: Column) -> Column:
    """A query's words, each normalized after the cut and as a whole, so that combining marks compose."""
    words = tokens(text)
    composed = F.coalesce(F.split(_nfkc_by_line(F.when(text.rlike(_COMPATIBLE), F.array_join(words, "\n"))), "\n", -1), words)
    return F.transform(composed, lambda w: _plain(w))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}\-#&~])", r"\\$1")


def literal_pattern(query: Column, literal_whitespace: bool | Column = False, ignore_case: bool | Column = True) -> Column:
    """Pattern of a query: its words with any white space between, or the whole escaped. Options may be columns."""
    norm = normalize_chars(query)
    flag, whole = (x if isinstance(x, Column) else F.lit(x) for x in (ignore_case, literal_whitespace))
    words = F.array_join(F.transform(tokens(norm), escaped), r"\s+")
    return F.concat(F.when(flag, "(?iu)").otherwise(""), F.when(whole, escaped(norm)).otherwise(words))


def rarest_word(words: Column) -> Column:
    """Of a query's words the longest, in lower case, for a test whether a text can match at all; none if it isn't plain."""
    plain = F.filter(words, lambda w: w.rlike("^[\\x21-\\x7e]+$"))
    longest = F.array_max(F.transform(plain, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    return F.lower(longest.w)


def folded(text: Column) -> Column:
    """A form in which plain words stand wherever the text matches them with case ignored (and perhaps elsewhere)."""
    # beyond ASCII only dotted and dotless i, long s and the Kelvin sign match plain letters
    return F.translate(F.lower(text), "\u0131\u017f\u0307", "is")


def chunk_pattern(words: Column, start, k) -> Column:
    """Words start .. start + k (from 0) with optional white space between."""
    return F.array_join(F.transform(F.slice(words, start + 1, k), escaped), r"\s*")


def parse_color(value: Column) -> Column:
    """#RRGGBB, r,g,b (also as a JSON list) or a palette name; anything else is yellow. No range check."""
    s = F.regexp_replace(F.trim(value), r"^\[|\]$", "")
    rgb = lambda r, g, b: F.struct(r.cast("double").alias("r"), g.cast("double").alias("g"), b.cast("double").alias("b"))
    named = reduce(lambda e, kv: F.when(F.lower(s) == kv[0], rgb(*map(F.lit, kv[1]))).otherwise(e), PALETTE.items(), rgb(*map(F.lit, PALETTE["yellow"])))
    channel = lambda at: F.conv(F.substring(s, at, 2), 16, 10).cast("double") / 255.0
    parts = F.transform(F.split(s, ",", -1), lambda p: F.trim(p).try_cast("double"))
    listed = (F.size(parts) == 3) & F.forall(parts, lambda p: p.isNotNull())
    return F.when(s.rlike("^#[0-9A-Fa-f]{6}$"), rgb(channel(2), channel(4), channel(6))).when(listed, rgb(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))).otherwise(named)


def mode_of(value: str | None) -> str:
    """Selection mode by its names; none is best, an unknown name is an error."""
    key = "best" if value is None else str(value).lower().replace(" ", "_").replace("-", "_")
    if key not in MODES:
        raise ValueError(f"unknown selection mode: {value}")
    return MODES[key]


def parse_mode(value: Column, strict: bool = True) -> Column:
    """Selection mode by its names; null is best. An unknown name is an error, or null if not strict."""
    key = F.regexp_replace(F.lower(value), "[ -]", "_")
    names = F.create_map(*(F.lit(x) for kv in MODES.items() for x in kv))
    known = F.try_element_at(names, key)
    wrong = F.raise_error(F.concat(F.lit("unknown selection mode: "), value)) if strict else F.lit(None).cast("string")
    return F.when(value.isNull(), F.lit("best")).when(known.isNull(), wrong).otherwise(known)


def tenths(value: Column) -> Column:
    """A double rounded to one place: by its exact value, halves to even."""
    return F.replace(F.format_number(value, 1), F.lit(","), F.lit("")).cast("double")


def sanitized(r: Column, eps: float = 0.25) -> Column:
    """Corners in order; if either extent is nothing both are set to eps."""
    x0, x1, y0, y1 = F.least(r.x0, r.x1), F.greatest(r.x0, r.x1), F.least(r.y0, r.y1), F.greatest(r.y0, r.y1)
    flat = (x1 <= x0) | (y1 <= y0)
    return F.struct(x0.alias("x0"), y0.alias("y0"), F.when(flat, x0 + eps).otherwise(x1).alias("x1"), F.when(flat, y0 + eps).otherwise(y1).alias("y1"))


def quad(r: Column) -> Column:
    """Upper left, upper right, lower left, lower right."""
    return F.array(r.x0, r.y0, r.x1, r.y0, r.x0, r.y1, r.x1, r.y1)
