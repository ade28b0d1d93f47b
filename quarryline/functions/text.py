"""Text expressions. Regular expressions are written so that Java and RE2 read them alike."""

from __future__ import annotations

import sys
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as white space.
SPACES = r"\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{SPACES}]"
#: The same, one by one.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_SPACE = f"[^{SPACES}]"
#: What ends a line.
LINE_END = r"[\x{000A}-\x{000D}\x{001C}-\x{001E}\x{0085}\x{2028}\x{2029}]"
LINE_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
WORD = r"[\p{L}\p{N}_]+"
#: A word like WORD, and what is neither of a word nor white space; ASCII letters and digits are listed, for Java looks those up before it asks for categories.
ASCII_WORD = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FAST_WORD = rf"[{ASCII_WORD}_\p{{L}}\p{{N}}]+"
SYMBOL = rf"[^{ASCII_WORD}\x20\x0A\p{{L}}\p{{N}}{SPACES}]"
EDGES = rf"\A{SPACE}+|{SPACE}+\z"
#: Control characters that are deleted, turned into spaces, or mark a text as broken.
DELETED = r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}]"
BLANKED = r"[\x{FEFF}\x{FFFD}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}]"
BROKEN = r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{FFFD}]"
URL = rf"(?i)https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"


def _other_digits() -> str:
    """Ranges of the characters that count as digits without being decimal ones: superscripts, circles and the like."""
    other = [c for c in range(sys.maxunicode + 1) if chr(c).isdigit() and not chr(c).isdecimal()]
    runs = [[c for _, c in g] for _, g in groupby(enumerate(other), lambda x: x[1] - x[0])]
    return "".join(f"\\x{{{r[0]:04X}}}-\\x{{{r[-1]:04X}}}" for r in runs)


OTHER_DIGITS = _other_digits()
DIGIT = rf"[\p{{Nd}}{OTHER_DIGITS}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once; a lambda would evaluate an expression for each element."""
    return F.transform(F.array(value), body)[0]


def once(value: Column) -> Column:
    """value as a generated column: what filters and selects make of it later doesn't evaluate it again."""
    return F.explode(F.array(value))


def strip(c: Column) -> Column:
    """Without white space at its ends; the pattern, which looks at all of a text, is only tried where there is some."""
    at_end = lambda t, k: F.substring(t, k, 1).rlike(SPACE)
    return let(c, lambda t: F.when(at_end(t, 1) | at_end(t, -1), F.regexp_replace(t, EDGES, "")).otherwise(t))


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(spaced(c, ""))


def spaced(c: Column, but: str) -> Column:
    """Runs of white space become one space, without a class that is asked for every character; characters of `but` stay as they are."""
    kinds = "".join(s for s in SPACE_CHARS if s not in but)
    return F.regexp_replace(F.translate(c, kinds, " " * len(kinds)), "  +", " ")


def clean_text(c: Column) -> Column:
    c = F.regexp_replace(c, r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(c, DELETED, ""), r"\n{3,}", "\n\n"))


def normalize_text(c: Column) -> Column:
    return collapse(F.regexp_replace(c, BLANKED, " "))


def canonical(c: Column) -> Column:
    """The form whose hash is a document's fingerprint."""
    return collapse(F.lower(c))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(FAST_WORD), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(FAST_WORD)).cast("long")


def spaced_words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def approx_tokens(c: Column) -> Column:
    """A quarter of the characters, half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.length(c) / 4)).cast("long")


def chars(c: Column) -> Column:
    return F.length(c).cast("long")


def matching_chars(c: Column, of_one: str) -> Column:
    """Characters that a class of one character matches; runs are taken out at once."""
    return (F.length(c) - F.length(F.regexp_replace(c, f"{of_one}+", ""))).cast("long")


def digit_chars(c: Column) -> Column:
    """Digits of any kind; the long list of rare ones is only tried where a character of their category occurs."""
    rare = F.when(c.rlike(r"\p{No}"), matching_chars(c, f"[{OTHER_DIGITS}]")).otherwise(0)
    return matching_chars(c, r"\p{Nd}") + rare


def preview(c: Column, n: int) -> Column:
    return F.substring(collapse(c), 1, n)


def truncated(c: Column, most: int) -> Column:
    """Cut at `most` characters, back to the last sentence end if that lies beyond 70 % of it."""
    cut = F.substring(c, 1, most)
    upto = F.length(F.regexp_extract(cut, r"(?s)\A.*[.!?]", 0))
    short = F.when(upto - 1 > most * 0.7, F.substring(cut, F.lit(1), upto)).otherwise(cut)
    return F.when(F.length(c) <= most, c).otherwise(strip(short))


def piece_bytes(piece: Column) -> Column:
    """Bytes that a subword piece stands for."""
    surface = F.octet_length(F.replace(piece, F.lit("▁"), F.lit(" ")))
    return F.when(piece.rlike(r"\A<0x[0-9A-Fa-f]{2}>\z"), 1).otherwise(surface).cast("long")


def first_nonblank(named: dict[str, Column]) -> tuple[Column, Column]:
    """The first candidate that isn't blank, as it is ('' if none), and its name (null if none)."""
    full = {n: strip(c) != "" for n, c in named.items()}
    value = F.coalesce(*[F.when(full[n], c) for n, c in named.items()], F.lit(""))
    return value, F.coalesce(*[F.when(full[n], F.lit(n)) for n in named])


def shortened(c: Column, most: int = 500) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("...[truncated]"))).otherwise(c)
