"""Text primitives as column functions.

Regular expressions spell out their character classes: Java's shorthands are ASCII, and ``.``
must stop at a line feed only, so patterns with a dot carry the ``(?d)`` flag.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from . import fixed as X

NOT_SPACE = f"[^{X.SPACE}]"
BORDER_L = f"(?<![{X.WORD}])"
BORDER_R = f"(?![{X.WORD}])"


def java(pattern: str) -> str:
    """Give a pattern written with Unicode ``\\s \\d \\w`` shorthands its Java spelling."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two in (r"\s", r"\d", r"\w"):
            body = {r"\s": X.SPACE, r"\d": r"\p{Nd}", r"\w": X.WORD}[two]
            out.append(body if in_class else f"[{body}]")
            i += 2
            continue
        if two == r"\b":
            out.append(f"(?:(?<=[{X.WORD}])(?![{X.WORD}])|(?<![{X.WORD}])(?=[{X.WORD}]))")
            i += 2
            continue
        if len(two) == 2 and two[0] == "\\":
            out.append(two)
            i += 2
            continue
        if pattern[i] == "[" and not in_class:
            in_class = True
        elif pattern[i] == "[":
            out.append("\\")          # a bracket inside a class is a plain character
        elif pattern[i] == "]" and in_class:
            in_class = False
        out.append(pattern[i])
        i += 1
    return "(?d)" + "".join(out)


def char_class(chars: str) -> str:
    """A class matching exactly the given characters."""
    return "[" + "".join("\\" + c if c in "\\[]^-&" else c for c in chars) + "]"


# a run of white space; the look-ahead lets Java skip visible ASCII without the whole class
SPACES = f"(?:(?![!-~])[{X.SPACE}])+"


def as_text(c: Column) -> Column:
    """The text a check sees: a missing value counts as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Cut white space of any kind from both ends (plain ``trim`` knows the blank only)."""
    return F.btrim(c, F.lit(X.SPACE_CHARS))


def is_blank(c: Column) -> Column:
    return ~F.rlike(c, F.lit(NOT_SPACE))


def occurrences(c: Column, literal: str) -> Column:
    """How often a literal occurs, without overlaps."""
    gone = F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))
    return (gone / len(literal)).cast("int")


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def where_any(c: Column, signs, found: Column, other: Column) -> Column:
    """A value for texts that hold one of the signs, and one for the others, which are not searched by patterns.

    Patterns see bytes that are no UTF-8 as the replacement character, so such texts hold it.
    """
    held = [F.contains(c, F.lit(x)) for x in signs] + [~F.is_valid_utf8(c)] * ("\ufffd" in signs)
    return F.when(reduce(or_, held), found).otherwise(other)


def is_plain(pattern: str) -> bool:
    """Whether a pattern matches itself only."""
    return pattern != "" and pattern.isascii() and not set(pattern) & set("\\.[]{}()*+?^$|")


def any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def decompose(c: Column) -> Column:
    """Canonical decomposition (NFD), by the ICU library on Spark's class path.

    Pure ASCII text, told by its byte length, is passed through.
    """
    nfd = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), c, F.lit(False))
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(nfd)


def without_punctuation(c: Column) -> Column:
    return F.translate(c, X.ASCII_PUNCTUATION + X.CJK_PUNCTUATION, "")


def fold(bare: Column) -> Column:
    """Lower-case and decompose text without punctuation; line breaks stay."""
    return decompose(F.lower(bare))


def squeeze(c: Column) -> Column:
    """Collapse white space to single blanks and cut both ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def words_of(norm: Column) -> Column:
    """Words of squeezed text."""
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def tokens_of(c: Column) -> Column:
    """Runs of word characters and runs of other visible characters."""
    return find_all(c, f"[{X.WORD}]+|[^{X.WORD}{X.SPACE}]+")


def lines_of(c: Column) -> Column:
    """Lines that hold more than white space."""
    return F.filter(F.split(c, "\n", -1), lambda x: ~is_blank(x))


# Treebank word splitting, rewritten with groups only so that it also runs on RE2.  A full stop
# is cut off at the end of the text and before white space with no lower-case letter behind it.
TREEBANK = [
    (r'([ (\[{<])"', r"\1 `` "),
    (r"(\.\.\.|--|[;@#$%&?!\[\](){}<>])", r" \1 "),
    (r"([:,])([^0-9])", r" \1 \2"),
    (r"([^.])\.(\s+[^a-z\s])", r"\1 . \2"),
    (r"([^.])\.(\s*)$", r"\1 . \2"),
    (r'"', r" '' "),
]
TREEBANK_CONTRACTIONS = [
    (r"([^' ])('(?:[sSmMdD]|ll|LL|re|RE|ve|VE)?) ", r"\1 \2 "),
    (r"([^' ])(n't|N'T) ", r"\1 \2 "),
]


def _rewrite(c: Column, steps) -> Column:
    for pattern, target in steps:
        c = F.regexp_replace(c, java(pattern), re.sub(r"\\(\d)", r"$\1", target))
    return c


def treebank_split(c: Column) -> Column:
    """Text with its tokens set apart, before contractions are looked at."""
    return _rewrite(F.concat(F.lit(" "), c, F.lit(" ")), TREEBANK)


def treebank_of(split: Column) -> Column:
    out = F.when(F.contains(split, F.lit("'")), _rewrite(split, TREEBANK_CONTRACTIONS)).otherwise(split)
    return F.filter(F.split(out, SPACES, -1), lambda t: t != "")


def luhn_ok(digits: Column) -> Column:
    """Check digit of a card number of 13 to 19 digits."""
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
