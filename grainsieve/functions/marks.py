"""Words and stretches of a batch of texts, found in their bytes at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType, LongType

from . import fixed as X

#: Bytes of texts looked at together, but for a longer text.
BYTES = 1 << 18
#: Kinds of characters.
OTHER, BLANK, MARK = 0, 1, 2


def table(blanks: str, marks: Iterable[str]) -> np.ndarray:
    """The kind of each code point."""
    out = np.zeros(0x110000, np.uint8)
    out[[ord(c) for c in blanks]] = BLANK
    out[[ord(c) for c in marks]] = MARK
    return out


def parts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first text of a part, where its texts begin and end, and their bytes; a missing text is empty."""
    whole = texts.fill_null("").cast(pa.large_binary())
    _, ends, data = whole.buffers()
    ends = np.frombuffer(ends, np.int64)[whole.offset:whole.offset + len(whole) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(whole):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + BYTES, "right")) - 1)
        yield at, ends[at:stop + 1] - ends[at], data[ends[at]:ends[stop]]
        at = stop


def kinds(data: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The kind of the character each byte belongs to; bytes that are no UTF-8 are other characters."""
    ascii_ = of[:0x100].copy()
    ascii_[0x80:] = OTHER
    out = ascii_[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        after = np.append(data, np.zeros(3, np.uint8))
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point, valid = first & (0x7F >> size), np.ones(len(lead), bool)
        for i in (1, 2, 3):
            byte = after[lead + i].astype(np.int64)
            point = np.where(size > i, point << 6 | byte & 0x3F, point)
            valid &= (size <= i) | (byte & 0xC0 == 0x80)
        valid &= (point >= np.array([0, 0, 0x80, 0x800, 0x10000])[size]) & (point < len(of))
        lead, size, kind = lead[valid], size[valid], of[point[valid]]
        out[lead] = kind
        for i in (1, 2, 3):
            out[lead[size > i] + i] = kind[size > i]
    return out


def before(kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The kind in front of each byte, blank where a text begins."""
    out = np.empty_like(kind)
    out[1:] = kind[:-1]
    out[ends[:-1][ends[:-1] < ends[1:]]] = BLANK
    return out


_MIXED = table(X.SPACE_CHARS, map(chr, range(0x4E00, 0xA000)))


def mixed_words(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """The words of each text of a part, where each CJK character is a word; letters trailing CJK in a word are left out."""
    kind = kinds(data, _MIXED)
    last = before(kind, ends)
    solid = kind != BLANK
    start = solid & (last == BLANK)
    if marked := bool((kind == MARK).any()):
        start |= (kind == MARK) & (data & 0xC0 != 0x80) | (kind == OTHER) & (last == MARK)
    at = np.flatnonzero(start)
    # without the blanks a word ends where the next one begins
    letters, begin = data[solid], np.flatnonzero(start[solid])
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(begin, len(letters)).astype(np.int32)), pa.py_buffer(letters))
    if marked:
        followed = np.append((kind[at] == MARK) & (last[at] == OTHER), False)[1:]
        kept = (kind[at] == MARK) | (last[at] != MARK) | followed
        words, at = words.filter(pa.array(kept)), at[kept]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, ends).astype(np.int32)), words)


_STRETCHES = table(X.SPACE_CHARS, "\n" + X.SENTENCE_BREAKS)


def most_words(texts: pa.Array) -> np.ndarray:
    """For each text the words of its longest stretch without a sentence break."""
    out = np.zeros(len(texts), np.int64)
    for first, ends, data in parts(texts):
        kind = kinds(data, _STRETCHES)
        words = np.flatnonzero((kind == OTHER) & (before(kind, ends) != OTHER))
        full = np.flatnonzero(ends[:-1] < ends[1:])
        if len(full):
            cut = kind == MARK
            cut[ends[:-1][full]] = True
            cuts = np.flatnonzero(cut)
            many = np.diff(np.append(np.searchsorted(words, cuts), len(words)))
            out[first + full] = np.maximum.reduceat(many, np.searchsorted(cuts, ends[:-1][full]))
    return out


@F.arrow_udf(LongType())
def longest_stretch(texts: pa.Array) -> pa.Array:
    return pa.array(most_words(texts))


# --- signs without which a pattern cannot match ----------------------------------------------

#: What a text may hold; a text without the bit holds it for certain not.
WIDE, ENTITY, TAG, SPECIAL, BREAKS, LINES, SPACES, URL, STUCK = (1 << i for i in range(9))
#: Line breaks and blanks in a row.
BREAK_RUN, SPACE_RUN = 8, 500
# bytes that tell a sign by themselves, and the second or first bytes of pairs that tell one
_SINGLE = {ord("&"): ENTITY, ord("<"): TAG, ord("/"): STUCK}
_ENDS = {b"u2": SPECIAL, b"&#": SPECIAL, b"U+": SPECIAL, b"<|": SPECIAL, b" :": SPECIAL}
_BEGINS = {b"{/": SPECIAL, "\ufffd".encode()[:2]: SPECIAL, "□".encode()[:2]: SPECIAL, "＆".encode()[:2]: ENTITY, b":/": URL,
           b"ww": STUCK, b".p": STUCK, b".b": STUCK}
# one bit for what keeps pieces apart, one for bytes that are looked at closer
_LOOK = np.zeros(0x100, np.uint8)
_LOOK[list(b"\n !(),./:;?|-")] = 1
_LOOK[[*_SINGLE, *(p[1] for p in _ENDS), *(p[0] for p in _BEGINS), ord("\n")]] |= 2


def _held(ends: np.ndarray, data: np.ndarray, odd: bool) -> np.ndarray:
    """The bits of each text of a part. odd: there are bytes that are no UTF-8. Pairs and runs may reach into the next text."""
    out = np.zeros(len(ends) - 1, np.int32)
    if not len(data):
        return out
    text = lambda places: np.searchsorted(ends, places, "right") - 1
    full = np.flatnonzero(ends[:-1] < ends[1:])
    out[full[np.maximum.reduceat(data, ends[full]) >= 0x80]] |= WIDE | SPECIAL * odd
    look = _LOOK[data]
    spots = np.flatnonzero(look & 2)
    byte, of = data[spots], text(spots)
    last, following = data[spots - 1], data[(spots + 1) % len(data)]
    for sign, bit in _SINGLE.items():
        out[of[byte == sign]] |= bit
    for (first, second), bit in _ENDS.items():
        out[of[(byte == second) & (last == first)]] |= bit
    for (first, second), bit in _BEGINS.items():
        out[of[(byte == first) & (following == second)]] |= bit
    breaks = byte == ord("\n")
    lines, of = spots[breaks], of[breaks]
    if len(lines) >= BREAK_RUN:
        out[of[:1 - BREAK_RUN][lines[BREAK_RUN - 1:] - lines[:1 - BREAK_RUN] == BREAK_RUN - 1]] |= BREAKS
    # a quarter of the characters, of up to four bytes each, is more than a 32nd of the bytes
    out[np.bincount(of, minlength=len(out)) * 32 > np.diff(ends)] |= LINES

    def runs(bit: int, whole: np.ndarray, many: int, size: int) -> None:
        """Texts with so many places in a row, each of so many bytes, that a run must cover."""
        if len(whole) >= many:
            out[text(np.flatnonzero(np.logical_and.reduce([whole[i:len(whole) - many + 1 + i] for i in range(many)])) * size)] |= bit

    runs(SPACES, data[::128] == ord(" "), SPACE_RUN // 128, 128)
    # 46 characters without a separator cover four words of eight bytes
    runs(STUCK, look[:len(look) // 8 * 8].view(np.uint64) & np.uint64(0x0101010101010101) == 0, 4, 8)
    return out


def signs_of(texts: pa.Array) -> np.ndarray:
    """For each text the signs it may hold, as bits."""
    try:
        texts.validate(full=True)
        odd = False
    except pa.ArrowInvalid:
        odd = True
    return np.concatenate([np.zeros(0, np.int32), *(_held(ends, data, odd) for _, ends, data in parts(texts))])


@F.arrow_udf(IntegerType())
def text_signs(texts: pa.Array) -> pa.Array:
    return pa.array(signs_of(texts))


def may_hold(signs: Column, sign: int) -> Column:
    return signs.bitwiseAND(F.lit(sign)) != 0
