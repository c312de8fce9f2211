"""Pre-tokenisation by scans over arrays: code point classes, then a scan of transition functions, no regular expression.

The text pattern of byte-level BPE cuts a text into contractions, words, numbers, runs of other signs and runs of white
space, where one space joins what follows it. That is a small automaton. Each character is a function from state to
state; functions compose, so a doubling scan (composing neighbours at distance 1, 2, 4, ...) gives the state after every
character without walking the text. The composed functions come from a finite table, the automaton's transition monoid,
and after two or three steps all of them are constant.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import tiktoken

# Classes of characters. SPACE_LAST and WHITE_LAST: the last of a run of white space before something else.
LETTER, NUMBER, OTHER, SPACE, WHITE, SPACE_LAST, WHITE_LAST, QUOTE_1, QUOTE_2, START = range(10)
# States: what the character read last belongs to. LEFT_n: n letters of a contraction are still to come.
IN_WORD, IN_NUMBER, IN_OTHER, IN_WHITE, JOINING, LEFT_2, LEFT_1, DONE, FRESH = range(9)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a character of this class and whether a token begins at it."""
    if kind == LETTER:
        if state in (LEFT_2, LEFT_1):
            return (LEFT_1 if state == LEFT_2 else DONE), False
        return IN_WORD, state not in (IN_WORD, JOINING)
    if kind == NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, JOINING)
    if kind in (QUOTE_1, QUOTE_2) and state not in (IN_OTHER, JOINING):
        return (LEFT_1 if kind == QUOTE_1 else LEFT_2), True
    if kind in (OTHER, QUOTE_1, QUOTE_2):
        return IN_OTHER, state not in (IN_OTHER, JOINING)
    if kind in (SPACE, WHITE):
        return IN_WHITE, state != IN_WHITE
    # the last white character leaves the run before it; a plain space joins what follows
    return (JOINING if kind == SPACE_LAST else FRESH), True


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the classes' functions, the table of compositions, the value of constant functions (-1: not constant),
    the function that starts a text with a class, and the table (state, class) -> token begins."""
    states = range(9)
    gens = [tuple(_step(s, k)[0] for s in states) for k in range(START)]
    begin = [tuple(f[FRESH] for _ in states) for f in gens]  # reading a class at a text's start
    known = {f: i for i, f in enumerate(dict.fromkeys(gens + begin + [tuple(states)]))}
    todo = list(known)
    while todo:  # all products with the generators
        f = todo.pop()
        for g in gens + begin:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    assert len(known) < 65536
    every = list(known)
    table = np.array([[known[tuple(g[x] for x in f)] for g in every] for f in every], np.uint16)  # f, then g
    value = np.array([f[0] if len(set(f)) == 1 else -1 for f in every], np.int8)
    cuts = np.array([[_step(s, k)[1] for k in range(START)] for s in states], bool)
    return (np.array([known[f] for f in gens], np.uint16), table, value,
            np.array([known[f] for f in begin], np.uint16), cuts)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, asked from the tokenizer library itself, so that its Unicode tables hold."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(points)
    single = {bytes([i]): i for i in range(256)}
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        # only what the pattern matches is encoded
        seen = bytes(tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single,
                                       special_tokens={}).encode_ordinary(everything)).decode()
        kinds[np.frombuffer(seen.encode("utf-32-le"), np.uint32)] = kind
    kinds[32] = SPACE
    return kinds


def boundaries(text: str, firsts: np.ndarray) -> np.ndarray:
    """Where tokens begin in joined texts that begin at `firsts` (code points); a token never spans two texts."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    fun, table, value, begin, cuts = _monoid()
    kind = classes()[points]
    ends = np.zeros(n, bool)  # last character of its text
    firsts = firsts[firsts < n]
    heads = firsts[firsts > 0]
    ends[heads - 1] = True
    ends[-1] = True

    white = (kind == SPACE) | (kind == WHITE)
    last = white & ~ends
    last[:-1] &= ~white[1:]
    kind = np.where(last, kind + (SPACE_LAST - SPACE), kind)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        inside = ~ends[quotes]
        first = inside & np.isin(one, [ord(c) for c in "stmd"])
        within = inside & ~ends[np.minimum(quotes + 1, n - 1)]
        second = within & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        kind[quotes[first]] = QUOTE_1
        kind[quotes[second]] = QUOTE_2

    f = fun[kind]
    f[firsts] = begin[kind[firsts]]
    wide, reach = len(table), 1
    flat = table.ravel()
    while (value[f] < 0).any():
        open_ = np.flatnonzero(value[f] < 0)  # constant functions stay as they are
        open_ = open_[open_ >= reach]
        f[open_] = flat[f[open_ - reach].astype(np.int64) * wide + f[open_]]
        reach *= 2
    state = value[f]
    before = np.empty(n, np.int8)
    before[0] = FRESH
    before[1:] = state[:-1]
    before[firsts] = FRESH
    return np.flatnonzero(cuts[before, kind])
