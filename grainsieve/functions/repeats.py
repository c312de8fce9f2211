"""Characters covered by repeated runs of six words, for a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import fixed as X
from .marks import mixed_words, parts

#: Words of a run; words looked at together.
RUN, WORDS = 6, 1 << 18


def _again(codes: np.ndarray, text: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """Places, in order, of the runs that come once more in their text. codes: the words as numbers."""
    word = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    word ^= word >> np.uint64(29)
    last = len(word) - RUN + 1
    h = text[:last].astype(np.uint64)
    for i in range(RUN):
        h = h * np.uint64(0xD6E8FEB86659FD93) + word[i:last + i]
    h = h[fits]
    ranked = np.sort(h)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return fits[:0]
    # places are sorted for the few runs only whose hash begins as one that comes again
    begins = np.zeros(1 << 20, bool)
    begins[twice >> np.uint64(44)] = True
    few = begins[h >> np.uint64(44)]
    fits, h = fits[few], h[few]
    order = np.argsort(h, kind="stable")
    near = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    a, b = fits[order[near]], fits[order[near + 1]]
    # equal hashes are confirmed by the words
    same = text[a] == text[b]
    for i in range(RUN):
        same &= codes[a + i] == codes[b + i]
    return np.unique(np.concatenate([a[same], b[same]]))


def covered(words: pa.Array) -> np.ndarray:
    """For each list of words the characters that lie in repeated runs."""
    many = np.asarray(pc.fill_null(pc.list_value_length(words), 0))
    flat = words.flatten()
    letters = np.asarray(pc.utf8_length(flat))
    ends = np.cumsum(many, dtype=np.int64)
    out = np.zeros(len(many), np.int64)
    at = 0
    while at < len(many):
        begin = ends[at] - many[at]
        stop = max(at + 1, int(np.searchsorted(ends, begin + WORDS, "right")))
        size = many[at:stop]
        text = np.repeat(np.arange(len(size)), size)
        fit = np.ones(len(text), bool)
        for i in range(1, RUN):
            fit[(ends[at:stop] - begin)[size >= i] - i] = False
        fits = np.flatnonzero(fit)
        if len(fits):
            codes = np.asarray(flat.slice(begin, len(text)).dictionary_encode().indices)
            spots = _again(codes, text, fits)
            if len(spots):
                before = np.concatenate([[0], np.cumsum(letters[begin:begin + len(text)], dtype=np.int64)])
                # a run ends where the next one starts
                until = np.minimum(spots + RUN, np.append(spots[1:], len(text)))
                np.add.at(out, at + text[spots], before[until] - before[spots])
        at = stop
    return out


_LOWER = np.frombuffer(bytes(range(0x100)).lower(), np.uint8)
_PUNCTUATION = np.zeros(0x100, bool)
_PUNCTUATION[list(X.ASCII_PUNCTUATION.encode())] = True


def fold_ascii(ends: np.ndarray, data: np.ndarray, folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a part in lower case without punctuation; those not folded yet are ASCII."""
    if folded.all():
        return ends, data
    kept = ~_PUNCTUATION[data]
    lower = _LOWER[data]
    if folded.any():
        done = np.repeat(folded, np.diff(ends))
        kept |= done
        lower = np.where(done, data, lower)
    return np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[ends], lower[kept]


def shares(texts: pa.Array, folded: np.ndarray | None = None) -> np.ndarray:
    """For each text the percentage of its words' characters that lie in repeated runs. folded: false for ASCII texts to be folded yet."""
    out = np.zeros(len(texts))
    for at, ends, data in parts(texts):
        if folded is not None:
            ends, data = fold_ascii(ends, data, folded[at:at + len(ends) - 1])
        words = mixed_words(ends, data)
        many = np.asarray(pc.list_value_length(words))
        letters = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(words.flatten())), dtype=np.int64)])
        total = np.diff(letters[np.concatenate([[0], np.cumsum(many)])])
        out[at:at + len(many)] = np.where(many >= RUN, covered(words) / np.maximum(total, 1) * 100, 0.0)
    return out


@F.arrow_udf(DoubleType())
def repeated_share(texts: pa.Array, folded: pa.Array) -> pa.Array:
    return pa.array(shares(texts, folded.to_numpy(zero_copy_only=False)))
