"""Personal data by anchors: an Aho-Corasick automaton finds signs and cues, local parsers grow them to whole findings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Base kinds in the order of ties, then what the cues add.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "account", "address")
KINDS = BASE + ADDED

SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")
#: Words that announce an identifier, and words that end a street name; matched in either case.
ACCOUNT_CUES = ("iban", "account no", "account number", "acct", "ssn", "passport no", "passport number")
STREET_CUES = (" street", " avenue", " road", " boulevard", " lane")

#: Signs of an IBAN by country.
_IBAN = {c: int(n) for n, cs in (
    (15, "NO"), (16, "BE"), (18, "DK FK FO FI GL NL SD"), (19, "MK SI"), (20, "AT BA EE KZ LT LU MN XK"), (21, "CH HR LI LV"),
    (22, "BG BH CR DE GB GE IE ME RS VA"), (23, "AE GI IL IQ OM SO TL"), (24, "AD CZ ES MD PK RO SA SE SK TN VG"), (25, "LY PT ST"),
    (26, "IS TR"), (27, "BI DJ FR GR IT MC MR SM"), (28, "AL AZ BY CY DO GT HU LB NI PL SV"), (29, "BR EG PS QA UA"),
    (30, "JO KW MU YE"), (31, "MT SC"), (32, "LC"), (33, "RU")) for c in cs.split()}

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_PHONE = _DIGITS | frozenset(" ().-")
_URL = _ALNUM | frozenset("-._~:/?#[]@!$&'()*+,;=%")

Span = tuple[str, int, int]


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, cues in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("street", STREET_CUES)):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


# ---- local parsers: each grows an anchor to a whole finding --------------------------------------------------------

def email_at(text: str, at: int, floor: int) -> int | tuple[int, int]:
    """The address around the at-sign, or where the search goes on. Nothing before `floor` is taken."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return floor
    n, i, end = len(text), at + 1, 0
    while True:
        j = i
        while j < n and text[j] in _LABEL:
            j += 1
        if j == i:
            break
        if i > at + 1:
            end = j  # one label after the first at least
        if j >= n or text[j] != ".":
            break
        i = j + 1
    return (start, end) if end else floor


def ip_at(text: str, start: int) -> tuple[int, int, bool] | None:
    """Four dotted runs of digits from here, and whether all are at most 255."""
    n, i, good = len(text), start, True
    for part in range(4):
        j = i
        while j < n and text[j] in _DIGITS:
            j += 1
        if j == i:
            return None
        good &= int(text[max(i, j - 4):j]) <= 255 and not text[i:j - 4].strip("0") if j - i > 4 else int(text[i:j]) <= 255
        if part == 3:
            return start, j, good
        if j >= n or text[j] != ".":
            return None
        i = j + 1
    return None


def chain_at(text: str, start: int) -> int:
    """End of the digits from here that at most one space or hyphen parts (" " and "-", and the signs between them)."""
    n, end = len(text), start + 1
    while True:
        if end < n and text[end] in _DIGITS:
            end += 1
        elif end + 1 < n and _is_gap(text[end]) and text[end + 1] in _DIGITS:
            end += 2
        else:
            return end


def _is_gap(c: str) -> bool:
    return c == " " or c == "-"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def phone_at(text: str, plus: int) -> tuple[int, int] | None:
    """From the plus: a digit, one sign at least, and on to the last digit of the run of digits, dots and brackets."""
    n, i = len(text), plus + 2
    if i > n or plus + 1 >= n or text[plus + 1] not in _DIGITS:
        return None
    while i < n and text[i] in _PHONE:
        i += 1
    while i > plus + 3 and text[i - 1] not in _DIGITS:
        i -= 1
    return (plus, i) if i > plus + 3 and text[i - 1] in _DIGITS else None


def _iban_at(text: str, start: int) -> int | None:
    """End of an IBAN of its country's length, whose signs a single space or hyphen may part."""
    size, n = _IBAN.get(text[start:start + 2].upper()), len(text)
    if size is None or not (text[start + 2:start + 4].isdigit() and text[start + 2:start + 4].isascii()):
        return None
    i, seen = start, 0
    while seen < size:
        if i < n and text[i] in _ALNUM:
            seen += 1
        elif not (i + 1 < n and text[i] in " -" and text[i + 1] in _ALNUM):
            return None
        i += 1
    return i if i == n or text[i] not in _ALNUM else None


def account_at(text: str, end: int) -> tuple[int, int] | None:
    """An identifier right after a cue and a few parting signs: an IBAN, or six signs or more with four digits.

    What is no IBAN goes on, by groups that a space or hyphen parts, to the last group with a digit; a group begins with
    a digit or capital, has a digit or capitals alone, and no two in a row are without a digit.
    """
    n, i = len(text), end
    while i < n and i < end + 4 and text[i] in " .:#=":
        i += 1
    start = i
    if start == end:
        return None
    if stop := _iban_at(text, start):
        return start, stop
    stop, bare, digits = start, 0, 0
    while True:
        j, own = i, 0
        while j < n and text[j] in _ALNUM:
            own += text[j] in _DIGITS
            j += 1
        if own:
            stop, bare, digits = j, 0, digits + own
        else:
            bare += 1
            if j == i or bare > 1 or i > start and not text[i:j].isupper():
                break
        if not (j + 1 < n and text[j] in " -" and (text[j + 1] in _DIGITS or text[j + 1].isupper())):
            break
        i = j + 1
    return (start, stop) if stop - start >= 6 and digits >= 4 else None


def address_at(text: str, cue: int, end: int, before: tuple[int, int | None]) -> tuple[int | None, bool]:
    """Where a house number and capitalised words before the word for a street begin, and whether that word ends there.

    `before` is the place and result of the cue before, where a walk to the left may stop.
    """
    ends = not (end < len(text) and text[end] in _ALNUM)
    i = cue
    while True:
        if i == before[0]:
            return before[1], ends
        j = i
        while j > 0 and text[j - 1].isalpha():
            j -= 1
        if j == i or not text[j].isupper() or j == 0 or text[j - 1] != " ":
            return None, ends
        i = j - 1
        k = i
        while k > 0 and text[k - 1] in _DIGITS:
            k -= 1
        if k < i:
            return (k if k == 0 or text[k - 1] not in _ALNUM else None), ends


def find(text: str) -> list[Span]:
    """All findings, ordered by start, then as KINDS. Findings of one kind don't overlap; those of two kinds may."""
    # cues are found in either case; where lower case is longer, only A-Z change, so that places stay the same
    folded = text.lower()
    if len(folded) != len(text):
        folded = text.translate(_LOWER)
    spans: list[Span] = []
    email_end = ip_end = card_end = phone_end = url_end = account_end = digits_end = 0
    street: tuple[int, int | None] = -1, None
    n = len(text)
    for last, (kind, size) in _automaton().iter(folded):
        if kind == "digit":
            if last < digits_end:
                continue  # inside a run whose head was looked at
            j = last + 1
            while j < n and text[j] in _DIGITS:
                j += 1
            digits_end = j
            if last >= ip_end and (ip := ip_at(text, last)):
                ip_end = ip[1]
                if ip[2]:
                    spans.append(("ip", ip[0], ip[1]))
            if last >= card_end and (end := chain_at(text, last)) > last + 1:
                card_end = end
                digits = "".join(c for c in text[last:end] if c in _DIGITS)
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", last, end))
        elif kind == "at":
            if isinstance(got := email_at(text, last, email_end), tuple):
                email_end = got[1]
                spans.append(("email", *got))
        elif kind == "plus":
            if last >= phone_end and (got := phone_at(text, last)):
                phone_end = got[1]
                if 10 <= sum(c in _DIGITS for c in text[got[0]:got[1]]) <= 15:
                    spans.append(("phone", *got))
        elif kind == "scheme":
            start = last + 1 - size
            if start >= url_end and not (start and text[start - 1] in _ALNUM):
                j = last + 1
                while j < n and text[j] in _URL:
                    j += 1
                while j > last + 1 and text[j - 1] in ".,;:!?)'":
                    j -= 1
                if j > last + 4:
                    url_end = j
                    spans.append(("url", start, j))
        elif kind == "account":
            start = last + 1 - size
            if start >= account_end and not (start and text[start - 1] in _ALNUM) and (got := account_at(text, last + 1)):
                account_end = got[1]
                spans.append(("account", *got))
        else:
            cue = last + 1 - size
            start, ends = address_at(text, cue, last + 1, street)
            street = cue, start
            if ends and start is not None:
                if spans and spans[-1][:2] == ("address", start):
                    spans.pop()  # it goes on
                spans.append(("address", start, last + 1))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(spans), key=lambda s: (s[1], order[s[0]], s[2]))


_LOWER = {c: c + 32 for c in range(65, 91)}


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                 T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `spans`: array of (kind, start, end) in code points, end exclusive.

    Null and empty texts give an empty array. Each row stands for itself: no shuffle, repeated rows repeat. Other
    columns are left behind.
    """
    kinds = T.StructType([docs.schema[c] for c in keep] + [T.StructField("spans", SPAN)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "__text"):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t or "")] for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(found, arrow)],
                                             names=kinds.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, kinds)


def redact(text: str, spans: list[Span], mark: str = "[{}]") -> str:
    """The text with each finding replaced by its kind; of overlapping findings the one that begins first goes."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], mark.format(kind)]
            at = b
    return "".join([*out, text[at:]])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of each base kind, base_sha256 and spans, by way of scan."""
    return common.span_digests(scan(docs), BASE)
