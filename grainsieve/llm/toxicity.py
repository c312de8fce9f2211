"""Toxicity of texts: a noisy-channel decoder undoes leetspeak, spacing and repetition, then the restored text is scored.

Words that may be disguised become lattices: each sign may stand for the letters it is used for, or for nothing. The path
that a character language model of the whole corpus likes best, together with the costs of the channel, is the restored
word. A logistic model over words and word beginnings scores the restored text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled rows of either label that the classifier learns from, at most: the first by a hash of their id.
SAMPLE = 4000
#: Features that the classifier weighs, and documents of the sample that must hold one.
FEATURES, LEAST_DOCS = 3000, 2
#: Symbols of the language model: 0 parts words, 1 to 26 are a to z, 27 is any other letter.
SYMBOLS = 28
#: Lengths in bytes of the word beginnings that are features.
BEGINNINGS = (4, 5, 6)

#: What signs stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou"}
#: Signs that may be put between letters.
PARTERS = frozenset(" .-_*~'")
# Costs of the channel, as negative log probabilities.
READ_SIGN, READ_STAR, DROP_SIGN, KEEP_SIGN, DROP_PARTER, DROP_REPEAT, DROP_DOUBLE = 0.7, 2.2, 9.0, 9.0, 0.5, 1.0, 6.0
#: Of a sign that ends a word and is no digit, @ or $: it is punctuation most often.
KEEP_END = 0.7

_FORMS = 200_000  # restored words that a task remembers


# ---- bytes ------------------------------------------------------------------------------------------------------

def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_LETTER = _table("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True
_ASCII = _table("abcdefghijklmnopqrstuvwxyz")
_SIGN = _table("".join(LEET))
_TAILS = "0123456789@$"
_TAIL = _table(_TAILS)
_BLANK = _table(" \t\n\r\x0b\x0c")
_PARTER = _table("".join(PARTERS))
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[0xC0:] = 27


def _lowered(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts in lower case, their bytes joined by line ends, and where each begins (one more than texts)."""
    low = [t.lower() if t else "" for t in texts]
    raw = [t.encode("utf-8", "surrogatepass") for t in low]
    offs = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return low, np.frombuffer(b"\n".join([*raw, b""]), np.uint8), offs


# ---- language model ---------------------------------------------------------------------------------------------

def trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of three symbols in a row over all texts of the table: one array of SYMBOLS ** 3 numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for batch in common.slices(batches, "__text"):
            data = _lowered(batch.column(0).to_pylist())[1]
            for at in range(0, len(data), common.PASS_BYTES):
                s = data[at:at + common.PASS_BYTES]
                s = _SYMBOL[s[(s < 0x80) | (s >= 0xC0)]]  # a letter's first byte stands for it
                s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])] if len(s) else s
                s = np.concatenate([[0], s, [0]])
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS ** 3)
        parts = total.reshape(SYMBOLS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SYMBOLS), pa.int32()),
                                          pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])

    partial = docs.select(F.col(text).alias("__text")).mapInArrow(run, "chunk int, counts binary")
    out = np.zeros((SYMBOLS, SYMBOLS ** 2), np.int64)
    for chunk, counts in common.folded(partial, lambda a, b: (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes()):
        out[chunk] = np.frombuffer(counts, np.int64)
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def surprise(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), from trigram counts that fall back on bigrams and those on single symbols."""
    one = counts.sum((0, 1)) + 1.0
    one /= one.sum()
    two = counts.sum(0) + 4.0 * one
    two /= two.sum(1, keepdims=True)
    three = counts + 4.0 * two
    return (-np.log(three / three.sum(2, keepdims=True))).astype(np.float32)


class Restorer:
    """Decodes disguised words under a language model."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost.tolist()
        self.known: dict[str, str] = {}

    def __call__(self, word: str) -> str:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > _FORMS:
                self.known.clear()
            got = self.known[word] = self.decode(word)
        return got

    @staticmethod
    def _ends(word: str, i: int) -> bool:
        """Only signs that are no digit, @ or $, and no letters, follow in the word."""
        while i < len(word) and word[i] in LEET and word[i] not in _TAILS:
            i += 1
        return i == len(word) or word[i].isspace()

    def _choices(self, word: str, i: int) -> list[tuple[int, str, float]]:
        """(symbol, what is written, cost) of the readings of a sign; symbol -1 drops it."""
        c = word[i]
        if c in LEET:
            out = [(ord(x) - 96, x, READ_STAR if c == "*" else READ_SIGN) for x in LEET[c]]
            out.append((-1, "", DROP_PARTER if c in PARTERS else DROP_SIGN))
            return out + [(0, c, KEEP_END if c not in _TAILS and self._ends(word, i) else KEEP_SIGN)]
        if c in PARTERS:
            return [(-1, "", DROP_PARTER), (0, c, KEEP_SIGN)]
        if "a" <= c <= "z" or c.isalpha():
            out = [(ord(c) - 96 if "a" <= c <= "z" else 27, c, 0.0)]
            if i and word[i - 1] == c:
                many = i > 1 and word[i - 2] == c or i + 1 < len(word) and word[i + 1] == c
                out.append((-1, "", DROP_REPEAT if many else DROP_DOUBLE))
            return out
        return [(0, c, 0.0)]

    def decode(self, word: str) -> str:
        """The reading of least total cost, by Viterbi over the last two symbols; the first of equals."""
        cost = self.cost
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for i in range(len(word)):
            now: dict[tuple[int, int], tuple[float, tuple]] = {}
            for symbol, written, own in self._choices(word, i):
                for (a, b), (total, path) in paths.items():
                    if symbol < 0:
                        state, value, kept = (a, b), total + own, path
                    else:
                        # white space after white space tells nothing
                        state = (b, symbol) if symbol or b else (a, b)
                        value, kept = total + own + (cost[a][b][symbol] if symbol or b else 0.0), (path, written)
                    if state not in now or value < now[state][0]:
                        now[state] = (value, kept)
            paths = now
        end = min(paths.items(), key=lambda kv: (kv[1][0] + (cost[kv[0][0]][kv[0][1]][0] if kv[0][1] else 0.0), kv[0]))
        out, path = [], end[1][1]
        while path:
            path, written = path
            out.append(written)
        return "".join(reversed(out))


def disguised(data: np.ndarray) -> list[tuple[int, int]]:
    """Bytes of the words that look disguised, as rising runs that don't overlap.

    A sign between letters, before a letter at a word's head, or a single one behind a letter at its end; one letter
    three times in a row; four or more letters that each stand alone, parted by the same kind of single sign.
    """
    n = len(data)
    if n < 4:
        return []
    letter, sign, blank = _LETTER[data], _SIGN[data], _BLANK[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    head, tail = np.ones(n, bool), np.ones(n, bool)
    head[1:], tail[:-1] = blank[:-1], blank[1:]
    odd = sign & ((before & after) | (head & after) | (before & tail & _TAIL[data]))
    # a sign next to another sign between letters, as in two digits for two letters
    pair = np.flatnonzero(sign[:-1] & sign[1:])
    pair = pair[(pair > 0) & (pair + 2 < n)]
    odd[pair[letter[pair - 1] & letter[pair + 2]]] = True
    same = (data[:-2] == data[1:-1]) & (data[1:-1] == data[2:]) & _ASCII[data[:-2]]
    odd[:-2] |= same
    runs: list[tuple[int, int]] = []
    at = np.flatnonzero(odd)
    if len(at):
        gaps = np.flatnonzero(blank)
        k = np.searchsorted(gaps, at)
        start = np.where(k > 0, gaps[np.maximum(k - 1, 0)] + 1, 0) if len(gaps) else np.zeros(len(at), np.int64)
        stop = np.where(k < len(gaps), gaps[np.minimum(k, len(gaps) - 1)], n) if len(gaps) else np.full(len(at), n)
        runs += list(dict.fromkeys(zip(start.tolist(), stop.tolist())))
    # letters alone: not a letter on either side
    alone = _ASCII[data] & ~before & ~after
    lone = np.flatnonzero(alone)
    if len(lone) > 3:
        linked = (np.diff(lone) == 2) & _PARTER[data[np.minimum(lone[:-1] + 1, n - 1)]]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8)))
        runs += [(int(lone[a]), int(lone[b]) + 1) for a, b in zip(edge[::2], edge[1::2]) if b - a >= 3]
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def suspects(data: np.ndarray) -> list[tuple[int, int]]:
    """Bytes of all that the lattices decode, as rising runs that don't overlap: what looks disguised, and what may be.

    Every word, from blank to blank, of a letter and a sign; three or more letters and signs that each stand alone, parted
    by single signs, with a letter among them.
    """
    n = len(data)
    runs = disguised(data)
    letter, sign = _LETTER[data], _SIGN[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[data], [True]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    letters, signs = (np.concatenate([[0], np.cumsum(x)]) for x in (letter, sign))
    mixed = (letters[stop] > letters[start]) & (signs[stop] > signs[start])
    runs += zip(start[mixed].tolist(), stop[mixed].tolist())
    # alone: no letter, digit, @ or $ on either side; other signs may be brackets or punctuation
    close = np.concatenate([[False], letter | _TAIL[data], [False]])
    lone = np.flatnonzero((_ASCII[data] | (sign & ~_PARTER[data])) & ~close[:-2] & ~close[2:])
    if len(lone) > 2:
        linked = (np.diff(lone) == 2) & _PARTER[data[np.minimum(lone[:-1] + 1, n - 1)]]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8)))
        first, last = lone[edge[::2]], lone[edge[1::2]]
        kept = (edge[1::2] - edge[::2] >= 2) & (letters[last + 1] > letters[first])
        runs += zip(first[kept].tolist(), (last[kept] + 1).tolist())
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def restored(texts: list[str | None], restore: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the restored texts in lower case, each followed by a line end, and where each begins."""
    _, data, offs = _lowered(texts)
    parts, at, more = [], 0, np.zeros(len(data) + 1, np.int64)
    raw = data.tobytes()
    for a, b in suspects(data):
        new = restore(raw[a:b].decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass")
        parts += [raw[at:a], new]
        more[b] += len(new) - (b - a)
        at = b
    if not parts:
        return data, offs
    # a disguised word holds no line end, so it lies within one text
    return np.frombuffer(b"".join([*parts, raw[at:]]), np.uint8), offs + np.cumsum(more)[offs]


# ---- features and the classifier --------------------------------------------------------------------------------

def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of each text, and the text of each; a hash may come more than once."""
    letter = np.concatenate([[False], _LETTER[data], [False]])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    starts, stops = edge[::2], edge[1::2]
    words = [common.run_hashes(data, starts, stops)]
    rows = [np.searchsorted(offs, starts, side="right") - 1]
    for k in BEGINNINGS:
        long_ = stops - starts >= k
        words.append(common.mix(common.run_hashes(data, starts[long_], starts[long_] + k) + np.uint64(k)))
        rows.append(rows[0][long_])
    return np.concatenate(words), np.concatenate(rows)


@dataclass
class Model:
    """The language model's costs, the features' hashes in rising order with their weights, and the constant."""

    cost: np.ndarray
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float = 0.0

    def scores(self, texts: list[str | None], restore: Restorer) -> np.ndarray:
        data, offs = restored(texts, restore)
        z = np.full(len(texts), self.constant)
        if len(self.keys):
            found, rows = features(data, offs)
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == found)
            each = np.unique(rows[hit] * len(self.keys) + at[hit])  # a feature counts once in a text
            np.add.at(z, each // len(self.keys), self.weights[each % len(self.keys)])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(rows: np.ndarray, columns: np.ndarray, label: np.ndarray, weight: np.ndarray, n: int, penalty: float = 0.3,
          steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic model over 0/1 features (row and column of each 1), by accelerated gradient steps."""
    w, b = np.zeros(n), math.log(max((weight * label).sum(), 1e-9) / max((weight * (1 - label)).sum(), 1e-9))
    vw, vb = w.copy(), b
    # a bound on the curvature: features of a text times features' weight
    per = np.bincount(rows, minlength=len(label))
    rate = 1 / (0.25 * float(np.bincount(columns, weight[rows] * (per[rows] + 1), n).max(initial=1.0)) + penalty)
    for i in range(steps):
        z = np.bincount(rows, vw[columns], len(label)) + vb
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) * weight
        w2, b2 = vw - rate * (np.bincount(columns, g[rows], n) + penalty * vw), vb - rate * g.sum()
        vw, vb = w2 + i / (i + 3) * (w2 - w), b2 + i / (i + 3) * (b2 - b)
        w, b = w2, b2
    return w, b


def held_out(key: str = "doc_id"):
    """Rows that nothing is learnt from: a fifth, by the CRC-32 of the key's text."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        most: int = SAMPLE) -> Model:
    """Language model of all texts; classifier of at most `most` labelled texts of either label, held-out ones excepted.

    Several labels of a key count as the largest, several texts as the one of the smallest hash. Without texts of both labels the score is one constant, the smoothed
    share of the label.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "toxicity")
    model = Model(surprise(trigrams(docs, text)))
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(
        F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    picked = [known.where(F.col("__label") == v).orderBy(F.xxhash64("__key"), "__key").limit(most) for v in (0, 1)]
    sizes = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    model.constant = math.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 1.0))
    cost = model.cost

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(cost)
        for batch in common.slices(batches, "__text"):
            found, rows = features(*restored(batch.column(2).to_pylist(), restore))
            order = np.lexsort((found, rows))
            found, rows = found[order], rows[order]
            new = np.concatenate([[True], (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])]) if len(found) else np.zeros(0, bool)
            found, rows = found[new], rows[new]
            at = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(common.signed(found), pa.int64()))],
                names=["doc", "label", "found"])

    # at most 2 * most keys: a broadcast of bounded size
    sample = scratch.save(picked[0].unionByName(picked[1]))
    texts = docs.join(F.broadcast(sample), docs[key] == F.col("__key")).select(
        F.col("__key").cast("long"), "__label", F.col(text).alias("__text"))
    # rows that repeat a key count once, by the text of the smallest hash, so that 2 * most bounds the rows too
    texts = texts.groupBy("__key", "__label").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), "__text")).alias("least")).select(
        "__key", "__label", "least.__text")
    rows = scratch.save(texts.mapInArrow(read, "doc long, label int, found array<long>").where("doc is not null"))
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return model
    each = rows.select("label", F.explode("found").alias("feature"))
    count = each.groupBy("feature").agg(F.sum("label").cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    # how much a feature tells (G squared), of those that are likelier in label 1
    p, n, ones, all_ = F.col("p"), F.col("n"), float(size[1]), float(size[0] + size[1])
    q = n - p

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    told = (term(p, n * ones / all_) + term(q, n * (all_ - ones) / all_) + term(ones - p, (all_ - n) * ones / all_)
            + term(all_ - ones - q, (all_ - n) * (all_ - ones) / all_))
    best = count.where((p >= LEAST_DOCS) & (p / ones > 2 * q / (all_ - ones))).withColumn("told", told).orderBy(
        F.desc("told"), "feature").limit(FEATURES).select("feature")
    best = scratch.save(best)  # FEATURES rows at most
    keys = np.sort(np.array([r.feature for r in best.collect()], np.int64).view(np.uint64))
    if not len(keys):
        return model
    signed = keys.view(np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.asarray(x, np.int64) for x in batch.column(2).to_pylist()]
            kept = [np.flatnonzero(np.isin(signed, x)) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k.tolist() for k in kept], pa.list_(pa.int32()))],
                                             names=["doc", "label", "columns"])

    # bounded: 2 * most texts by FEATURES features
    data = rows.mapInArrow(cut, "doc long, label int, columns array<int>").orderBy("doc", "label", "columns").collect()
    label_ = np.array([r.label for r in data], float)
    share = {v: sizes[v] / max(1, size[v]) for v in (0, 1)}  # the sample stands for all labelled rows
    weight = np.where(label_ == 1, share[1], share[0])
    weight /= weight.mean()
    of = np.repeat(np.arange(len(data)), [len(r["columns"]) for r in data])
    columns = np.array([c for r in data for c in r["columns"]], np.int64)
    model.weights, model.constant = train(of, columns, label_, weight, len(keys))
    model.keys = keys
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `score` (0 to 1). Null and empty texts get the score of a text without features.

    Whole texts are read; each row stands for itself; other columns are left behind.
    """
    kinds = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model.cost)
        for batch in common.slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(model.scores(batch.column(len(keep)).to_pylist(), restore))],
                names=kinds.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, kinds)


def restore_texts(docs: DataFrame, model: Model, text: str = "text", into: str = "restored", keep: tuple[str, ...] = ("doc_id",)
                  ) -> DataFrame:
    """The columns `keep` and the restored text in lower case; null and empty texts give an empty one."""
    kinds = T.StructType([docs.schema[c] for c in keep] + [T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model.cost)
        for batch in common.slices(batches, "__text"):
            data, offs = restored(batch.column(len(keep)).to_pylist(), restore)
            raw = data.tobytes()
            out = [raw[a:b - 1].decode("utf-8") for a, b in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(out, pa.string())],
                                             names=kinds.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, kinds)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every text, by way of fit and score.

    Every row stands for itself, equal ones too; null ids are held out of nothing and learnt from nowhere; an empty table
    gives no rows; other columns, whatever their names, stay behind.
    """
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of documents that are not predicted toxic, with their columns, whatever their names.

    Only the texts go through Python, once; all other columns stay where they are. Without labels of both kinds all
    rows get one score, the share of the label; null and empty texts get that of a text without features; an empty table
    stays empty.
    """
    model = fit(docs, labels, key, text)

    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restore = Restorer(model.cost)
        for part in parts:
            whole = pa.RecordBatch.from_arrays([part], names=["text"])
            scores = [model.scores(b.column(0).to_pylist(), restore) for b in common.slices(iter([whole]), "text")]
            yield pa.array(np.concatenate([np.zeros(0), *scores]) < 0.5)
        common.trim()

    return docs.where(F.arrow_udf(clean, "boolean")(F.col(text)))
