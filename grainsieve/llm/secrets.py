"""Secrets in texts: fixed patterns, and a character convolutional network over every candidate they do not cover, in its context."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BASE = ("assign", "access", "hex")
#: What the network adds to the findings of the patterns.
ADDED = ("key",)

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as the shorter ones are dropped
#: Every run of key signs of the least length of a base kind is a candidate; dots count inside, not at its ends.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{10,}[A-Za-z0-9+/_=-]")
_CUES = ("passw", "secret", "token", "api")

#: Findings, other candidates of letters alone, and the rest that the network starts from, each: the first by a hash of
#: candidate and context. All examples follow, about so many a task.
SAMPLE, EXAMPLES_A_TASK = 2000, 1 << 14
#: One in so many examples, by their hash, is held back; cells of a histogram of the network's output for each unit.
HELD, CELLS = 5, 1024
#: Share of the labelled findings held back for calibration that must pass the threshold.
RECALL = 0.99
#: Characters of context before and after, and of the candidate in one window; longer candidates get several windows.
BEFORE, INSIDE, AFTER = 24, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
#: What is added to the ids of characters outside the candidate.
CONTEXT = 128

Span = tuple[str, int, int]

_KEYS = np.zeros(256, bool)
_KEYS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, ordered by start, then kind as in BASE."""
    spans: list[Span] = []
    low = text.lower()
    if any(c in low for c in _CUES):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], BASE.index(s[0])))


def candidates(text: str, spans: list[Span]) -> list[tuple[int, int, bool, bool]]:
    """All candidates, whether each meets a finding of the patterns, and whether findings cover it whole; from left to right."""
    joined: list[list[int]] = []
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        while k < len(joined) and joined[k][1] <= m.start():
            k += 1
        met = k < len(joined) and joined[k][0] < m.end()
        out.append((m.start(), m.end(), met, met and joined[k][0] <= m.start() and m.end() <= joined[k][1]))
    return out


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate in its context, padded; one that is longer than a window is seen through overlapping windows."""
    before = text[max(0, start - BEFORE):start].rjust(BEFORE, "\0")
    out = []
    for at in range(start, end, INSIDE // 2):
        last = at + INSIDE >= end
        part = text[at:min(end, at + INSIDE)]
        after = text[end:end + AFTER] if last else text[at + INSIDE:at + INSIDE + AFTER]
        out.append((before + (part + after)).ljust(WIDTH, "\0"))
        before = text[max(0, at + INSIDE // 2 - BEFORE):at + INSIDE // 2].rjust(BEFORE, "\0")
        if last:
            break
    return out


# ---- the network ------------------------------------------------------------------------------------------------

def coded(rows: list[str]) -> np.ndarray:
    """Character ids: ASCII as it is, all else 127; 128 more outside the candidate, so that digits around a word are told
    from digits in it."""
    points = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), WIDTH)
    ids = np.minimum(points, 127).astype(np.int64)
    ids[:, :BEFORE] += CONTEXT
    ids[:, BEFORE:][~np.logical_and.accumulate(_KEYS[ids[:, BEFORE:]], 1)] += CONTEXT
    return ids


@dataclass
class Network:
    """Embedding, one convolution, the largest value of each filter, one output; with a calibrated scale and threshold."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 2.0  # nothing passes until it is calibrated

    REACH = 5
    SIGNS = 2 * CONTEXT

    def layers(self, ids: np.ndarray):
        e = self.embed[ids]
        n, w, d = e.shape
        seen = np.lib.stride_tricks.sliding_window_view(e, self.REACH, 1).transpose(0, 1, 3, 2).reshape(n, w - self.REACH + 1, -1)
        a = np.maximum(seen @ self.conv + self.bias, 0)
        at = a.argmax(1)
        top = np.take_along_axis(a, at[:, None], 1)[:, 0]
        return seen, at, top, top @ self.out + self.shift

    def logits(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self.layers(ids[i:i + 256])[3] for i in range(0, len(ids), 256)] or [np.zeros(0, np.float32)])

    def probability(self, ids: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(ids) + self.offset, -40, 40)))


def descend(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, steps: int, rate: float) -> None:
    """Whole passes of Adam over the examples until `steps` steps are made; the context of half of them is blanked, so that the
    candidate itself must tell."""
    names = ("embed", "conv", "bias", "out")
    first = {k: np.zeros_like(getattr(net, k)) for k in names} | {"shift": 0.0}
    second = {k: np.zeros_like(getattr(net, k)) for k in names} | {"shift": 0.0}
    step = 0
    while step < steps:
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            b = x[part].copy()
            blank = rng.random(len(part)) < 0.5
            b[blank, :BEFORE] = CONTEXT
            seen, at, top, z = net.layers(b)
            g = ((1 / (1 + np.exp(-z)) - y[part]) * weight[part] / len(part)).astype(np.float32)
            gt = g[:, None] * net.out * (top > 0)
            rows = np.arange(len(part))[:, None]
            picked = seen[rows, at]  # example, filter, input
            gi = gt[:, :, None] * net.conv.T
            grads = {"out": top.T @ g, "shift": float(g.sum()), "bias": gt.sum(0),
                     "conv": np.einsum("nf,nfi->if", gt, picked), "embed": np.zeros_like(net.embed)}
            chars = b[rows[:, :, None], at[:, :, None] + np.arange(Network.REACH)]
            np.add.at(grads["embed"], chars, gi.reshape(*chars.shape, -1))
            step += 1
            for k, v in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                move = rate * (first[k] / (1 - 0.9 ** step)) / ((second[k] / (1 - 0.999 ** step)) ** 0.5 + 1e-8)
                setattr(net, k, getattr(net, k) - move if k == "shift" else (getattr(net, k) - move).astype(np.float32))


def calibrate(net: Network, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
    """Scale and threshold by the outputs of held-back examples: z for n examples of label y.

    The threshold lets RECALL of the findings pass and, of the thresholds that pass the same examples, is the middle one."""
    # a logistic scale on the held-back examples: Newton steps, each halved until the loss falls; shares smoothed by one
    # example of either label, so that labels which part cleanly keep a finite scale
    ones, every = (n * y).sum(), n.sum()
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (every - ones + 2))
    mean = (n * z).sum() / every
    spread = max(float(((n * (z - mean) ** 2).sum() / every) ** 0.5), 1e-6)
    u = (z - mean) / spread

    def loss(s):
        t = s[0] * u + s[1]
        return float((n * (np.logaddexp(0, t) - goal * t)).sum())

    scale = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(scale @ [u, np.ones_like(u)], -40, 40)))
        s = n * p * (1 - p)
        hess = np.array([[(s * u * u).sum(), (s * u).sum()], [(s * u).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, np.array([(n * (p - goal) * u).sum(), (n * (p - goal)).sum()]))
        while loss(scale - move) > loss(scale) and np.abs(move).max() > 1e-9:
            move /= 2
        scale = scale - move
    a, b = scale[0] / spread, scale[1] - scale[0] * mean / spread
    net.slope, net.offset = float(max(a, 1e-3)), float(b)
    score = net.slope * z + net.offset
    order = np.argsort(score[y == 1])
    good, many = score[y == 1][order], np.cumsum(n[y == 1][order])
    highest = good[np.searchsorted(many, int((1 - RECALL) * ones), "right")]
    # as far from the other examples below it as from the findings above
    below = score[(y == 0) & (score < highest)].max(initial=-np.inf)
    middle = (highest + below) / 2 if np.isfinite(below) else highest
    net.threshold = float(1 / (1 + np.exp(-np.clip(min(middle, highest), -40, 40))))


def train(ids: np.ndarray, labels: np.ndarray, held: np.ndarray | None = None, filters: int = 24, dims: int = 8, steps: int = 800, rate: float = 0.003,
          seed: int = 11) -> Network:
    """Fit by Adam on logistic loss, the classes weighted alike; the held-back examples (every fifth) calibrate and set the threshold.

    Without examples of both classes nothing passes.
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (Network.SIGNS, dims)).astype(np.float32),
                  rng.normal(0, (2 / (dims * Network.REACH)) ** 0.5, (dims * Network.REACH, filters)).astype(np.float32),
                  np.zeros(filters, np.float32), rng.normal(0, 0.2, filters).astype(np.float32))
    held = np.arange(len(ids)) % 5 == 0 if held is None else held
    if labels[held].min(initial=1) == 1 or labels[held].max(initial=0) == 0 or len(set(labels[~held].tolist())) < 2:
        return net
    x, y = ids[~held], labels[~held].astype(np.float32)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    descend(net, x, y, weight, rng, steps, rate)
    calibrate(net, net.logits(ids[held]).astype(np.float64), labels[held].astype(np.float64), np.ones(held.sum()))
    return net


_DIGITS, _LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def respelt(window: str, inside: int, rng: np.random.Generator) -> str:
    """The window with the digits and the letters of its candidate's value exchanged at random, one for one: what makes a
    finding a secret is that it is no word, not which signs this issuer's keys are made of."""
    start, end = BEFORE, BEFORE + min(inside, INSIDE)
    start = max(start, window.rfind("=", start, end - 8) + 1, window.rfind(":", start, end - 8) + 1)
    table = str.maketrans(_DIGITS + _LETTERS, "".join([*rng.permutation(list(_DIGITS)), *rng.permutation(list(_LETTERS))]))
    return window[:start] + window[start:end].translate(table) + window[end:]


def fit(docs: DataFrame, text: str = "text", most: int = SAMPLE) -> Network:
    """A network trained on labelled candidates of the corpus: those that the patterns find, and the others.

    It starts from at most `most` distinct examples of the findings, of the others that are letters alone, and of the rest, spread
    over the whole corpus by a hash; if there are more, it then learns from all, and all held-back ones set its scale and
    threshold (`refined`). Each finding is learnt from once as it is and once respelt. Without examples of both labels the
    network passes nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "__text"):
            kinds, rows, sizes = [], [], []
            for t in batch.column(0).to_pylist():
                for start, end, known, _ in candidates(t, base_spans(t)) if t else ():
                    rows.append(windows(t, start, end)[0])
                    kinds.append(2 if known else 0 if t[start:end].isalpha() else 1)
                    sizes.append(end - start)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(rows, pa.string()), pa.array(sizes, pa.int32())],
                                             names=["kind", "window", "inside"])

    scratch = common.Scratch(docs.sparkSession, "secrets")
    found = scratch.save(docs.select(F.col(text).alias("__text")).mapInArrow(run, "kind int, window string, inside int"))
    each = scratch.save(found.distinct().withColumn("rank", F.xxhash64("window", "inside")))  # repeated windows count once
    scratch.drop(found)
    counts = {r.kind: r["count"] for r in each.groupBy("kind").count().collect()}
    whole = all(n <= most for n in counts.values())
    picked = [r for kind in range(3) for r in
              each.where(F.col("kind") == kind).orderBy("rank", "window", "inside").limit(most).collect()]
    picked.sort(key=lambda r: (r["rank"], r.kind))
    net = train(np.zeros((0, WIDTH), np.int64), np.zeros(0, np.int64))
    if picked:
        rng = np.random.default_rng(5)
        back = [i % HELD == 0 if whole else r["rank"] % HELD == 0 for i, r in enumerate(picked)]
        rows = [(r.window, int(r.kind == 2), h) for r, h in zip(picked, back)]
        rows += [(respelt(r.window, r.inside, rng), 1, h) for r, h in zip(picked, back) if r.kind == 2]
        ids, labels, held = zip(*rows)
        net = train(coded(list(ids)), np.array(labels, np.int64), np.array(held))
        if not whole and net.threshold <= 1:
            net = refined(each, net)
    scratch.drop(each)
    return net


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Codes and labels of batches of rank, kind, window, inside, each finding once more respelt, and the rank of the first."""
    for batch in batches:
        rows = [*zip(*(c.to_pylist() for c in batch.columns))]
        if rows:
            twins = [respelt(w, inside, np.random.default_rng(rank & (1 << 63) - 1)) for rank, kind, w, inside in rows if kind == 2]
            yield (coded([r[2] for r in rows] + twins), np.array([r[1] == 2 for r in rows] + [True] * len(twins), np.int64), rows[0][0])


def refined(each: DataFrame, net: Network) -> Network:
    """The network after a pass over all examples that are not held back, scaled and with a threshold by all that are.

    each: rank, kind, window, inside, different rows. Every task starts from `net` and learns from its share, dealt by
    hash; the networks are averaged, weighted by their examples. Tasks return sums of whole numbers, so their order is
    nothing to the result; the outputs of held-back examples come back as a histogram.
    """
    names = ("embed", "conv", "bias", "out")
    back = F.pmod("rank", F.lit(HELD)) == 0
    counts = {r.known: r["count"] for r in each.where(~back).groupBy((F.col("kind") == 2).alias("known")).count().collect()}
    ones, others = 2 * counts.get(True, 0), counts.get(False, 0)
    weights = np.array([0.5 * (ones + others) / max(others, 1), 0.5 * (ones + others) / max(ones, 1)], np.float32)
    rows = each.select("rank", "kind", "window", "inside")
    scale = float(1 << 24)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if found is None or not len(found):
            return
        found = found.sort_by([("rank", "ascending"), ("window", "ascending"), ("inside", "ascending")]).combine_chunks()
        (ids, labels, seed), = _examples(found.to_batches())
        own = Network(*(getattr(net, k).copy() for k in names), shift=net.shift)
        descend(own, ids, labels.astype(np.float32), weights[labels], np.random.default_rng(seed & (1 << 63) - 1), 1, 0.001)
        values = np.concatenate([*(getattr(own, k).ravel() for k in names), [own.shift, 1]]).astype(np.float64)
        total = np.round(values * scale).astype(np.int64) * len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])

    tasks = -(-(ones // 2 + others) // EXAMPLES_A_TASK)
    sums = rows.where(~back).repartition(max(1, tasks), "rank").mapInArrow(learn, "chunk int, counts binary")
    (_, total), = common.folded(sums, lambda a, b: (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes())
    values = np.frombuffer(total, np.int64).astype(np.float64)
    values = values[:-1] / values[-1]
    ends = np.cumsum([getattr(net, k).size for k in names])
    out = Network(*(v.reshape(getattr(net, k).shape).astype(np.float32) for k, v in zip(names, np.split(values[:-1], ends[:-1]))), shift=float(values[-1]))

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, _ in _examples(batches):
            cells = np.floor(out.logits(ids).astype(np.float64) * CELLS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(cells)], names=["label", "cell"])

    told = rows.where(back).mapInArrow(outputs, "label long, cell long").groupBy("label", "cell").count().orderBy("label", "cell").collect()
    y, cells, n = (np.array([r[i] for r in told], np.float64) for i in range(3))
    calibrate(out, cells / CELLS, y, n)
    return out


# ---- the scan ---------------------------------------------------------------------------------------------------

def find(texts: list[str | None], net: Network) -> list[list[Span]]:
    """Findings of each text: those of the patterns, and every candidate not wholly inside them that the network passes."""
    every, asked, rows = [], [], []
    for i, t in enumerate(texts):
        spans = base_spans(t) if t else []
        every.append(spans)
        if net.threshold <= 1:
            for start, end, _, covered in candidates(t, spans) if t else ():
                if not covered:
                    for w in windows(t, start, end):
                        asked.append((i, start, end))
                        rows.append(w)
    if rows:
        for (i, start, end), p in zip(asked, net.probability(coded(rows))):
            if p >= net.threshold and ("key", start, end) not in every[i][-4:]:
                every[i].append(("key", start, end))
    order = {k: n for n, k in enumerate(BASE + ADDED)}
    return [sorted(set(s), key=lambda s: (s[1], order[s[0]], s[2])) for s in every]


def scan(docs: DataFrame, net: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `spans`: array of (kind, start, end) in code points, end exclusive.

    Null and empty texts have no findings. Each row stands for itself; other columns are left behind.
    """
    kinds = T.StructType([docs.schema[c] for c in keep] + [T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "__text"):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in find(batch.column(len(keep)).to_pylist(), net)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(found, arrow)],
                                             names=kinds.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, kinds)


def masked(docs: DataFrame, net: Network, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every finding in the text replaced by a mark; overlapping findings go as one.

    Null and empty texts stay, equal rows are masked alike, an empty table stays empty; columns may have any names, as only
    the texts go through Python.
    """
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for batch in common.slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text"):
            own = batch.column(0).to_pylist()
            for t, spans in zip(own, find(own, net)):
                if spans:
                    parts, at = [], 0
                    for _, a, b in spans:
                        if a >= at:
                            parts += [t[at:a], mark]
                        at = max(at, b)
                    t = "".join([*parts, t[at:]])
                out.append(t)
        return pa.array(out, pa.string())

    return docs.withColumn(text, F.arrow_udf(clean, "string")(F.col(text)))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of each base kind, base_sha256 and spans, by way of fit and scan."""
    return common.span_digests(scan(docs, fit(docs)), BASE)
