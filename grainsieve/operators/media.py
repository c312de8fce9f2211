"""Images and sound.

Images come from Spark's ``image`` source, sound as the bytes of PCM WAV files.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as ty

from ..registry import ML8, Verdict, rule
from ..schema import strings
from .duplicates import near_duplicates  # noqa: F401

IMG = "QUALITY_BAD_IMG_"


@rule("RuleImageValid", IMG + "EFFECTIVENESS", ("img",), required=("image",))
def image_valid(f, cfg):
    data, channels = image_part(f, "data"), image_part(f, "nChannels")
    pixels = F.hex(data)
    # alpha, the fourth channel, does not count
    pixels = F.when(channels == 4, F.regexp_replace(pixels, "(.{6}).{2}", "$1")).otherwise(pixels)
    flat = f.column("pixels", 1, lambda f_: pixels)
    return Verdict(F.rlike(flat, F.lit(r"\A(?:F+|0+)\z")), strings("Image is not valid: all white or black"))


def image_part(f, name: str):
    return f.column(f"image_{name}", 0, lambda f_: f_.field("image")[name])


@rule("RuleImageSizeValid", IMG + "EFFECTIVENESS", ("img",), required=("image",))
def image_size_valid(f, cfg):
    ratio = image_part(f, "width") / image_part(f, "height")
    return Verdict((ratio > 4) | (ratio < 0.25), strings(F.concat(
        F.lit("Image size is not valid, the ratio of width to height: "), ratio.cast("string"))), measure=ratio)


def score_rule(name: str, metric_type: str, groups, threshold: float, bad_label: str | None = None) -> None:
    """A rule on the score of an outside model, bad below the threshold."""

    @rule(name, metric_type, groups, required=("score",), threshold=threshold)
    def build(f, cfg):
        s = f.field("score").cast("double")
        return Verdict(s < cfg.threshold, strings(F.concat(F.lit("score: "), s.cast("string"))), applies=s.isNotNull(),
                       measure=s, bad_label=F.lit(bad_label) if bad_label else None)


score_rule("RuleImageQuality", IMG + "EFFECTIVENESS", ("img",), 5.5)
score_rule("RuleImageTextSimilarity", IMG + "RELEVANCE", (), 0.17)
score_rule("RuleImageArtimuse", IMG + "ARTIMUSE", (), 6.0, "Artimuse_Succeeded.BadImage")


@rule("RuleHallucinationHHEM", "QUALITY_BAD_HALLUCINATION", ("hallucination", "rag"), required=("scores",), threshold=0.5)
def hallucination_scores(f, cfg):
    s = f.field("scores")
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + 1 - x) / F.size(s)
    missing = s.isNull() | (F.size(s) == 0)
    return Verdict(missing | (mean > cfg.threshold), F.when(missing, strings("Context is required")), measure=mean,
                   bad_label=F.when(missing, "QUALITY_BAD.MISSING_CONTEXT")
                   .otherwise("QUALITY_BAD_HALLUCINATION.HALLUCINATION_DETECTED"),
                   good_label=F.lit("QUALITY_GOOD.NO_HALLUCINATION"))


# --- sound ---------------------------------------------------------------------------------

def _samples(content: bytes) -> tuple[np.ndarray, int, int]:
    with wave.open(io.BytesIO(content)) as w:
        rate, frames, width, channels = w.getframerate(), w.getnframes(), w.getsampwidth(), w.getnchannels()
        raw = w.readframes(frames)
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1) if channels > 1 else x, rate, frames


def power_spectrum(x: np.ndarray, rate: int, size: int = 256) -> np.ndarray:
    """Welch's estimate: Hann windows with half overlap, each freed of its mean."""
    size = min(size, len(x))
    if size == 0:
        return np.zeros(1)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    step = max(size - size // 2, 1)
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[::step]
    parts = (parts - parts.mean(axis=1, keepdims=True)) * window
    p = np.abs(np.fft.rfft(parts, axis=1)) ** 2 / (rate * (window ** 2).sum())
    p[:, 1:(-1 if size % 2 == 0 else None)] *= 2
    return p.mean(axis=0)


@F.pandas_udf(ty.StructType([ty.StructField("duration", ty.DoubleType()), ty.StructField("snr", ty.DoubleType())]))
def wav_facts(contents: pd.Series) -> pd.DataFrame:
    """Length in seconds and signal-to-noise ratio in dB (null without noise power)."""
    rows = []
    for c in contents:
        if c is None:
            rows.append((None, None))
            continue
        x, rate, frames = _samples(bytes(c))
        p = power_spectrum(x, rate)
        noise = p[p <= np.percentile(p, 50)].sum()
        rows.append((frames / rate, round(float(10 * np.log10(p.sum() / noise)), 2) if noise > 0 else None))
    return pd.DataFrame(rows, columns=["duration", "snr"])


# the two names are swapped in the rule set this one follows: the first looks at noise
@rule("RuleAudioDuration", "QUALITY_BAD_EFFECTIVENESS", ML8, required=("audio",), threshold=8.0)
def audio_noise(f, cfg):
    snr = f.column("wav", 1, lambda f_: wav_facts(f_.field("audio")))["snr"]
    return Verdict(snr.isNull() | (snr < cfg.threshold), strings(F.when(
        snr.isNull(), "The audio power is zero. Cannot calculate SNR.")
        .otherwise("The audio signal-to-noise ratio is too low.")), measure=snr)


@rule("RuleAudioSnrQuality", "QUALITY_BAD_EFFECTIVENESS", ML8, required=("audio",), threshold=10.0)
def audio_length(f, cfg):
    seconds = f.column("wav", 1, lambda f_: wav_facts(f_.field("audio")))["duration"]
    return Verdict(seconds > cfg.threshold, strings("The audio duration is too long."),
                   applies=f.field("audio").isNotNull(), measure=seconds)


# --- differences of texts -------------------------------------------------------------------

@F.pandas_udf(ty.StructType([ty.StructField(n, ty.StringType()) for n in ("unique_a", "unique_b", "common")]))
def text_difference(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """What only the first, only the second and both texts hold.

    Texts are compared by words and the white space between them first, and what differs by characters.
    """
    import re
    from difflib import SequenceMatcher

    def parts(x, y):
        return SequenceMatcher(None, x, y, autojunk=False).get_opcodes()

    def split(x: str, y: str) -> tuple[str, str, str]:
        only_x, only_y, both = [], [], []
        a, b = re.findall(r"\s+|\S+", x), re.findall(r"\s+|\S+", y)
        for op, i, j, k, m in parts(a, b):
            left, right = "".join(a[i:j]), "".join(b[k:m])
            for inner, p, q, r, t in [(op, 0, len(left), 0, len(right))] if op != "replace" else parts(left, right):
                if inner == "equal":
                    both.append(left[p:q])
                else:
                    only_x.append(left[p:q])
                    only_y.append(right[r:t])
        return "".join(only_x), "".join(only_y), "".join(both)

    return pd.DataFrame([split(x or "", y or "") for x, y in zip(a, b)], columns=["unique_a", "unique_b", "common"])
