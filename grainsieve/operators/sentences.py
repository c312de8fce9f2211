"""Sentence ends: abbreviations learnt from a corpus, and sentences cut where a full stop is none of theirs.

A word is an abbreviation if a full stop follows it far more often than chance would have it, by Dunning's log likelihood,
weighed by its length, its inner stops and the times it stands without one (Kiss and Strunk, 2006).
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

#: Score from which a word is an abbreviation, chance of a stop behind one, and how many are kept: the best.
LEAST, SURE, MOST = 0.3, 0.99, 1000
#: A word of letters with stops only between them, in any brackets or quotes, and the stop behind it.
WORD_AND_STOP = r"^[^\p{L}\p{N}]*(\p{L}+(?:\.\p{L}+)*)(\.?)[^\p{L}\p{N}.]*$"
#: Stands for the stop of an abbreviation while sentences are cut.
HELD = "\ue000"


def learn_abbreviations(docs: DataFrame, text: str = "text", least: float = LEAST, most: int = MOST) -> DataFrame:
    """word (lower case, without its last stop), with_stop, without, score: the best `most` abbreviations of the corpus.

    One grouped pass over the words of all texts; what is shuffled is one row a word and task. Texts of null are empty;
    other columns stay behind.
    """
    pieces = docs.select(F.explode(F.split(T.as_text(F.col(text)), r"\s+")).alias("piece"))
    words = pieces.select(F.lower(F.regexp_extract("piece", WORD_AND_STOP, 1)).alias("word"),
                          (F.regexp_extract("piece", WORD_AND_STOP, 2) == ".").alias("stop")).where("word <> ''")
    counts = words.groupBy("word").agg(F.count_if("stop").alias("with_stop"), F.count(F.lit(1)).alias("n"))
    everything = counts.agg(F.sum("n").alias("total"), F.sum("with_stop").alias("stops"))  # one row
    k, n, base = F.col("with_stop"), F.col("n"), F.col("stops") / F.col("total")

    def likelihood(p):
        # no word has a chance of none or all: the sums would be infinite where they do not count
        p = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
        return k * F.log(p) + (n - k) * F.log(1 - p)

    letters = F.length(F.regexp_replace("word", r"\.", ""))
    told = -2 * (likelihood(base) - likelihood(F.lit(SURE)))
    weight = F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters.cast("double"), -(n - k))
    return (counts.where("with_stop > 0").crossJoin(F.broadcast(everything)).select("word", "with_stop", (n - k).alias("without"), (told * weight).alias("score"))
            .where(F.col("score") >= least).orderBy(F.desc("score"), "word").limit(most))


def hold_stops(c: Column, abbreviations: tuple[str, ...]) -> Column:
    """The text with the stop of each abbreviation that something follows replaced by a sign of its own."""
    if not abbreviations:
        return c
    known = "|".join(re.escape(a) for a in sorted({a.lower().rstrip(".") for a in abbreviations}, key=lambda a: (-len(a), a)))
    return F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}.])({known})\.(?=\s+\S)", "$1" + HELD)


def let_stops(c: Column) -> Column:
    return F.translate(c, HELD, ".")


def sentences_of(c: Column, abbreviations: tuple[str, ...] = ()) -> Column:
    """The sentences of a text: cut behind . ! or ?, and closing quotes or brackets, before white space and no small letter."""
    marked = F.regexp_replace(hold_stops(T.as_text(c), abbreviations), r"([.!?…。！？]+[\"'”’)\]]*)\s+(?=[^\p{Ll}\s])", "$1\n\n")
    return F.filter(F.transform(F.split(marked, r"\n\n"), lambda s: T.strip(let_stops(s))), lambda s: s != "")


def treebank_words(f, abbreviations: tuple[str, ...]) -> Column:
    """Treebank words of the checked text, abbreviations with their stops."""
    name = f"treebank_{zlib.crc32('|'.join(sorted(abbreviations)).encode()):08x}"
    split = f.column(name + "_split", 1, lambda f_: let_stops(T.treebank_split(hold_stops(f_.content, abbreviations))))
    return f.column(name, 2, lambda f_: T.treebank_of(split))
