"""Whole-word search for a table of words of any size: joined with the texts by equal runs of tokens, nothing collected.

A token is an unbroken run of letters and digits. A word is found where neither the sign before it nor the one after it is a letter
or digit, so the tokens of a word are whole tokens of the text. Most words are a run of at most RUN tokens, with what parts them
in between, and few other signs at their ends: equality of that run, and of the signs around it, is all there is to check. The others
(longer ones, and those without a token) are told apart by their first run or first signs, and then looked for in the texts that have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import written

TOKEN = r"[\p{L}\p{N}]"
PIECES = rf"{TOKEN}+|[^\p{{L}}\p{{N}}]+"
#: Tokens of a run, and signs of a beginning, that words and texts are joined by, at most.
RUN = 8
#: Stands for what is beyond a gap: a letter, which no gap has.
BEYOND = "x"


def _runs(pieces: Column, k: int, lead: int, trail: int) -> Column:
    """Runs of k tokens of a text, given as tokens and what parts them in turn, both ends being gaps; with `lead` signs before and
    `trail` signs after each, a letter standing for all that is beyond the gap."""
    runs = F.transform(F.sequence(F.lit(2), F.size(pieces) - (2 * k - 1), F.lit(2)), lambda i: F.concat(
        *([F.right(F.concat(F.lit(BEYOND * lead), F.get(pieces, i - 2)), F.lit(lead))] if lead else []),
        *[F.get(pieces, i + (j - 1)) for j in range(2 * k - 1)],
        *([F.left(F.concat(F.get(pieces, i + (2 * k - 2)), F.lit(BEYOND * trail)), F.lit(trail))] if trail else [])))
    return F.when(F.size(pieces) > 2 * k, runs).otherwise(F.array().cast("array<string>"))


def _beginnings(pieces: Column, k: int) -> Column:
    """Runs of k signs inside the pieces without letters and digits."""
    gaps = F.filter(pieces, lambda p: ~F.rlike(p, F.lit(rf"\A{TOKEN}")) & (F.length(p) >= k))
    return F.flatten(F.transform(gaps, lambda p: F.transform(
        F.sequence(F.lit(1), F.length(p) - k + 1), lambda i: F.substring(p, i, F.lit(k)))))


def _marked(pieces: Column, k: int, lead: int, trail: int) -> Column:
    """(k, run, before, after): the different runs of a text of this length, with the signs around them that words may have."""
    runs = _runs(pieces, k, lead, trail) if k > 0 else _beginnings(pieces, -k)

    def parted(x):
        run = F.substring(x, F.lit(lead + 1), F.length(x) - (lead + trail)) if lead or trail else x
        before, after = F.left(x, F.lit(lead)) if lead else F.lit(""), F.right(x, F.lit(trail)) if trail else F.lit("")
        return F.struct(F.lit(k).alias("k"), run.alias("run"), before.alias("before"), after.alias("after"))

    return F.transform(F.array_distinct(runs), parted)


def _keyed(words: DataFrame) -> DataFrame:
    """word, k, key, lead, trail, whole: what a text must hold for the word to be in it, the signs that must stand around that, and
    whether that is all. k counts tokens; below zero, signs."""
    pieces = F.regexp_extract_all("word", F.lit(PIECES), 0)
    tokens = F.size(F.regexp_extract_all("word", F.lit(TOKEN + "+"), 0))
    led = F.rlike("word", F.lit(rf"\A[^\p{{L}}\p{{N}}]")).cast("int")
    trailed = F.rlike("word", F.lit(rf"[^\p{{L}}\p{{N}}]\z")).cast("int")
    run = F.array_join(F.slice(F.col("pieces"), F.col("led") + 1, F.least("tokens", F.lit(RUN)) * 2 - 1), "")
    none = F.col("tokens") == 0
    w = words.withColumns({"pieces": pieces, "tokens": tokens, "led": led, "trailed": trailed})
    w = w.select("word", F.when(none, -F.least(F.length("word"), F.lit(RUN))).otherwise(F.least("tokens", F.lit(RUN))).alias("k"),
                 F.when(none, F.left("word", F.lit(RUN))).otherwise(run).alias("key"),
                 F.when(~none & (F.col("led") == 1), F.get("pieces", F.lit(0))).otherwise("").alias("lead"),
                 F.when(~none & (F.col("trailed") == 1), F.element_at("pieces", F.lit(-1))).otherwise("").alias("trail"),
                 (~none & (F.col("tokens") <= RUN)).alias("whole"))
    # words with more signs around them are looked for in the texts that have their run
    short = F.col("whole") & (F.length("lead") <= RUN) & (F.length("trail") <= RUN)
    return w.select("word", "k", "key", *(F.when(short, F.col(c)).otherwise("").alias(c) for c in ("lead", "trail")), short.alias("whole"))


def table_words(docs: DataFrame, key: str, text: str, words: DataFrame, word: str = "word") -> DataFrame:
    """(key, found): the words of the table that stand in the text as whole words, sorted, once each, for the rows that have any.

    Case counts. Null and empty words and null texts find nothing; words that repeat count once. Rows with the same key are taken
    together; rows without a key find nothing. Other columns stay behind. Texts meet words by equality of runs, so Spark may broadcast a short list by its
    own measure and shuffles both sides otherwise, splitting runs that many texts share; a text gives a row for each different run.
    """
    listed = written(_keyed(words.select(F.col(word).cast("string").alias("word")).where("word <> ''").distinct()), "words")
    # which lengths of runs occur at all, and how many signs around them: at most 2 * RUN rows
    longest = lambda c: F.max(F.length(c)).alias(c)
    kinds = sorted(listed.groupBy("k").agg(longest("lead"), longest("trail"), F.bool_and("whole").alias("whole")).collect())
    d = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("key is not null and text <> ''")
    # a blank at either end, so that texts begin and end with a gap and a word may end there
    pieces = d.select("key", F.regexp_extract_all(F.concat(F.lit(" "), "text", F.lit(" ")), F.lit(PIECES), 0).alias("pieces"))
    runs = F.array().cast("array<struct<k:int,run:string,before:string,after:string>>")
    if kinds:
        # one sign more tells whether the gap goes on behind the signs of the word
        more = lambda n: n + 1 if n else 0
        runs = F.flatten(F.array(*[_marked(F.col("pieces"), r.k, more(r.lead), more(r.trail)) for r in kinds]))
    met = pieces.select("key", F.inline(runs)).join(listed.withColumnRenamed("key", "run"), ["k", "run"])
    goes_on = lambda rest: ~F.rlike(rest, F.lit(rf"\A{TOKEN}"))
    trails = (F.col("trail") == "") | F.startswith("after", F.col("trail")) & goes_on(F.substring("after", F.length("trail") + 1, F.lit(1)))
    leads = (F.col("lead") == "") | F.endswith("before", F.col("lead")) & goes_on(
        F.substring("before", F.length("before") - F.length("lead"), F.lit(1)))
    met = met.where(trails & leads).select("key", "word", "whole")
    if not all(r.whole for r in kinds):
        met = written(met, "words-met")
        unsure = met.where("not whole").select("key", "word")
        # the second half of a sign beyond the first 65,536 is no sign of its own
        quoted = F.concat(F.lit(r"(?:\A|[^\p{L}\p{N}\p{Cs}])\Q"), F.replace(F.col("word"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(rf"\E(?!{TOKEN})"))
        met = met.where("whole").select("key", "word").unionByName(d.join(unsure, "key").where(F.rlike("text", quoted)).select("key", "word"))
    return met.groupBy("key").agg(F.array_sort(F.collect_set("word")).alias("found")).toDF(key, "found")


def with_table_words(docs: DataFrame, key: str, text: str, words: DataFrame, word: str = "word", name: str = "found") -> DataFrame:
    """The rows with the column `name`, the words found in them, null where there are none: what RuleUnsafeWords takes as its field
    `found`. The key tells rows apart; a column of that name must not be there."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name}")
    own = "key"
    while own in docs.columns or own == name:
        own += "_"
    found = table_words(docs, key, text, words, word).toDF(own, name)
    return docs.join(found, F.col(key) == F.col(own), "left").drop(own)
