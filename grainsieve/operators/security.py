"""Personal data, resident ids and word lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..functions.marks import STUCK, may_hold
from ..registry import Verdict, rule
from ..schema import strings

SECURITY = "QUALITY_BAD_SECURITY"


@rule("RuleIDCard", SECURITY, ("default", "pretrain", "benchmark"), pattern=X.ID_KEYWORDS)
def id_card(f, cfg):
    keyword = "(?iu)" + T.java(cfg.pattern)
    number = "(?<=[^0-9a-zA-Z])(" + T.java(X.ID_NUMBER) + ")(?=[^0-9a-zA-Z])"
    edged = F.concat(F.lit("#"), f.content, F.lit("#"))
    # most texts fail the first, cheapest test
    bad = (F.rlike(f.content, F.lit("[1-9][0-9]{5}(?:18|19|20)"))
           & F.rlike(edged, F.lit(number)) & F.rlike(f.content, F.lit(keyword)))
    return Verdict(bad,
                   T.find_all(edged, number, 1))


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def mask_default(v: Column) -> Column:
    n = F.length(v)
    return F.when(n <= 7, stars(n)).otherwise(
        F.concat(F.left(v, F.lit(3)), stars(n - 7), F.right(v, F.lit(4))))


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, r"[^\p{Nd}]+", "")


def mask(kind: str, v: Column) -> Column:
    """The shown form of a finding."""
    if kind == "email":
        at = F.instr(v, "@")
        user = F.left(v, at - 1)
        hidden = F.when(at <= 3, stars(at - 1)).otherwise(F.concat(F.left(user, F.lit(1)), stars(at - 2)))
        return F.concat(hidden, F.substring(v, at, F.length(v)))
    if kind == "cn_phone":
        return F.concat(F.left(v, F.lit(3)), F.lit("****"), F.right(v, F.lit(4)))
    if kind == "cn_id_card":
        return F.concat(F.left(v, F.lit(6)), F.lit("********"), F.right(v, F.lit(4)))
    if kind == "credit_card":
        d = digits_of(v)
        return F.concat(stars(F.length(d) - 4), F.right(d, F.lit(4)))
    if kind == "ip_address":
        parts = F.split(v, r"\.")
        return F.concat(F.get(parts, F.lit(0)), F.lit(".***.***."), F.get(parts, F.lit(3)))
    return mask_default(v)


def holds(kind: str, v: Column) -> Column:
    if kind == "credit_card":
        return T.luhn_ok(digits_of(v))
    if kind == "ip_address":
        return F.forall(F.split(v, r"\."), lambda p: p.cast("int") <= 255)
    return F.lit(True)


def kind_findings(content: Column, kind: str, severity: str, caption: str, body: str) -> Column:
    hits = T.find_all(content, T.BORDER_L + T.java(body) + T.BORDER_R)
    if kind in ("credit_card", "ip_address"):
        hits = F.filter(hits, lambda v: holds(kind, v))
    return F.transform(hits, lambda v: F.struct(
        F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(caption).alias("caption"),
        mask(kind, v).alias("masked")))


def pii_findings(content: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """array<struct<type, severity, caption, masked>> in the order of the kinds; only the kinds asked for are searched."""
    found = F.concat(*[kind_findings(content, *k) for k in X.PII_KINDS if not kinds or k[0] in kinds])
    # every kind has a digit or an at sign
    return F.when(F.rlike(content, F.lit(r"[@\p{Nd}]")), found)


@rule("RulePIIDetection", SECURITY, ("default", "pretrain", "benchmark"))
def pii_detection(f, cfg):
    found = f.column("pii", 2, lambda f_: pii_findings(f_.content))

    def line(severity: str, caption: str) -> Column:
        items = F.filter(found, lambda x: x["severity"] == severity)
        shown = F.transform(items, lambda x: F.concat(x["caption"], F.lit("("), x["masked"], F.lit(")")))
        return F.when(F.size(items) > 0, F.concat(F.lit(caption + ": "), F.array_join(shown, ", ")))

    n = F.when(found.isNull(), 0).otherwise(F.size(found))
    return Verdict(n > 0, F.array_compact(F.array(*[line(*s) for s in X.SEVERITY_CAPTIONS])), measure=n)


def redact(content: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """The text with each finding replaced by its shown form, kind by kind in their order."""
    def without(text: Column, kind: str, body: str) -> Column:
        hits = F.array_distinct(T.find_all(text, T.BORDER_L + T.java(body) + T.BORDER_R))
        hits = F.filter(hits, lambda v: holds(kind, v))
        return F.aggregate(hits, text, lambda t, v: F.replace(t, v, mask(kind, v)))

    for kind, _, _, body in X.PII_KINDS:
        if not kinds or kind in kinds:
            content = without(content, kind, body)
    return content


def pii_table(df: DataFrame, id_col: str, text_col: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """One row per finding: (id, type, severity, masked)."""
    found = df.select(F.col(id_col), F.explode(pii_findings(T.as_text(F.col(text_col)), kinds)).alias("x"))
    return found.select(id_col, "x.type", "x.severity", "x.masked")


# --- word lists ----------------------------------------------------------------------------

#: Signs of a word list that every Python worker may hold; longer lists are joined.
LIST_SIGNS = 16 << 20


def word_table(spark, paths) -> DataFrame:
    """Words of JSON-lines files with a ``word`` key."""
    return spark.read.schema("word string").json(list(paths)).where("word is not null")


def read_word_list(paths) -> tuple[str, ...]:
    """Words of JSON-lines files, read by the Spark session in use, once their size is known."""
    from pyspark.sql import SparkSession
    words = word_table(SparkSession.getActiveSession(), paths)
    signs = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    if signs > LIST_SIGNS:
        raise ValueError(f"{signs} signs of words are too many for every worker: add the words found by "
                         "word_tables.with_table_words and set found on RuleUnsafeWords")
    return tuple(r.word for r in words.collect())


def automaton_matches(words: tuple[str, ...]):
    """Arrow function: whole-word hits of a long list, one automaton per Python worker."""
    from pyspark.sql import SparkSession
    spread = SparkSession.getActiveSession().sparkContext.broadcast(words)

    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick
        machine = ahocorasick.Automaton()
        for w in spread.value:
            machine.add_word(w, w)
        machine.make_automaton()

        def hits(t: str) -> list[str]:
            out = set()
            for end, w in machine.iter(t):
                before, after = t[max(end - len(w), 0):end - len(w) + 1], t[end + 1:end + 2]
                if len(w) > end:
                    before = ""
                if not before.isalnum() and not after.isalnum():
                    out.add(w)
            return sorted(out)

        for batch in texts:
            yield batch.map(hits)

    return F.pandas_udf(find, "array<string>")


@rule("RuleUnsafeWords", SECURITY)
def unsafe_words(f, cfg):
    """By a list of words, or, with the setting found, by the field found that `word_tables.with_table_words` adds."""
    if cfg.option("found", False):
        return Verdict(F.size(f.field("found")) > 0, f.field("found"))
    words = cfg.key_list or (read_word_list(cfg.refer_path) if cfg.refer_path else ())
    words = tuple(sorted({w for w in words if w}))
    if not words:
        return Verdict(F.lit(False))
    found = f.column("unsafe", 2, lambda f_: automaton_matches(words)(f_.content))
    return Verdict(F.size(found) > 0, found)


# --- stuck words ---------------------------------------------------------------------------

# fixed values: what is cut out before words are looked at, and what separates words
STUCK_LINKS = r"https?://[^\s]+|www.[a-z!$-_]+"
# a word's beginning is where the last match ended or where no word goes on
STUCK_FILES = [r"\.pdf(?=\n?\z)", r"(?:\G|(?<!\w))\w++\.bat", r"/.*/.*"]
# the last cut, which may join pieces but not across what separates words
STUCK_DIGITS = "[0-7]+"
STUCK_SPLIT = r"[⁃>#%-.—,–!?;:\s|_/=\\@()\[\].*?]\s*"


#: Letters that a piece must have more of, at least.
STUCK_LENGTH = 45


def stuck_rest(f) -> Column:
    """The text without links and files; it may be empty where it holds neither such nor a long run, so that no piece can be long."""
    plain = T.where_any(f.content, ["http", "www"], F.regexp_replace(f.content, T.java(STUCK_LINKS), ""), f.content)

    def without_files(text: Column) -> Column:
        return T.where_any(text, [".pdf", ".bat", "/"], reduce(lambda c, p: F.regexp_replace(c, T.java(p), ""), STUCK_FILES, text), text)

    def rest(f_) -> Column:
        cut = F.get(F.transform(F.array(plain), without_files), F.lit(0))
        # the signs are told in Python, which this rule alone does without
        return F.when(may_hold(f_.signs, STUCK), cut).otherwise("") if f_.asked("signs") else cut

    return f.column("stuck_rest", 2, rest)


def stuck_candidates(rest: Column) -> Column:
    """Mostly Latin pieces longer than 45 characters that are no SHA-256, of a text without what is cut out but its digits."""
    edge = T.char_class(X.ASCII_PUNCTUATION)
    # edges are cut off the few long ones only, and only texts with a long run that some separators leave whole are taken apart
    apart = r"\n !(),./:;?|-"
    run = rf"\A(?:[^{apart}]{{0,{STUCK_LENGTH}}}+[{apart}]++)*+[^{apart}]{{{STUCK_LENGTH + 1}}}"
    long_ = F.when(F.rlike(rest, F.lit(run)), F.filter(
        F.split(F.regexp_replace(rest, STUCK_DIGITS, ""), T.java(STUCK_SPLIT), -1), lambda x: F.length(x) > STUCK_LENGTH)).otherwise(
        F.array().cast("array<string>"))
    pieces = F.transform(long_,
                         lambda x: F.regexp_replace(x, f"^{edge}+|{edge}+\\z", ""))
    return F.filter(pieces, lambda x: (F.length(x) > STUCK_LENGTH)
                    & ~F.rlike(x, F.lit(r"\A[A-Fa-f0-9]{64}\z"))
                    & (F.regexp_count(x, F.lit("[A-Za-z]")) / F.length(x) > 0.5))


def segmenter(words: tuple[str, ...]):
    """Arrow function: first piece that the word list, most frequent first, cuts in two or more.

    Costs follow Zipf's law; characters outside the list cost more than any word.
    """
    from math import log

    from pyspark.sql import SparkSession
    costs = {w: log((i + 1) * log(max(len(words), 2))) for i, w in enumerate(words)}
    spread = SparkSession.getActiveSession().sparkContext.broadcast(costs)

    def first_stuck(column: pd.Series) -> pd.Series:
        cost = spread.value
        longest = max(map(len, cost))

        def parts(s: str) -> int:
            best = [(0.0, 0)]
            for i in range(1, len(s) + 1):
                best.append(min(
                    (best[j][0] + cost.get(s[j:i], 9e9 * (i - j)), best[j][1] + 1)
                    for j in range(max(0, i - longest), i)))
            return best[-1][1]

        return column.map(lambda xs: next((x for x in xs if parts(x.lower()) > 1), None))

    return F.pandas_udf(first_stuck, "string")


@rule("RuleWordStuck", "QUALITY_BAD_FLUENCY", ("text_base_all", "llm_base", "multi_lan_ar", "multi_lan_ko",
      "multi_lan_ru", "multi_lan_th", "multi_lan_vi", "multi_lan_cs", "multi_lan_hu", "multi_lan_sr"))
def word_stuck(f, cfg):
    """The first long piece that words, most frequent first, cut in two or more.

    A piece longer than every word of a list is always cut, so Python is asked only where the list has words as long as that. Without a list
    no word is taken to be so long.
    """
    words = tuple(cfg.option("words", ()))
    rest = stuck_rest(f)
    pieces = f.column("stuck_pieces", 3, lambda f_: stuck_candidates(rest))
    if max(map(len, words), default=0) <= STUCK_LENGTH:
        hit = F.get(pieces, F.lit(0))
    else:
        hit = f.column("stuck_hit", 4, lambda f_: segmenter(words)(pieces))
    return Verdict(hit.isNotNull(), strings(hit))
