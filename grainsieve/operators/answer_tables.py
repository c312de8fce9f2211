"""Lists out of the answers of judge models: companies of a scout's answer, sources of fact checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as X, text as T
from .judges import company_score
from .judging import items, unfence, unthink, value

_PARTS = ", ".join(f"{k}: struct<score: double>" for k in X.SCOUT_WEIGHTS)
COMPANY = (f"name string, match_score double, tier string, financial_status string, scoring_breakdown struct<{_PARTS}>, "
           "financial_evidence struct<confidence: double, conflicting_signals: string, source_quotes: array<string>>")


def tier_of(score: Column) -> Column:
    first, second = X.SCOUT_TIERS
    return F.when(score >= first, "Tier 1").when(score >= second, "Tier 2").otherwise("Not Recommended")


def company_lists(df: DataFrame, key: str, answer: str) -> DataFrame:
    """key, list, place, name, match_score, tier, note: the companies of each answer, in its lists target, insufficient and
    not_recommended, with their places from 0.

    Companies that shrink are not recommended (note: the first 50 signs of the first quote). Of the others, those with evidence held
    for less than one half sure are insufficient; the rest are targets, best score first and in the answer's order where scores are
    equal. Conflicting signals (note) make a target Tier 2. The answer's own entries of the two other lists follow. Companies
    without evidence count as half sure, those without a name as Unknown. Answers that are no object, and null ones, give no rows.
    """
    text = F.regexp_substr(unfence(unthink(F.col(answer))), F.lit(r"(?s)\{.*\}"))
    nested = value(text, "strategy_context").isNotNull()
    given = lambda name, ddl: F.when(nested, items(text, ddl, f"strategy_context.{name}")).otherwise(items(text, ddl, name))
    signals = lambda c: F.nullif(c["financial_evidence"]["conflicting_signals"], F.lit(""))

    def placed(c: Column, at: Column) -> Column:
        sure = F.when(c["financial_evidence"].isNull(), 0.5).otherwise(F.coalesce(c["financial_evidence"]["confidence"], F.lit(0.0)))
        shrinks = F.coalesce(c["financial_status"], F.lit("unknown")) == "contraction"
        name = F.when(shrinks, "not_recommended").when(sure < 0.5, "insufficient").otherwise("target")
        target = name == "target"
        score = company_score(c)
        tier = F.when(c["scoring_breakdown"].isNull(), F.coalesce(c["tier"], F.lit("Tier 2"))).otherwise(tier_of(score))
        note = F.when(shrinks, F.left(F.get(c["financial_evidence"]["source_quotes"], F.lit(0)), F.lit(50))).when(target, signals(c))
        return F.struct(name.alias("list"), F.when(target, -score).alias("order"), at.alias("at"),
                        F.coalesce(c["name"], F.lit("Unknown")).alias("name"), F.when(target, score).alias("match_score"),
                        F.when(target, F.when(signals(c).isNotNull(), "Tier 2").otherwise(tier)).alias("tier"), note.alias("note"))

    def named(name: str, entries: str) -> Column:
        nothing = lambda kind: F.lit(None).cast(kind)
        return F.transform(given(entries, "name string"), lambda c, i: F.struct(
            F.lit(name).alias("list"), nothing("double").alias("order"), (i + (1 << 30)).alias("at"),
            F.coalesce(c["name"], F.lit("Unknown")).alias("name"), nothing("double").alias("match_score"),
            nothing("string").alias("tier"), nothing("string").alias("note")))

    every = F.array_sort(F.concat(F.transform(given("target_companies", COMPANY), placed), named("insufficient", "insufficient_data"),
                                  named("not_recommended", "not_recommended")))
    rows = df.select(F.col(key).alias("key"), F.col(answer).alias("answer"), every.alias("every"))
    of = lambda name: F.filter("every", lambda c: c["list"] == name)
    lists = F.concat(*[F.transform(of(name), lambda c, i: F.struct(
        c["list"].alias("list"), i.alias("place"), c["name"].alias("name"), c["match_score"].alias("match_score"), c["tier"].alias("tier"),
        c["note"].alias("note"))) for name in ("target", "insufficient", "not_recommended")])
    return rows.select("key", F.inline(lists)).withColumnRenamed("key", key)


def cited_sources(answer: Column) -> Column:
    """Addresses of the section SOURCES of an agent's answer: its lines with a bullet and those that are addresses, up to the next section.
    Without the section there are none."""
    lines = F.transform(F.split(answer, "\n"), T.strip)
    begin = F.array_position(F.transform(lines, lambda x: F.startswith(F.upper(x), F.lit("SOURCES:"))), True)
    rest = F.when(begin > 0, F.slice(lines, begin.cast("int") + 1, F.size(lines)))
    stop = F.array_position(F.transform(rest, lambda x: F.rlike(x, F.lit(X.AGENT_SECTIONS))), True).cast("int")
    inside = F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest)
    shown = F.filter(inside, lambda x: F.rlike(x, F.lit(X.SOURCE_LINE)))
    urls = F.transform(shown, lambda x: T.strip(F.regexp_replace(x, r"\A[-• ]+", "")))
    return F.coalesce(F.filter(urls, lambda x: x != ""), F.array().cast("array<string>"))


def claim_sources(answer: Column) -> Column:
    """Sources of the answer on one claim: the list of its flat JSON object, else what stands in the list, cut off or not, parted by commas."""
    flat = F.regexp_substr(answer, F.lit(r'(?s)\{[^{}]*"verification_result"[^{}]*\}'))
    body = F.regexp_extract(answer, r'(?s)"sources"\s*:\s*\[([^\]]*+)', 1)
    loose = F.transform(F.split(body, ","), lambda x: F.btrim(T.strip(x), F.lit('"')))
    return F.when(F.try_parse_json(flat).isNotNull(), F.from_json(value(flat, "sources"), "array<string>")).otherwise(
        F.when(F.contains(answer, F.lit('"sources"')), F.filter(loose, lambda x: x != "")))


def is_chinese(text: Column) -> Column:
    """More than a tenth of the signs other than white space are common Chinese characters; blank and null texts are not."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]")) / F.nullif(F.regexp_count(text, F.lit(T.NOT_SPACE)), F.lit(0)) > 0.1,
                      F.lit(False))
