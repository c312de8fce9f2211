"""Resume rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..registry import Verdict, rule
from ..schema import strings

P = "RESUME_QUALITY_BAD_"
GROUP = ("resume",)


def bordered(body: str) -> str:
    return T.BORDER_L + T.java(body) + T.BORDER_R


def first(c, p):
    return F.regexp_substr(c, F.lit(p))


@rule("RuleResumeIDCard", P + "PRIVACY", GROUP)
def id_card(f, cfg):
    p = bordered(X.RESUME["id"])
    hit = first(f.content, p)
    masked = F.concat(F.lit("Found ID card number: "), F.left(hit, F.lit(6)), F.lit("****"), F.right(hit, F.lit(4)))
    return Verdict(F.rlike(f.content, F.lit(p)), strings(masked))


@rule("RuleResumeDetailedAddress", P + "PRIVACY", GROUP, pattern=X.RESUME["address"])
def detailed_address(f, cfg):
    p = T.java(cfg.pattern)
    return Verdict(F.rlike(f.content, F.lit(p)),
                   strings(F.concat(F.lit("Found detailed address: "), first(f.content, p))))


@rule("RuleResumeEmailMissing", P + "CONTACT", GROUP)
def email_missing(f, cfg):
    found = F.contains(f.content, F.lit("@")) & F.rlike(f.content, F.lit(bordered(X.RESUME["email"])))
    return Verdict(~found, strings("Email address not found in resume"))


@rule("RuleResumePhoneMissing", P + "CONTACT", GROUP, pattern=X.RESUME["phone"])
def phone_missing(f, cfg):
    return Verdict(~F.rlike(f.content, F.lit(T.java(cfg.pattern))), strings("Phone number not found in resume"))


@rule("RuleResumePhoneFormat", P + "CONTACT", GROUP)
def phone_format(f, cfg):
    numbers = T.find_all(f.content, bordered(X.RESUME["phone_number"]))
    wrong = f.column("wrong_phones", 2, lambda f_: F.filter(numbers, lambda n: ~F.rlike(n, F.lit("^1[3-9]"))))
    return Verdict(F.size(wrong) > 0,
                   strings(F.concat(F.lit("Invalid phone format: "), F.array_join(wrong, ", "))),
                   measure=F.size(wrong))


@rule("RuleResumeExcessiveWhitespace", P + "FORMAT", GROUP, pattern=X.RESUME["blanks"], threshold=3)
def excessive_whitespace(f, cfg):
    n = T.count_matches(f.content, T.java(cfg.pattern))
    return Verdict(n >= cfg.threshold, strings(F.concat(
        F.lit("Found "), n.cast("string"), F.lit(" instances of excessive whitespace"))), measure=n)


@rule("RuleResumeMarkdown", P + "FORMAT", GROUP, pattern=X.RESUME["markdown"])
def markdown(f, cfg):
    p = T.java(cfg.pattern)
    return Verdict(F.rlike(f.content, F.lit(p)),
                   strings(F.concat(F.lit("Markdown syntax error: "), first(f.content, p))))


@rule("RuleResumeNameMissing", P + "STRUCTURE", GROUP)
def name_missing(f, cfg):
    top = F.left(f.content, F.lit(200))
    return Verdict(~F.rlike(top, F.lit("(?m)" + T.java(X.RESUME["heading"]))),
                   strings("Name or heading not found in the first section"))


@rule("RuleResumeSectionMissing", P + "STRUCTURE", GROUP, pattern=X.RESUME["section"], threshold=1)
def section_missing(f, cfg):
    n = T.count_matches(f.lowered, T.java(cfg.pattern))
    return Verdict(n < cfg.threshold, strings("Required sections (education/experience) not found"), measure=n)


@rule("RuleResumeEmoji", P + "PROFESSIONALISM", GROUP, pattern=X.RESUME["emoji"])
def emoji(f, cfg):
    n = T.count_matches(f.content, cfg.pattern)
    return Verdict(n > 0, strings(F.concat(F.lit("Found "), n.cast("string"), F.lit(" emoji characters"))), measure=n)


@rule("RuleResumeInformal", P + "PROFESSIONALISM", GROUP, pattern=X.RESUME["informal"])
def informal(f, cfg):
    found = F.array_sort(F.array_distinct(T.find_all(f.content, T.java(cfg.pattern))))
    return Verdict(F.rlike(f.content, F.lit(T.java(cfg.pattern))),
                   strings(F.concat(F.lit("Found informal language: "), F.array_join(found, ", "))))


@rule("RuleResumeDateFormat", P + "DATE", GROUP, pattern=X.RESUME["date"])
def date_format(f, cfg):
    dates = f.column("dates", 2, lambda f_: T.find_all(f_.content, T.java(cfg.pattern)))
    kinds = F.size(F.array_distinct(F.transform(dates, lambda d: F.regexp_substr(d, F.lit("[-./年]")))))
    return Verdict(kinds > 1, strings(F.concat(
        F.lit("Inconsistent date formats found: "), F.array_join(F.array_distinct(dates), ", "))), measure=kinds)


@rule("RuleResumeEducationMissing", P + "COMPLETENESS", GROUP, pattern=X.RESUME["education"])
def education_missing(f, cfg):
    return Verdict(~F.rlike(f.lowered, F.lit(T.java(cfg.pattern))),
                   strings("Education section not found in resume"))


@rule("RuleResumeExperienceMissing", P + "COMPLETENESS", GROUP, pattern=X.RESUME["experience"])
def experience_missing(f, cfg):
    return Verdict(~F.rlike(f.lowered, F.lit(T.java(cfg.pattern))),
                   strings("Work experience section not found in resume"))
