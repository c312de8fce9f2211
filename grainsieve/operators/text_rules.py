"""Rules over one text column."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, functions as F

from ..functions import fixed as X
from ..functions import marks as M
from ..functions import text as T
from ..registry import ML8, MULTI_LANGUAGES, RuleConfig, Verdict, rule
from ..schema import strings
from .sentences import treebank_words

EFFECTIVENESS = "QUALITY_BAD_EFFECTIVENESS"
FLUENCY = "QUALITY_BAD_FLUENCY"
UNDERSTANDABILITY = "QUALITY_BAD_UNDERSTANDABILITY"
SIMILARITY = "QUALITY_BAD_SIMILARITY"
RELEVANCE = "QUALITY_BAD_RELEVANCE"
COMPLETENESS = "QUALITY_BAD_COMPLETENESS"


def say(text: str, value: Column) -> Column:
    return strings(F.concat(F.lit(text), value.cast("string")))


def share(part: Column, whole: Column) -> Column:
    """part / whole as double, null where there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole)


def span(cfg: RuleConfig) -> tuple[int, int]:
    low, high = cfg.key_list[:2]
    return int(low), int(high)


def unless(f, sign: int, value: Column, other: Column) -> Column:
    """A value told by patterns, which are tried only on texts that may hold a sign they need, and one for the others."""
    return F.when(M.may_hold(f.signs, sign), value).otherwise(other)


def ends_with(line: Column, marks) -> Column:
    return F.rlike(line, F.lit(f"(?:{T.any_of(list(marks))})[{X.SPACE}]*\\z"))


# --- emptiness, length, white space --------------------------------------------------------

@rule("RuleContentNull", EFFECTIVENESS,
      ("default", "sft", "pretrain", "benchmark", "text_base_all", "llm_base", *ML8, "qa_standard_v1", "pdf"))
def content_null(f, cfg):
    return Verdict(T.is_blank(f.content), strings("Content is empty."))


@rule("RuleContentShort", EFFECTIVENESS, ("text_base_all", "qa_standard_v1", "pdf"), threshold=20)
def content_short(f, cfg):
    n = F.octet_length(f.content)
    return Verdict(n <= cfg.threshold, strings("Content is too short."), measure=n)


@rule("RuleContentShortMultiLan", EFFECTIVENESS, ML8, threshold=20)
def content_short_multi_lan(f, cfg):
    # tokens of letters only; a text is read up to the token that makes it long enough, all of them only where they are to be told
    alpha = rf"\p{{L}}++(?![{X.WORD}])"
    other = rf"(?:[^{X.WORD}]++|(?!{alpha})[{X.WORD}]++)*+"
    enough = F.rlike(f.content, F.lit(rf"\A(?:{other}{alpha}){{{max(0, ceil(cfg.threshold))}}}+"))
    n = F.size(F.array_remove(T.find_all(f.content, rf"({alpha})|[{X.WORD}]++", 1), ""))
    return Verdict(~enough, strings("Content is too short."), measure=n)


@rule("RuleCharNumber", EFFECTIVENESS, ("pretrain",), threshold=100)
def char_number(f, cfg):
    n = f.column("visible_chars", 2, lambda f_: F.length(F.translate(T.strip(f_.content), " \n\t", "")))
    return Verdict(n < cfg.threshold, say("The number of char is: ", n), measure=n)


@rule("RuleColonEnd", EFFECTIVENESS, ("default", "sft", "pretrain", "benchmark", "llm_base", "text_base_all"))
def colon_end(f, cfg):
    return Verdict(F.endswith(f.content, F.lit(":")), strings(F.right(f.content, F.lit(100))),
                   applies=f.content != "")


@rule("RuleEnterMore", EFFECTIVENESS, ("text_base_all", "llm_base", *ML8, "pdf"),
      key_list=[r"\n{8,}", r"\r\n{8,}"])
def enter_more(f, cfg):
    bad = F.lit(False)
    for p in cfg.key_list:
        bad = bad | F.rlike(f.content, F.lit(T.java(p)))
    if set(cfg.key_list) <= {r"\n{8,}", r"\r\n{8,}"}:
        bad = unless(f, M.BREAKS, bad, F.lit(False))
    return Verdict(bad, strings("Content has 8 consecutive carriage returns."))


@rule("RuleEnterRatioMore", EFFECTIVENESS, ("text_base_all", "llm_base", *ML8, "pdf"), threshold=0.25)
def enter_ratio_more(f, cfg):
    r = share(T.occurrences(f.content, "\n"), f.n_chars)
    bad = r > cfg.threshold
    if cfg.threshold >= 0.25:
        bad = unless(f, M.LINES, bad, F.lit(False))
    return Verdict(bad, strings("The number of enter / the number of content > 25%."),
                   applies=f.n_chars > 0, measure=r)


@rule("RuleSpaceMore", EFFECTIVENESS, ("text_base_all", "llm_base", *ML8, "pdf"), pattern=" {500,}")
def space_more(f, cfg):
    bad = F.rlike(f.content, F.lit(T.java(cfg.pattern)))
    if cfg.pattern == " {500,}":
        bad = unless(f, M.SPACES, bad, F.lit(False))
    return Verdict(bad, strings("Content has 500 spaces."))


@rule("RuleOnlyUrl", EFFECTIVENESS, ("text_base_all", "llm_base", *ML8, "qa_standard_v1", "pdf"),
      pattern=r"https?://[a-z!$-_]+")
def only_url(f, cfg):
    rest = F.regexp_replace(f.content, T.java(cfg.pattern), "")
    filled = ~T.is_blank(f.content)
    bad = filled & T.is_blank(rest)
    if cfg.pattern == r"https?://[a-z!$-_]+":
        bad = unless(f, M.URL, bad, F.lit(False))
    return Verdict(bad, strings("Content is only an url link."), applies=filled)


# --- characters ----------------------------------------------------------------------------

@rule("RuleSpecialCharacter", EFFECTIVENESS,
      ("default", "sft", "pretrain", "benchmark", "text_base_all", "llm_base", *ML8, "pdf"),
      key_list=X.SPECIAL_PATTERNS, threshold=0.01)
def special_character(f, cfg):
    patterns = [T.java(p) for p in cfg.key_list]
    n = F.lit(0)
    for p, given in zip(patterns, cfg.key_list):
        hits = T.count_matches(f.content, p)
        n = n + (T.where_any(f.content, X.SPECIAL_SIGNS[given], hits, F.lit(0)) if given in X.SPECIAL_SIGNS else hits)
    if set(cfg.key_list) <= set(X.SPECIAL_SIGNS):
        n = unless(f, M.SPECIAL, n, F.lit(0))
    r = share(f.column("special_hits", 2, lambda f_: n), f.n_chars)
    found = F.array_sort(F.array_distinct(F.flatten(F.array(*[T.find_all(f.content, p) for p in patterns]))))
    return Verdict(r >= cfg.threshold, found, applies=f.n_chars > 0, measure=r)


@rule("RuleInvisibleChar", EFFECTIVENESS, ("text_base_all", *ML8), pattern=f"[{X.INVISIBLE}]", threshold=0.01)
def invisible_char(f, cfg):
    hits = T.count_matches(f.content, cfg.pattern)
    if cfg.pattern == f"[{X.INVISIBLE}]":
        # none is in ASCII, which is passed over in other texts
        hits = unless(f, M.WIDE, T.count_matches(f.content, f"(?![\\x00-\\x9f]){cfg.pattern}"), F.lit(0))
    r = share(hits, f.n_chars)
    found = F.transform(F.array_sort(F.array_distinct(T.find_all(f.content, cfg.pattern))),
                        lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.encode(c, "UTF-16BE")), 4, "0")))
    return Verdict(r >= cfg.threshold, found, applies=f.n_chars > 0, measure=r)


@rule("RuleAbnormalChar", EFFECTIVENESS, ("qa_standard_v1",))
def abnormal_char(f, cfg):
    return either(f, "RuleSpecialCharacter", "RuleInvisibleChar")


@rule("RuleHtmlEntity", EFFECTIVENESS,
      ("default", "sft", "pretrain", "benchmark", "text_base_all", *ML8, "pdf"),
      key_list=X.HTML_ENTITIES, threshold=0.01)
def html_entity(f, cfg):
    # an entity with its semicolon is counted as such and once more by its beginning
    head = f"[&＆](?:{T.any_of(list(cfg.key_list))})"
    hits = f.column("entity_hits", 2, lambda f_: unless(f_, M.ENTITY, T.where_any(f_.content, "&＆", T.count_matches(
        f_.content, head) + T.count_matches(f_.content, head + "[;；]"), F.lit(0)), F.lit(0)))
    r = share(hits, f.n_chars)
    found = F.array_sort(F.array_distinct(F.concat(
        T.find_all(f.content, head), T.find_all(f.content, head + "[;；]"))))
    return Verdict(r >= cfg.threshold, found, applies=f.n_chars > 0, measure=r)


@rule("RuleHtmlTag", EFFECTIVENESS, ("text_base_all", *ML8, "pdf"), key_list=X.HTML_TAGS, threshold=0.01)
def html_tag(f, cfg):
    p = "|".join(cfg.key_list)
    hits = T.count_matches(f.content, p)
    if all(map(T.is_plain, cfg.key_list)):
        hits = T.where_any(f.content, cfg.key_list, hits, F.lit(0))
        if all("<" in k for k in cfg.key_list):
            hits = unless(f, M.TAG, hits, F.lit(0))
    r = share(hits, f.n_chars)
    return Verdict(r >= cfg.threshold, F.array_sort(F.array_distinct(T.find_all(f.content, p))),
                   applies=f.n_chars > 0, measure=r)


@rule("RuleAbnormalHtml", EFFECTIVENESS, ("qa_standard_v1",))
def abnormal_html(f, cfg):
    return either(f, "RuleHtmlEntity", "RuleHtmlTag")


@rule("RuleEnterAndSpace", EFFECTIVENESS, ("qa_standard_v1",))
def enter_and_space(f, cfg):
    return either(f, "RuleEnterMore", "RuleEnterRatioMore", "RuleSpaceMore")


def either(f, *names: str) -> Verdict:
    """Bad if any of the named rules is; the reasons of the bad ones are strung together."""
    from ..registry import RULES
    parts = [RULES[n].build(f, RULES[n].defaults) for n in names]
    bad = [F.coalesce(p.bad, F.lit(False)) for p in parts]
    any_bad = bad[0]
    for b in bad[1:]:
        any_bad = any_bad | b
    none = F.array().cast("array<string>")
    reasons = F.concat(*[F.when(b, p.reason.cast("array<string>")).otherwise(none) for b, p in zip(bad, parts)])
    return Verdict(any_bad, reasons)


@rule("RuleCurlyBracket", UNDERSTANDABILITY, (), threshold=0.025)
def curly_bracket(f, cfg):
    r = share(T.occurrences(f.content, "{") + T.occurrences(f.content, "}"), f.n_chars)
    return Verdict(r > cfg.threshold, say("The ratio of curly bracket and characters is : ", r),
                   applies=f.n_chars > 0, measure=r)


# --- patterns ------------------------------------------------------------------------------

@rule("RuleAbnormalNumber", FLUENCY, ("pdf_all",), pattern=r"\n{4}\d+\n{4}")
def abnormal_number(f, cfg):
    p = T.java(cfg.pattern)
    hit = F.regexp_replace(F.regexp_substr(f.content, F.lit(p)), r"^\n+|\n+\z", "")
    return Verdict(F.rlike(f.content, F.lit(p)), strings(hit))


@rule("RuleCharSplit", FLUENCY, ("pdf_all",), pattern=r"(?:(?:[a-zA-Z]\s){5}[a-zA-Z])", threshold=3)
def char_split(f, cfg):
    p = T.java(cfg.pattern)
    n = T.count_matches(f.content, p)
    return Verdict(n >= cfg.threshold, T.find_all(f.content, p), measure=n)


@rule("RuleLatexSpecialChar", EFFECTIVENESS, ("pdf_all",), pattern=r"\$\$(.*?!!.*?)\$\$")
def latex_special_char(f, cfg):
    p = T.java(cfg.pattern)
    return Verdict(F.rlike(f.content, F.lit(p)), strings(F.regexp_substr(f.content, F.lit(p))))


@rule("RuleWordSplit", FLUENCY, ("pdf_all",), pattern=r"[A-Za-z]+-\s*\z")
def word_split(f, cfg):
    p = T.java(cfg.pattern)
    return Verdict(F.rlike(f.content, F.lit(p)), T.find_all(f.content, p))


@rule("RulePatternSearch", RELEVANCE)
def pattern_search(f, cfg):
    if not cfg.pattern:
        raise ValueError("RulePatternSearch needs a pattern")
    p = T.java(cfg.pattern)
    return Verdict(F.rlike(f.content, F.lit(p)), T.find_all(f.content, p), measure=T.count_matches(f.content, p))


@rule("RuleWatermark", RELEVANCE)
def watermark(f, cfg):
    if not cfg.key_list:
        raise ValueError("RuleWatermark needs a key_list")
    p = T.java("|".join(cfg.key_list))
    return Verdict(F.rlike(f.content, F.lit(p)), T.find_all(f.content, p), measure=T.count_matches(f.content, p))


def _head_word(lang: str):
    def build(f, cfg):
        words = T.java("|".join(cfg.key_list))
        return Verdict(F.rlike(f.tail, F.lit(words)), strings("Content has irrelevance tail source info."))
    return build


for _lang in MULTI_LANGUAGES:
    rule(f"RuleHeadWord{_lang.capitalize()}", RELEVANCE, (f"multi_lan_{_lang}",),
         key_list=X.HEAD_WORDS[_lang])(_head_word(_lang))


# --- tokens and words ----------------------------------------------------------------------

@rule("RuleAlphaWords", EFFECTIVENESS, ("pretrain",), threshold=0.6)
def alpha_words(f, cfg):
    """``key_list`` takes abbreviations, as `sentences.learn_abbreviations` finds them, whose stops end no sentence."""
    words = treebank_words(f, cfg.key_list) if cfg.key_list else f.treebank
    n = F.size(F.filter(words, lambda t: F.rlike(t, F.lit(r"\p{L}"))))
    r = share(n, F.size(words)) if cfg.key_list else f.column("alpha_share", 3, lambda f_: share(n, F.size(f_.treebank)))
    return Verdict(~(r > cfg.threshold),
                   say("The ratio of words that contain at least one alphabetic character is: ", r),
                   applies=F.size(words) > 0, measure=r)


@rule("RuleCapitalWords", UNDERSTANDABILITY, ("pretrain",), threshold=0.2)
def capital_words(f, cfg):
    upper = F.filter(f.tokens, lambda t: F.rlike(t, F.lit(r"\p{IsUppercase}"))
                     & ~F.rlike(t, F.lit(r"[\p{IsLowercase}\p{IsTitlecase}]")))
    r = f.column("capital_share", 2, lambda f_: share(F.size(upper), F.size(f_.tokens)))
    return Verdict((r > cfg.threshold) & (F.size(f.tokens) < 200), say("ratio: ", r),
                   applies=F.size(f.tokens) > 0, measure=r)


@rule("RuleStopWord", EFFECTIVENESS, ("pretrain",), threshold=0.06, key_list=X.STOP_WORDS)
def stop_word(f, cfg):
    hits = F.filter(f.tokens, lambda t: F.lower(t).isin(*cfg.key_list))
    n = f.column("stop_hits", 2, lambda f_: F.size(hits))
    r = share(n, F.size(f.tokens))
    return Verdict((r < cfg.threshold) | (n < 2), say("The ratio of stop words is: ", r),
                   applies=F.size(f.tokens) > 0, measure=r)


@rule("RuleSymbolWordRatio", EFFECTIVENESS, ("pretrain", "benchmark"), threshold=0.4, key_list=X.SYMBOLS)
def symbol_word_ratio(f, cfg):
    n = F.lit(0)
    for mark in cfg.key_list:
        n = n + T.occurrences(f.content, mark)
    r = share(n, F.size(f.tokens))
    return Verdict(r > cfg.threshold, say("The ratio of symbol / word is: ", r),
                   applies=F.size(f.tokens) > 0, measure=r)


@rule("RuleWordNumber", COMPLETENESS, ("pretrain",), key_list=["20", "100000"])
def word_number(f, cfg):
    low, high = span(cfg)
    n = F.size(f.words)
    return Verdict(~((n >= low) & (n < high)), say("The number of word is: ", n), measure=n)


@rule("RuleMeanWordLength", EFFECTIVENESS, ("pretrain",), key_list=["3", "10"])
def mean_word_length(f, cfg):
    low, high = span(cfg)
    chars = F.length(F.replace(f.norm, F.lit(" "), F.lit("")))
    exact = share(chars, F.size(f.words))
    mean = F.round(exact, 2)
    return Verdict(~((mean >= low) & (mean < high)), say("The mean length of word is: ", mean),
                   applies=F.size(f.words) > 0, measure=exact)


@rule("RuleUniqueWords", UNDERSTANDABILITY, ("pretrain",), threshold=0.1)
def unique_words(f, cfg):
    r = f.column("unique_share", 4, lambda f_: share(F.size(F.array_distinct(f_.words)), F.size(f_.words)))
    return Verdict(~(r > cfg.threshold), say("The ratio of unique words is: ", r),
                   applies=F.size(f.words) > 0, measure=r)


@rule("RuleLoremIpsum", EFFECTIVENESS, ("pretrain", "benchmark"), threshold=3e-8)
def lorem_ipsum(f, cfg):
    r = share(T.count_matches(f.norm, "(?iu)lorem ipsum"), F.length(f.norm))
    return Verdict(r > cfg.threshold, say("The ratio of lorem ipsum is: ", r),
                   applies=f.norm != "", measure=r)


@rule("RuleNoPunc", FLUENCY,
      ("default", "sft", "pretrain", "benchmark", "text_base_all", "llm_base", *ML8), threshold=112)
def no_punc(f, cfg):
    breaks = T.char_class("\n" + X.SENTENCE_BREAKS)
    blank = f"(?:(?![\n!-~])[{X.SPACE}])+"
    top = f.column("longest_stretch", 1, lambda f_: M.longest_stretch(f_.content).cast("int"))
    # the stretch itself is looked for in bad texts only
    counts = F.transform(F.split(F.regexp_replace(f.content, blank, " "), breaks, -1), words_in)
    longest = T.strip(F.get(F.split(f.content, breaks, -1), F.array_position(counts, top).cast("int") - 1))
    return Verdict(top > cfg.threshold, strings(longest), measure=top)


def words_in(stretch: Column) -> Column:
    """Words of a stretch whose blanks are single."""
    s = F.trim(stretch)
    return F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)


@rule("RuleSentenceNumber", COMPLETENESS, ("pretrain",), key_list=["3", "7500"])
def sentence_number(f, cfg):
    # a sentence starts at the first word character of a stretch without a terminator
    low, high = span(cfg)
    n = f.column("sentences", 2, lambda f_: T.count_matches(f_.content, f"[{X.WORD}][^.!?\n]*"))
    return Verdict((n < low) | (n > high), say("The number of sentence is: ", n), measure=n)


# --- lines ---------------------------------------------------------------------------------

@rule("RuleLineEndWithEllipsis", COMPLETENESS, ("pretrain", "benchmark"), threshold=0.3, key_list=X.ELLIPSES)
def line_end_with_ellipsis(f, cfg):
    hits = F.filter(f.lines, lambda x: ends_with(x, cfg.key_list))
    r = f.column("ellipsis_share", 2, lambda f_: share(F.size(hits), F.size(f_.lines)))
    return Verdict(r > cfg.threshold, say("The ratio of lines end with ellipsis is: ", r),
                   applies=F.size(f.lines) > 0, measure=r)


@rule("RuleLineEndWithTerminal", COMPLETENESS, ("pretrain",), threshold=0.6, key_list=X.TERMINALS)
def line_end_with_terminal(f, cfg):
    hits = F.filter(f.lines, lambda x: ends_with(x, cfg.key_list))
    r = f.column("terminal_share", 2, lambda f_: share(F.size(hits), F.size(f_.lines)))
    others = F.filter(f.lines, lambda x: ~ends_with(x, cfg.key_list))
    last = F.array_sort(F.array_distinct(F.transform(others, lambda x: F.right(T.strip(x), F.lit(1)))))
    return Verdict(r < cfg.threshold, last, applies=F.size(f.lines) > 0, measure=r)


@rule("RuleLineStartWithBulletpoint", UNDERSTANDABILITY, ("sft", "pretrain", "benchmark"),
      threshold=0.9, key_list=X.BULLETS)
def line_start_with_bulletpoint(f, cfg):
    start = f"\\A[{X.SPACE}]*(?:{T.any_of(list(cfg.key_list))})"
    hits = F.filter(f.lines, lambda x: F.rlike(x, F.lit(start)))
    r = f.column("bullet_share", 2, lambda f_: share(F.size(hits), F.size(f_.lines)))
    return Verdict(r > cfg.threshold, say("The ratio of lines start with bulletpoint is: ", r),
                   applies=F.size(f.lines) > 0, measure=r)


@rule("RuleLineJavascriptCount", EFFECTIVENESS, ("pretrain", "benchmark"), threshold=3)
def line_javascript_count(f, cfg):
    n = F.size(f.folded_lines)
    hits = f.column("script_lines", 3, lambda f_: F.size(
        F.filter(f_.folded_lines, lambda x: F.contains(x, F.lit("javascript")))))
    return Verdict((n - hits < cfg.threshold) & (n > 3),
                   say("The lines with the word Javascript is: ", hits), applies=n > 0, measure=hits)


# --- repetition ----------------------------------------------------------------------------

@rule("RuleDocRepeat", SIMILARITY,
      ("default", "sft", "pretrain", "benchmark", "text_base_all", "llm_base", *ML8, "pdf"), threshold=80)
def doc_repeat(f, cfg):
    score = f.repeated_share
    return Verdict(score >= cfg.threshold, say("Repeatability of text is too high, with ratio： ", score),
                   measure=score)


@rule("RuleDocFormulaRepeat", SIMILARITY, ("default", "pdf"), threshold=20)
def doc_formula_repeat(f, cfg):
    # both kinds of delimiters are two characters long
    formulas = f.column("formulas", 2, lambda f_: F.transform(
        T.find_all(f_.content, r"(?s)\$\$.*?\$\$|\\\(.*?\\\)"),
        lambda m: T.strip(F.substring(m, F.lit(3), F.length(m) - 4))))
    runs = f.column("formula_runs", 3, lambda f_: T.find_all(
        F.array_join(formulas, "\n"), r"(?d)(.{2,20}?)\1+"))
    n = F.length(F.array_join(runs, ""))
    reason = F.concat(
        F.lit("Formula has too many consecutive repeated characters, total repeat length: "), n.cast("string"),
        F.lit(", found "), F.size(runs).cast("string"), F.lit(" repeat patterns"))
    return Verdict(n >= cfg.threshold, strings(reason), applies=F.size(formulas) > 0, measure=n)
