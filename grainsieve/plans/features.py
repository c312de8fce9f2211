"""Derived text columns shared by rules.

A rule asks for features by name and gets column references; the plan then adds every feature
asked for once, level by level, so that a costly expression is a column and not a copy in each
rule.  Spark keeps such projections apart because their columns are used more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.marks import WIDE, may_hold, text_signs
from ..functions.repeats import repeated_share


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once, where they stand.

    Spark copies the expressions of a projection into filters pushed below it and into inferred constraints. Features
    build on each other, so such copies would undo the sharing many times over and take planning with them. As the one
    row of a generator the values stay where they are, while filters on the other columns still move below, to the scan.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))) if columns else df


# feature -> (level, builder); a builder may use features of lower levels only
FEATURES = {
    "content": (0, None),
    # what patterns need to match, so that most texts are not searched
    "signs": (1, lambda f: text_signs(f.content)),
    "n_chars": (1, lambda f: F.length(f.content)),
    # a column of its own, as folding asks for it more than once
    "bare": (1, lambda f: T.without_punctuation(f.content)),
    "folded": (1.5, lambda f: T.fold(f.bare)),
    "tokens": (1, lambda f: T.tokens_of(f.content)),
    "lines": (1, lambda f: T.lines_of(f.content)),
    "treebank_split": (1, lambda f: T.treebank_split(f.content)),
    "treebank": (2, lambda f: T.treebank_of(f.treebank_split)),
    "tail": (1, lambda f: F.right(f.content, F.lit(100))),
    # lower case with the two letters that match s and i in case-blind patterns
    "lowered": (1, lambda f: F.translate(F.lower(f.content), "ſı", "si")),
    "norm": (2, lambda f: T.squeeze(f.folded)),
    "folded_lines": (2, lambda f: T.lines_of(f.folded)),
    "words": (3, lambda f: T.words_of(f.norm)),
    # ASCII texts are folded with their words, unless others ask for folded text
    "bare_wide": (2, lambda f: F.when(may_hold(f.signs, WIDE), T.without_punctuation(f.content))),
    "folded_wide": (2.5, lambda f: F.when(may_hold(f.signs, WIDE), T.fold(f.bare_wide)).otherwise(f.content)),
    "repeated_share": (3, lambda f: repeated_share(f.folded, F.lit(True)) if f.asked("norm", "folded_lines", "words")
                       else repeated_share(f.folded_wide, may_hold(f.signs, WIDE))),
}


class Features:
    """Column references of one record field, plus the mapped fields of the check."""

    def __init__(self, prefix: str, fields: dict[str, Column], columns: list[str]):
        self._prefix = prefix
        self._fields = fields
        self._wanted: dict[str, Column] = {}
        self.columns = columns

    def field(self, name: str) -> Column:
        """A mapped field with its own type."""
        return self._fields[name]

    def text(self, name: str) -> Column:
        return T.as_text(self._fields[name])

    def has(self, name: str) -> bool:
        return name in self._fields

    def asked(self, *names: str) -> bool:
        """Whether rules use one of the features."""
        return any(n in self._wanted for n in names)

    def column(self, key: str, level: int, build) -> Column:
        """A column of the rule's own, computed once."""
        self._wanted.setdefault(key, (level, build))
        return F.col(self._prefix + key)

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_") or name not in FEATURES:
            raise AttributeError(name)
        level, build = FEATURES[name]
        if name == "content":
            build = lambda f: f.text("content")
        if name not in self._wanted:
            self._wanted[name] = (level, build)
        return F.col(self._prefix + name)

    def add_to(self, df: DataFrame) -> DataFrame:
        """Add every wanted column, lower levels first."""
        done: dict[str, Column] = {}
        while True:
            # building a feature may ask for further ones
            open_ = {k: v for k, v in self._wanted.items() if k not in done}
            if not open_:
                break
            for k, (_, build) in open_.items():
                done[k] = build(self)
        for level in sorted({lv for lv, _ in self._wanted.values()}):
            new = {self._prefix + k: done[k] for k, (lv, _) in self._wanted.items() if lv == level}
            # level 0: mapped columns and parts of structs, which may be copied freely
            df = bind(df, new) if level else df.withColumns(new)
        return df
