"""Rules and judges.  Importing the modules registers them."""


def load_all() -> None:
    from . import boxes, duplicates, judges, media, records, resume, scores, security, table_judges, text_rules  # noqa: F401
