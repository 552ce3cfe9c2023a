"""Shared fixtures: odd rows that every operator must take, and plain Python versions of shared rules."""

import re

DOC_COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, ids=None, extra=""):
    """A documents table; ``extra`` adds columns whose names clash with those the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    schema = DOC_COLUMNS
    if extra:
        names = extra.split()
        rows = [r + tuple(k for _ in names) for k, r in enumerate(rows)]
        schema += "".join(f", {n} bigint" for n in names)
    return spark.createDataFrame(rows, schema)


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text))


def blank(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower_az(text))


ODD = [None, "", "   \n\t", "one", "É É é x y 1́", "$$$ !!", "word " * 30000, "tie tie", "tie tie"]
