"""Labels of anchored answers: WAIT, ANSWER, OTHER, ERROR."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import n_tokens, strip

# Labels, and the phrases that mean waiting.
LABELS = ("WAIT", "ANSWER", "OTHER", "ERROR")
WAIT_PHRASES = (
    "not enough information",
    "need more information",
    "need more context",
    "cannot answer yet",
    "can't answer yet",
    "more video is needed",
    "more context is needed",
)
WAIT_PREFIX, ANSWER_PREFIX = r"(?i)^\s*<\s*WAIT\s*>", r"(?i)^\s*<\s*ANSWER\s*>"


def strip_prefix(x: Column) -> Column:
    """Without one leading answer mark and then one leading wait mark."""
    t = F.regexp_replace(strip(F.coalesce(x, F.lit(""))), rf"{ANSWER_PREFIX}\s*", "")
    return strip(F.regexp_replace(t, rf"{WAIT_PREFIX}\s*", ""))


def truth(target: Column) -> Column:
    """WAIT if the target begins with the exact wait mark, else ANSWER."""
    return F.when(F.startswith(F.upper(strip(F.coalesce(target, F.lit("")))), F.lit("<WAIT>")), "WAIT").otherwise("ANSWER")


def predicted(text: Column, phrases_first: bool = False) -> Column:
    """Label of a model's text.  An answer mark stands before wait phrases, unless ``phrases_first``."""
    t = strip(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    waits = F.exists(F.array(*map(F.lit, WAIT_PHRASES)), lambda p: F.contains(low, p))
    marked = (waits, F.lit("WAIT")), (t.rlike(ANSWER_PREFIX), F.lit("ANSWER"))
    out = F.when(t == "", "OTHER").when(t.rlike(WAIT_PREFIX), "WAIT")
    for rule, label in marked if phrases_first else marked[::-1]:
        out = out.when(rule, label)
    return out.when(n_tokens(t) >= 3, "ANSWER").otherwise("OTHER")


def known(label: Column) -> Column:
    return F.when(label.isin(*LABELS), label).otherwise("OTHER")
