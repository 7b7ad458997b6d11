"""JSON out of model text: direct, fenced, outermost span, then what can be recovered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import strict_true, strip

# The three checks of a validated row.
CHECKS = ("question_no_leak", "not_answerable_at_query_time", "answerable_at_answer_time")


@dataclass(frozen=True)
class Ladder:
    """Which rungs a parser has.

    ``kind``: object or array.  ``typed``: direct text of another JSON type ends the search (null).
    ``fence_first``: a fenced block stands before the direct text.  ``greedy``: the span reaches to the
    last bracket.  ``json_fence_only``: a fence must name json.  The
    other flags are said beside them.
    """

    kind: str = "object"
    typed: bool = False
    fence_first: bool = False
    greedy: bool = True
    fence: bool = True
    json_fence_only: bool = False
    flat: bool = False  # an object without inner braces is looked for before the outermost span
    loose: bool = False  # fences hold any JSON; one that names json stands before a bare one
    either: bool = False  # the span is of an array or an object, and a flat object is looked for behind it


# The parsers of the stages, by what they read.
VALIDATOR = Ladder()
LEGACY_VALIDATOR = Ladder(greedy=False)
OFFLINE = Ladder(typed=True)
STREAMING = Ladder("array", typed=True)
LEGACY_OFFLINE = Ladder("array", json_fence_only=True)
DUAL = Ladder(fence_first=True)
CUTS = Ladder(fence=False)
FRAME = Ladder(flat=True, loose=True)
ABLATION = Ladder(loose=True, either=True)


def _whole(x: Column) -> Column:
    """Whether the text is one JSON value and nothing more: the parser stops after the first value, so the
    text is read as the only element of a list."""
    return let(F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))), lambda v: v.isNotNull() & F.try_variant_get(v, "$[0]", "variant").isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull())


def repaired(text: Column, ladder: Ladder) -> Column:
    """The JSON text that the ladder finds; null if there is none."""
    low, high = (r"\{", r"\}") if ladder.kind == "object" else (r"\[", r"\]")
    valid = lambda x: F.when(_whole(x), x)
    direct = valid(text)
    tag = "json" if ladder.json_fence_only else "(?:json)?"
    some = lambda pattern, group: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))
    fenced = valid(some(rf"(?s)```{tag}\s*({low}.+?{high})\s*```", 1)) if ladder.fence else F.lit(None).cast("string")
    span = valid(some(rf"(?s)({low}.*{'' if ladder.greedy else '?'}{high})", 1))
    if ladder.loose:
        inside = lambda pattern: valid(strip(some(pattern, 1)))
        fenced = F.coalesce(inside(r"(?s)```json\s*(.+?)```"), inside(r"(?s)```\s*(.+?)```"))
    if ladder.either:
        span = F.coalesce(valid(some(r"(?s)[\{\[].*[\}\]]", 0)), valid(some(r"\{[^{}]*\}", 0)))
    if ladder.flat:
        span = F.coalesce(valid(some(r"\{[^{}]*\}", 0)), span)
    rungs = (fenced, direct, span) if ladder.fence_first else (direct, fenced, span)
    out = F.coalesce(*rungs)
    if ladder.typed:
        own = F.ltrim(direct).startswith("{" if ladder.kind == "object" else "[")
        out = F.when(direct.isNotNull(), F.when(own, direct)).otherwise(F.coalesce(fenced, span))
    return F.when(F.coalesce(text, F.lit("")) != "", out)


def frame_answer(text: Column) -> Column:
    """A frame model's object; one that says the text couldn't be read, and its beginning, where there is none."""
    failed = F.to_json(F.struct(F.lit("解析失败").alias("帧类型"), F.substring(text, 1, 300).alias("原始输出")))
    return F.coalesce(repaired(text, FRAME), failed)


def or_error(found: Column, text: Column, **more: Column) -> Column:
    """What was found; else an object with ``more``, ``_parse_error`` and the text's beginning."""
    row = [c.alias(name) for name, c in more.items()] + [F.lit(True).alias("_parse_error"), F.substring(text, 1, 500).alias("_raw")]
    return F.coalesce(found, F.to_json(F.struct(*row)))


def ablation_answer(text: Column) -> Column:
    return or_error(repaired(text, ABLATION), text)


def cuts_answer(text: Column) -> Column:
    """A cut verifier's object; empty lists of cuts where there is none."""
    none = F.array().cast("array<string>")
    return or_error(repaired(text, CUTS), text, final_cuts=none, additional_cuts=none)


def rating_answer(text: Column) -> Column:
    """A segmentation judge's object; score 0 where there is none."""
    return or_error(repaired(text, CUTS), text, overall_score=F.lit(0))


def legacy_verdict(text: Column) -> Column:
    """``struct(verdict, reason)`` of the older validator; of a text that breaks off, what stands there of both."""
    both = F.struct(repaired(text, LEGACY_VALIDATOR).alias("found"), recovered_verdict(text).alias("late"), F.regexp_extract(text, r'"reason"\s*:\s*"([^"]*)', 1).alias("why"))
    whole = lambda x: F.struct(F.get_json_object(x["found"], "$.verdict").alias("verdict"), F.coalesce(F.get_json_object(x["found"], "$.reason"), F.lit("")).alias("reason"))
    part = lambda x: F.when(x["late"] != "", F.struct(x["late"].alias("verdict"), F.concat(x["why"], F.lit(" [truncated]")).alias("reason")))
    return let(both, lambda x: F.when(x["found"].isNotNull(), whole(x)).otherwise(part(x)))


def recovered_verdict(text: Column) -> Column:
    """A verdict that stands in broken text; empty if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r'"verdict"\s*:\s*"(pass|fail)"', 1)


def verdict(text: Column, ladder: Ladder = VALIDATOR) -> Column:
    """``struct(verdict, reason, overridden, checks...)``: all three checks literally true make a pass.

    Where the model's own verdict differs the checks decide and the reason says so.  Text beyond repair
    gives its recovered verdict no checks, so it fails; without any verdict all is null.
    """
    both = F.struct(repaired(text, ladder).alias("found"), recovered_verdict(text).alias("late"))
    return let(both, lambda x: _decided(x["found"], x["late"]))


def _decided(found: Column, late: Column) -> Column:
    told = F.lower(F.coalesce(F.get_json_object(found, "$.verdict"), late))
    checks = [F.coalesce(strict_true(found, f"$.checks.{c}"), F.lit(False)) for c in CHECKS]
    decided = F.when(checks[0] & checks[1] & checks[2], "pass").otherwise("fail")
    reason = F.when(found.isNull(), F.lit("[truncated]")).otherwise(F.coalesce(F.get_json_object(found, "$.reason"), F.lit("")))
    note = F.concat(F.lit(" [checks decide: "), told, F.lit(" -> "), decided, F.lit("]"))
    out = F.struct(decided.alias("verdict"), F.concat(reason, F.when(told != decided, note).otherwise("")).alias("reason"), (told != decided).alias("overridden"), *[c.alias(n) for c, n in zip(checks, CHECKS, strict=True)])
    return F.when(found.isNotNull() | (late != ""), out)


def usage(text: Column) -> Column:
    """Token counts and cost of a usage document; what is missing counts 0."""
    at = lambda path, kind: F.coalesce(F.get_json_object(text, path).try_cast(kind), F.lit(0).cast(kind))
    return F.struct(at("$.prompt_tokens", "long").alias("prompt_tokens"), at("$.prompt_tokens_details.video_tokens", "long").alias("video_tokens"), at("$.cost", "decimal(18,6)").alias("cost"))
