"""Text and number parsing as column builders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

def strip(x: Column) -> Column:
    """Without blanks at both ends, Unicode ones too."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\A\s+", ""), r"(?U)\s+\z", "")


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def normalize(x: Column) -> Column:
    """One blank between words, none around, lower case; null becomes empty."""
    return F.lower(collapse(x))


def merge_parts(*parts: Column) -> Column:
    """Normalised parts joined by a blank; null and empty parts are left out, a blank one counts."""
    return F.concat_ws(" ", *[F.when(F.coalesce(p, F.lit("")) != "", normalize(p)) for p in parts])


def strip_html(x: Column) -> Column:
    """Tags become blanks, blanks collapse."""
    return collapse(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", " "))


def hits(text: Column, keywords: Sequence[str]) -> Column:
    """Keywords that occur in the (normalised) text, in their own order."""
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, F.lower(k)))


def looks_like(text: Column, lang: str) -> Column:
    """English: at least 4 Latin words and no fewer than Han signs.  Chinese: 2 Han signs, or 1 beside at most 10 words."""
    han, latin = F.regexp_count(text, F.lit(r"[一-鿿]")), F.regexp_count(text, F.lit("[a-zA-Z]{2,}"))
    rules = {"en": (latin >= 4) & (latin >= han), "zh": (han >= 2) | ((han >= 1) & (latin <= 10))}
    return rules.get(lang, F.lit(True))


def visual_verdict(text: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """False only where negative hints stand without a positive one."""
    return (F.size(hits(text, positive)) > 0) | (F.size(hits(text, negative)) == 0)


def classify(text: Column, lexicon: Mapping[str, Sequence[str]], default: str) -> Column:
    """``struct(category, reason)``: most hits win, the first category wins ties, no hit gives the default."""
    return let(text, lambda t: _classified(t, lexicon, default))


def _classified(text: Column, lexicon: Mapping[str, Sequence[str]], default: str) -> Column:
    scored = []
    for order, (name, words) in enumerate(lexicon.items()):
        found = hits(text, words)
        scored.append(F.struct(F.size(found).alias("n"), F.lit(-order).alias("o"), F.lit(name).alias("category"), F.array_join(F.slice(found, 1, 5), ", ").alias("reason")))
    none = F.struct(F.lit(default).alias("category"), F.lit("").alias("reason"))
    return let(F.array_max(F.array(*scored)), lambda best: F.when(best["n"] > 0, F.struct(best["category"].alias("category"), best["reason"].alias("reason"))).otherwise(none))


def safe_int(x: Column) -> Column:
    """Whole part of a number in text; whatever is none counts 0."""
    d = x.cast("string").try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) >= F.lit(9.0e18)), F.lit(0)).otherwise(F.coalesce(F.floor(F.abs(d)) * F.signum(d), F.lit(0))).cast("long")


def parse_count(x: Column) -> Column:
    """Counts with thousands commas and the units 10^4 and 10^8."""
    t = F.lower(F.replace(strip(F.coalesce(x, F.lit(""))), F.lit(","), F.lit("")))
    unit = F.substr(t, F.length(t), F.lit(1))
    scale = F.when(unit == "万", F.lit(10_000)).when(unit == "亿", F.lit(100_000_000)).otherwise(F.lit(1))
    number = F.when(scale > 1, F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t).try_cast("double") * scale
    return F.when(F.isnan(number) | (F.abs(number) >= F.lit(9.0e18)), F.lit(0)).otherwise(F.coalesce(F.floor(F.abs(number)) * F.signum(number), F.lit(0))).cast("long")


def parse_duration(x: Column) -> Column:
    """Seconds of ``h:m:s``, ``m:s`` or ``s``; other forms count 0."""
    t = strip(F.coalesce(x, F.lit("")))
    total = F.aggregate(F.split(t, ":"), F.lit(0).cast("long"), lambda a, p: a * 60 + p.try_cast("long"))
    return F.when(t.rlike(r"^\d+(:\d+){0,2}$"), F.coalesce(total, F.lit(0))).otherwise(0).cast("long")


def upload_date(x: Column) -> Column:
    """ISO date of a leading YYYYMMDD; empty where there is none."""
    return F.coalesce(F.date_format(F.try_to_date(F.substring(x, 1, 8), "yyyyMMdd"), "yyyy-MM-dd"), F.lit(""))


def split_keywords(x: Column) -> Column:
    """Distinct keywords in first-seen order; null where none is left."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[\n,，;；|]+"), strip), lambda p: p != ""))
    return F.when(F.size(parts) > 0, parts)


def effective_terms(own: Column, defaults: Sequence[str]) -> Column:
    return F.when(F.size(own) > 0, own).otherwise(F.array(*map(F.lit, defaults)))


def n_tokens(x: Column) -> Column:
    t = strip(F.coalesce(x, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+")))


def ends_sentence(x: Column) -> Column:
    return x.rlike(r"(?U)[.?!]\s*$")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def image_suffix(url: Column) -> Column:
    """The path's suffix if it is an image's, else .jpg."""
    found = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"(\.[A-Za-z0-9]+)$", 1))
    return F.when(found.isin(".jpg", ".jpeg", ".png", ".webp"), found).otherwise(".jpg")


def is_rate_limit(error: Column) -> Column:
    """Whether an error's text speaks of limits; 'rate' counts inside other words too."""
    e = F.lower(F.coalesce(error, F.lit("")))
    return F.contains(e, F.lit("429")) | F.contains(e, F.lit("rate")) | F.contains(e, F.lit("quota"))


def truthy(x: Column) -> Column:
    """As a dynamic language sees a text value: everything but null and empty is true, 'false' too."""
    return F.coalesce(x, F.lit("")) != ""


def strict_true(json: Column, path: str) -> Column:
    """Whether the value at ``path`` is the JSON literal true; the text "true" isn't."""
    v = F.try_variant_get(F.try_parse_json(json), path, "variant")
    return F.coalesce((F.schema_of_variant(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean"), F.lit(False))


def subtitle_langs(own: Column, automatic: Column) -> Column:
    """Keys of both maps, each once, the first map's first."""
    empty = F.array().cast("array<string>")
    return F.array_union(F.coalesce(F.map_keys(own), empty), F.coalesce(F.map_keys(automatic), empty))


def thumbnail(direct: Column, listed: Column) -> Column:
    """The direct address, else the last listed one, else empty."""
    some = lambda x: F.when(strip(x) != "", x)
    return F.coalesce(some(direct), some(F.try_element_at(listed, F.lit(-1))["url"]), F.lit(""))


def local_time(epoch: Column) -> Column:
    """ISO text of positive epoch seconds in the session's zone; else empty."""
    return F.when(epoch > 0, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss")).otherwise("")


def now_tag(clock: Column) -> Column:
    """A run's name from its clock."""
    return F.date_format(clock, "yyyyMMdd_HHmmss")


# The video model's six classes, by what they lead to.
RECOMMENDED = {
    "keep": ("pure_ultrasound", "hands_on_tutorial"),
    "trim": ("case_discussion", "mixed"),
    "discard": ("ppt_lecture", "diagram_animation"),
}


def recommendation(kind: Column) -> Column:
    """What a class leads to; null for an unknown one."""
    pairs = [F.lit(x) for what, kinds in RECOMMENDED.items() for k in kinds for x in (k, what)]
    return F.try_element_at(F.create_map(*pairs), kind)
