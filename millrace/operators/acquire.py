"""Candidates: query plans, first-wins dedup, the filter cascade, resuming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.binding import let
from ..sources import files, ports

# Folder of each category.
CATEGORY_FOLDERS = {"扫查教学型": "scan_tutorial", "病例讲解型": "case_reasoning", "器官系统教学型": "organ_system_lecture", "待人工分类": "uncategorized"}
SEARCH_MODES = ("ytsearch", "ytsearchdate")
# What is put before and behind an organ in a search term; most seeds; pages that a video may also be found under.
BEFORE_ORGAN, BEFORE_YEAR = "POCUS ", (" ultrasound tutorial ", " pocus scan ")
MOST_SEEDS = 7000
PAGES = ("https://www.youtube.com/watch?v=%s", "https://www.youtube.com/shorts/%s", "https://www.youtube.com/watch?v=%s&bpctr=9999999999&has_verified=1")


def years_back(year: int, span: int = 9, first: int = 2016) -> list[int]:
    """``year`` and those before it, not before ``first``."""
    return [y for y in range(first, year + 1) if y >= year - span][::-1]


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def query_plan(bases: DataFrame, organs: DataFrame, focuses: DataFrame, years: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """Ordered distinct search terms (``term, mode, ord``) from products of small word tables.

    Word tables have ``word, ord``.  For every base: itself, with each organ before it, with each focus
    and year after it; then the organs with focuses and years.  A term's first place counts.
    """
    b, o, f, y = (d.select(F.col("word").alias(n), F.col("ord").alias(f"{n}_ord")) for d, n in ((bases, "b"), (organs, "o"), (focuses, "f"), (years, "y")))
    at = lambda *x: F.array(*[F.lit(v).cast("long") if isinstance(v, int) else F.col(v).cast("long") for v in x])
    blank = F.lit(" ")
    parts = [
        b.select(F.col("b").alias("term"), at(0, "b_ord").alias("at")),
        b.crossJoin(F.broadcast(o)).select(F.concat("o", blank, "b").alias("term"), at(1, "b_ord", 0, "o_ord").alias("at")),
        b.crossJoin(F.broadcast(f)).select(F.concat("b", blank, "f").alias("term"), at(1, "b_ord", 1, "f_ord").alias("at")),
        b.crossJoin(F.broadcast(y)).select(F.concat("b", blank, "y").alias("term"), at(1, "b_ord", 2, "y_ord").alias("at")),
        o.crossJoin(F.broadcast(f)).select(F.concat(F.lit(BEFORE_ORGAN), "o", blank, "f").alias("term"), at(2, "o_ord", 0, "f_ord").alias("at")),
        o.crossJoin(F.broadcast(y)).select(F.concat("o", F.lit(BEFORE_YEAR[0]), "y").alias("term"), at(2, "o_ord", 1, "y_ord", 0).alias("at")),
        o.crossJoin(F.broadcast(y)).select(F.concat("o", F.lit(BEFORE_YEAR[1]), "y").alias("term"), at(2, "o_ord", 1, "y_ord", 1).alias("at")),
    ]
    terms = parts[0]
    for p in parts[1:]:
        terms = terms.unionByName(p)
    terms = terms.withColumn("term", T.strip(F.col("term"))).where("term <> ''").groupBy("term").agg(F.min("at").alias("at"))
    modes = F.array(*[F.struct(F.lit(k).alias("m"), F.lit(m).alias("mode")) for k, m in enumerate(SEARCH_MODES)])
    plan = terms.select("term", "at", F.inline(modes))
    if channels is not None:
        plan = plan.unionByName(channels.select(F.col("word").alias("term"), F.array(F.lit(3).cast("long"), F.col("ord").cast("long")).alias("at"), F.lit(0).alias("m"), F.lit("channel").alias("mode")))
    return plan.select("term", "mode", (F.row_number().over(Window.orderBy("at", "m")) - 1).alias("ord"))


def target_size(keep: Column | int, factor: int = 4) -> Column:
    """How many seeds to look for: at least 50, at most 300, room over what is wanted."""
    k = F.lit(keep) if isinstance(keep, int) else keep
    return F.least(F.greatest(k + 30, k * factor, F.lit(50)), F.lit(300))


def cascade(rows: DataFrame, text: Column, lang: str, domain: Sequence[str], positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    """``reject_reason``: language, then domain, then looks; null for what stays."""
    first = lambda t: F.when(~T.looks_like(t, lang), "language").when(F.size(T.hits(t, domain)) == 0, "domain").when(~T.visual_verdict(t, positive, negative), "visual")
    reason = let(T.normalize(text), first)
    return rows.withColumn("reject_reason", reason)


def keep_until(rows: DataFrame, kept: Column, order: str, n: int) -> DataFrame:
    """All rows up to the ``n``-th kept one, as a loop that stops there would have seen.

    The place of the n-th kept row is one number; no running count passes through a single task.
    """
    marked = rows.withColumn("kept", kept)
    last = marked.where("kept").select(order).orderBy(order).limit(n).agg(F.max(order).alias("_last"), F.count("*").alias("_n"))
    return marked.crossJoin(F.broadcast(last)).where((F.col("_n") < n) | (F.col(order) <= F.col("_last"))).drop("_last", "_n")


def remaining(inputs: DataFrame, done: DataFrame, key: str, retry: Column | None = None) -> DataFrame:
    """Inputs without a finished result; results that ``retry`` names don't count as finished."""
    return inputs.join(done if retry is None else done.where(~retry), key, "left_anti")


def over_seed(seed: DataFrame, detail: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Seed rows with their detail's values where those say something (neither null, empty nor 0)."""
    some = lambda c: F.when(~F.col(f"d.{c}").cast("string").isin("", "0"), F.col(f"d.{c}"))
    joined = seed.alias("s").join(detail.alias("d"), F.col(f"s.{key}") == F.col(f"d.{key}"), "left")
    return joined.select(*[F.coalesce(some(c), F.col(f"s.{c}")).alias(c) if c in columns else F.col(f"s.{c}") for c in seed.columns])


def folder(category: Column) -> Column:
    pairs = [F.lit(x) for item in CATEGORY_FOLDERS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category), F.lit("uncategorized"))


def has_both_tracks(formats: Column) -> Column:
    """Whether some format has sound and picture."""
    real = lambda c: F.coalesce(~c.isin("", "none"), F.lit(False))
    return F.coalesce(F.exists(formats, lambda f: real(f["acodec"]) & real(f["vcodec"])), F.lit(False))


def signature(config: dict, spark: SparkSession | None = None) -> str:
    """A digest of a run's settings, whatever their order."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def search_query(mode: Column, per_term: Column | int, term: Column) -> Column:
    """How a search for so many results is written."""
    n = F.lit(per_term) if isinstance(per_term, int) else per_term
    return F.concat(mode, n.cast("string"), F.lit(":"), term)


def page_urls(video_id: Column) -> Column:
    """A video's address and those to try where it gives nothing."""
    return F.array(*[F.format_string(p, video_id) for p in PAGES])


def refill_target(seeds: Column, per_term: Column, ahead: Column) -> Column:
    """Up to how many seeds to search: fewer where the queue is only running low (``ahead``) than where it is empty."""
    more = F.when(ahead, F.greatest(per_term * 8, F.lit(80))).otherwise(F.greatest(per_term * 10, F.lit(120)))
    return F.least(seeds + more, F.lit(MOST_SEEDS))


def refill_due(seeds: Column, processed: Column, per_term: Column) -> Column:
    """Whether the queue is running low."""
    return seeds - processed <= F.greatest(per_term, F.lit(20))


def collect_seeds(plan: DataFrame, search: Callable[[], Callable[[str], list[dict]]], target: int, per_term: int, seeds: DataFrame | None = None, cursor: int = 0, block: int = 64, root: str | None = None) -> tuple[DataFrame, int]:
    """Seeds ``(id, title, ord)`` up to ``target`` from the searches of ``plan`` behind ``cursor``, and the new cursor.

    Searches go out in blocks, in the plan's order; the first seed of an id counts, and a search that fails
    gives none.  ``root`` is where the rounds are stored.  At most ``MOST_SEEDS`` seeds are ever gathered.
    """
    spark = plan.sparkSession
    target, last = min(target, MOST_SEEDS), plan.agg(F.max("ord")).first()[0]
    root = root or files.scratch(spark, "seeds")
    seeds = spark.createDataFrame([], "id string, title string, ord long") if seeds is None else seeds
    n = seeds.count()
    while n < target and last is not None and cursor <= last:
        terms = plan.where((F.col("ord") >= cursor) & (F.col("ord") < cursor + block)).withColumn("target", search_query(F.col("mode"), per_term, F.col("term")))
        said = ports.each(terms, ["target"], search, "list_search").where("result IS NOT NULL")
        found = said.select(F.col("ord").cast("long").alias("page"), F.posexplode(F.from_json("result", "array<struct<id:string,title:string>>")).alias("pos", "v"))
        rows = found.select("v.id", "v.title", (F.lit(n) + F.col("page") * 100_000 + F.col("pos")).alias("ord")).where("id IS NOT NULL")
        both = first_wins(seeds.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1))), ["id"], ["_new", "ord"])
        place = F.row_number().over(Window.orderBy("_new", "ord")) - 1  # MOST_SEEDS rows and a block of searches at most
        kept = both.withColumn("ord", place.cast("long")).drop("_new").where(F.col("ord") < target)
        kept.write.mode("overwrite").parquet(f"{root}/{cursor}")
        seeds = spark.read.parquet(f"{root}/{cursor}")
        n, cursor = seeds.count(), cursor + block
    return seeds, cursor


def until_enough(plan: DataFrame, search: Callable, keep: Callable[[DataFrame], DataFrame], n: int, per_term: int, root: str | None = None) -> DataFrame:
    """Seeds that ``keep`` lets through, up to ``n``: the queue is refilled from the plan while it gives too few."""
    spark = plan.sparkSession
    target = spark.range(1).select(target_size(n).alias("t")).first()["t"]
    seeds, cursor = collect_seeds(plan, search, target, per_term, root=root)
    while True:
        kept = keep(seeds).orderBy("ord").limit(n)
        have = seeds.count()
        if kept.count() >= n or have >= MOST_SEEDS:
            return kept
        more = spark.range(1).select(refill_target(F.lit(have), F.lit(per_term), F.lit(False)).alias("t")).first()["t"]
        seeds, cursor = collect_seeds(plan, search, more, per_term, seeds, cursor, root=root)
        if seeds.count() <= have:
            return kept
