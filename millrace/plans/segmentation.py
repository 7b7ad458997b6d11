"""Segmentation queries over the test tables with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segment
from ..sources.tables import SEGMENTS_SQL, seconds, segments, table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {SEGMENTS_SQL}, g AS (SELECT *, CASE WHEN start - lag("end") OVER w >= 600 THEN 1 ELSE 0 END AS cut FROM seg WINDOW w AS (PARTITION BY video ORDER BY ord)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY video ORDER BY ord) AS session FROM g),
c AS (SELECT video, session, min(start) AS start, arg_max("end", ord) AS "end", count(*) AS n FROM s GROUP BY 1, 2)
SELECT video, (row_number() OVER (PARTITION BY video ORDER BY start, "end") - 1)::INT AS clip_idx, start, "end", n FROM c WHERE "end" - start >= 100""")
def seg_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions closed by silence."""
    return segment.by_gap(segments(spark, sf_dir), 600, 100).select("video", "clip_idx", "start", "end", "n")


@query(f"""WITH RECURSIVE {SEGMENTS_SQL},
w AS (SELECT *, coalesce(regexp_matches(lag(text) OVER (PARTITION BY video ORDER BY ord), '[.?!]$'), true) OR regexp_matches(text, '^[A-Z]') AS begins FROM seg),
f AS (
  SELECT video, ord, CASE WHEN begins THEN start END AS s, "end" AS e, CASE WHEN begins THEN ord END AS first FROM w WHERE ord = 0
  UNION ALL
  SELECT w.video, w.ord, CASE WHEN f.s IS NOT NULL AND w.start - f.s <= 3000 AND w.start - f.e < 1500 THEN f.s WHEN w.begins THEN w.start END, w."end",
         CASE WHEN f.s IS NOT NULL AND w.start - f.s <= 3000 AND w.start - f.e < 1500 THEN f.first WHEN w.begins THEN w.ord END
  FROM f JOIN w ON w.video = f.video AND w.ord = f.ord + 1),
c AS (SELECT video, first, min(s) AS start, arg_max(e, ord) AS "end", count(*) AS n FROM f WHERE first IS NOT NULL GROUP BY 1, 2)
SELECT video, (row_number() OVER (PARTITION BY video ORDER BY start, "end") - 1)::INT AS clip_idx, start, "end", n FROM c WHERE "end" - start >= 600""")
def seg_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips from sentence starts to silences, none begun too long ago."""
    return segment.capped(segments(spark, sf_dir), 600, 3000, 1500).select("video", "clip_idx", "start", "end", "n")


@query(f"""WITH {SEGMENTS_SQL},
cut AS (SELECT video, ord, 't' || (ord % 7 + CASE WHEN event_id % 2 = 0 THEN 100 ELSE 0 END) AS topic FROM seg WHERE event_id % 9 = 0 AND video % 5 <> 0),
m AS (SELECT seg.*, cut.topic, cut.ord IS NOT NULL AS cut, sum(CASE WHEN cut.ord IS NOT NULL AND seg.ord > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY seg.video ORDER BY seg.ord) AS part FROM seg LEFT JOIN cut USING (video, ord)),
p AS (SELECT video, part, arg_min(start, ord) AS start, arg_max("end", ord) AS "end", count(*) AS n, arg_min_null(topic, ord) AS own, bool_or(cut) AS has FROM m GROUP BY 1, 2),
q AS (SELECT *, bool_or(has) OVER (PARTITION BY video) AS any_cut, lead(part) OVER w IS NOT NULL AS later, lead(own) OVER w AS next_topic FROM p WINDOW w AS (PARTITION BY video ORDER BY part))
SELECT video, (row_number() OVER (PARTITION BY video ORDER BY start, "end") - 1)::INT AS clip_idx, start, "end", n, CASE WHEN NOT any_cut THEN 'no_cuts' WHEN later THEN 'llm_verified' ELSE 'end_of_video' END AS reason,
  CASE WHEN NOT any_cut THEN 'full_video' WHEN later THEN coalesce(next_topic, '') ELSE 'last' END AS topic FROM q WHERE NOT any_cut OR "end" - start >= 1000""")
def seg_llm_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips between a model's cuts; an additional cut's topic counts over a final one's."""
    s = segments(spark, sf_dir)
    at = s.where("event_id % 9 = 0 AND video % 5 <> 0")
    final = at.select("video", "ord", F.concat(F.lit("t"), F.col("ord") % 7).alias("topic"), F.lit(0).alias("additional"))
    more = at.where("event_id % 2 = 0").select("video", "ord", F.concat(F.lit("t"), F.col("ord") % 7 + 100).alias("topic"), F.lit(1).alias("additional"))
    return segment.by_cuts(s, final.unionByName(more), "last", 1000).select("video", "clip_idx", "start", "end", "n", "reason", "topic")


_CUTS = f"""{SEGMENTS_SQL}, ch AS (SELECT DISTINCT video, start AS moment FROM seg WHERE event_id % 6 = 0),
near AS (SELECT c.video, c.moment, s.ord, abs(s."end" - c.moment) AS dist FROM ch c JOIN seg s ON s.video = c.video AND regexp_matches(s.text, '[.?!]\\s*$') AND abs(s."end" - c.moment) <= 300),
cut AS (SELECT DISTINCT video, arg_min(ord, (dist, ord)) AS ord FROM near GROUP BY video, moment)"""


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = segments(spark, sf_dir)
    return s, segment.nearest_cuts(s, s.where("event_id % 6 = 0").select("video", F.col("start").alias("time")), 300)


@query(f"WITH {_CUTS} SELECT video, ord::INT AS ord FROM cut")
def nearest_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence end closest to each scene change."""
    return _changes(spark, sf_dir)[1]


_MERGED = f"""{_CUTS},
w AS (SELECT seg.*, cut.ord IS NOT NULL AS cut, max(seg.ord) OVER (PARTITION BY video) AS last FROM seg LEFT JOIN cut USING (video, ord)),
f AS (
  SELECT video, ord, start AS s, 0::BIGINT AS first, cut AND "end" - start >= 900 AS closes, "end" AS e, last FROM w WHERE ord = 0
  UNION ALL
  SELECT w.video, w.ord, CASE WHEN f.closes THEN w.start ELSE f.s END, CASE WHEN f.closes THEN w.ord ELSE f.first END,
         w.cut AND w."end" - CASE WHEN f.closes THEN w.start ELSE f.s END >= 900, w."end", w.last
  FROM f JOIN w ON w.video = f.video AND w.ord = f.ord + 1),
m AS (SELECT video, s, e, ord - first + 1 AS n, CASE WHEN closes THEN 'scene_change' ELSE 'end_of_video' END AS reason FROM f WHERE closes OR (ord = last AND e - s >= 900))"""
_NUMBERED = """SELECT video, (row_number() OVER (PARTITION BY video ORDER BY s, e) - 1)::INT AS clip_idx, s AS start, e AS "end", n::BIGINT AS n, reason"""


@query(f"WITH RECURSIVE {_MERGED} {_NUMBERED} FROM m")
def seg_hist_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clips over those cuts; spans that are too short go on."""
    return segment.merged(*_changes(spark, sf_dir), min_len=900, max_len=1e9).select("video", "clip_idx", "start", "end", "n", "reason")


@query(f"""WITH RECURSIVE {_MERGED},
own AS (SELECT m.video, m.s AS cs, m.e AS ce, row_number() OVER (PARTITION BY m.video, m.s, m.e ORDER BY seg.ord) - 1 AS i, seg.start, seg."end", regexp_matches(seg.text, '[.?!]\\s*$') AS stops
        FROM m JOIN seg ON seg.video = m.video AND seg.start >= m.s AND seg."end" <= m.e WHERE m.e - m.s > 2500),
g AS (
  SELECT video, cs, ce, i, 0::BIGINT AS first, NULL::BIGINT AS back, NULL::DOUBLE AS s, NULL::DOUBLE AS e, NULL::BIGINT AS n FROM own WHERE i = 0
  UNION ALL
  SELECT * FROM (SELECT video, cs, ce, i, CASE WHEN cut THEN old + 1 ELSE was END AS first, CASE WHEN stops AND i > CASE WHEN cut THEN old + 1 ELSE was END THEN i WHEN NOT cut THEN old END AS back,
                         CASE WHEN cut THEN s END AS s, CASE WHEN cut THEN e END AS e, CASE WHEN cut THEN old - was + 1 END AS n
    FROM (SELECT o.video, o.cs, o.ce, o.i, o.stops, g.first AS was, g.back AS old, p.start AS s, b."end" AS e, o."end" - p.start >= 2500 AND g.back IS NOT NULL AS cut
      FROM g JOIN own o ON o.video = g.video AND o.cs = g.cs AND o.ce = g.ce AND o.i = g.i + 1 LEFT JOIN own p ON p.video = g.video AND p.cs = g.cs AND p.ce = g.ce AND p.i = g.first
      LEFT JOIN own b ON b.video = g.video AND b.cs = g.cs AND b.ce = g.ce AND b.i = g.back))),
z AS (SELECT video, cs, ce, max(i) AS i FROM own GROUP BY 1, 2, 3),
parts AS (
  SELECT video, s, e, n, reason FROM m WHERE e - s <= 2500
  UNION ALL SELECT video, s, e, n, 'max_clip_split' FROM g WHERE n IS NOT NULL
  UNION ALL SELECT g.video, p.start, o."end", g.i + 1 - g.first, 'max_clip_remainder' FROM g JOIN z USING (video, cs, ce, i) JOIN own o USING (video, cs, ce, i)
    JOIN own p ON p.video = g.video AND p.cs = g.cs AND p.ce = g.ce AND p.i = g.first WHERE o."end" - p.start >= 900)
{_NUMBERED} FROM parts""")
def seg_hist_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a longest length: longer spans are split at sentence ends."""
    return segment.merged(*_changes(spark, sf_dir), min_len=900, max_len=2500).select("video", "clip_idx", "start", "end", "n", "reason")


@query(f"""WITH {SEGMENTS_SQL}, c AS (SELECT video, k AS clip_idx, k * 3000.0::DOUBLE + b AS start, k * 3000.0::DOUBLE + b + 3000 AS "end" FROM (SELECT video, min(start) AS b FROM seg GROUP BY 1), generate_series(0, 4) t(k))
SELECT c.video, c.clip_idx::INT AS clip_idx, string_agg(s.text, ' ' ORDER BY s.ord) AS text, count(*) AS n FROM c JOIN seg s ON s.video = c.video AND (s.start + s."end") / 2 BETWEEN c.start AND c."end" GROUP BY 1, 2""")
def transcript_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip's text by the segments' midpoints."""
    s = segments(spark, sf_dir)
    b = s.groupBy("video").agg(F.min("start").alias("b")).withColumn("clip_idx", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return segment.sliced(s, b.select("video", "clip_idx", (F.col("clip_idx") * 3000.0 + F.col("b")).alias("start"), (F.col("clip_idx") * 3000.0 + F.col("b") + 3000).alias("end")))


@query(f"""WITH {SEGMENTS_SQL}, c AS (SELECT video, k AS clip_idx, k * 3000.0::DOUBLE + b AS start, k * 3000.0::DOUBLE + b + 3000 AS "end"
  FROM (SELECT video, min(start) AS b, unnest(generate_series(0, floor((max("end") - min(start)) / 3000)::BIGINT)) AS k FROM seg GROUP BY 1))
SELECT c.video, c.clip_idx::INT AS clip_idx, string_agg(s.text, ' ' ORDER BY s.ord) AS text, count(*) AS n FROM c JOIN seg s ON s.video = c.video AND (s.start + s."end") / 2 BETWEEN c.start AND c."end" GROUP BY 1, 2""")
def transcript_slice_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with clips up to each video's last end, so that every segment is in one."""
    s = segments(spark, sf_dir)
    last = F.floor((F.max("end") - F.min("start")) / 3000).cast("int")
    b = s.groupBy("video").agg(F.min("start").alias("b"), last.alias("last")).withColumn("clip_idx", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return segment.sliced(s, b.select("video", "clip_idx", (F.col("clip_idx") * 3000.0 + F.col("b")).alias("start"), (F.col("clip_idx") * 3000.0 + F.col("b") + 3000).alias("end")))


@query("""WITH v AS (SELECT label AS video, vec_id AS ord, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id % 10 > 0),
b AS (SELECT *, lag(e) OVER (PARTITION BY video ORDER BY ord) AS p, len(e)::DOUBLE AS n FROM v),
c AS (SELECT video, ord, CASE WHEN p IS NULL THEN 1.0::DOUBLE ELSE (n * list_dot_product(p, e) - list_sum(p) * list_sum(e))
  / nullif(sqrt(n * list_dot_product(p, p) - list_sum(p) * list_sum(p)) * sqrt(n * list_dot_product(e, e) - list_sum(e) * list_sum(e)), 0) END AS r FROM b)
SELECT video, ord, round(r, 9) AS similarity, coalesce(r < 0.3, false) AS scene_change FROM c""")
def lag_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each vector with the last readable one before it in its label, to 9 places."""
    v = table(spark, sf_dir, "embeddings")
    frames = v.select(F.col("label").alias("video"), F.col("vec_id").alias("ord"), F.when(F.col("vec_id") % 10 > 0, F.col("embedding")).alias("hist"))
    return segment.lag_similarity(frames).withColumn("similarity", F.round("similarity", 9))


@query("""WITH v AS (SELECT label AS video, vec_id AS ord, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
b AS (SELECT *, lag(e) OVER (PARTITION BY video ORDER BY ord) AS p, len(e)::DOUBLE AS n FROM v),
c AS (SELECT video, ord, CASE WHEN p IS NULL THEN 1.0::DOUBLE ELSE (n * list_dot_product(p, e) - list_sum(p) * list_sum(e))
  / nullif(sqrt(n * list_dot_product(p, p) - list_sum(p) * list_sum(p)) * sqrt(n * list_dot_product(e, e) - list_sum(e) * list_sum(e)), 0) END AS r FROM b)
SELECT video, ord, round(r, 9) AS similarity, coalesce(r < 0.3, false) AS scene_change FROM c""")
def lag_similarity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every vector readable."""
    frames = table(spark, sf_dir, "embeddings").select(F.col("label").alias("video"), F.col("vec_id").alias("ord"), F.col("embedding").alias("hist"))
    return segment.lag_similarity(frames).withColumn("similarity", F.round("similarity", 9))


@query("""WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s FROM events), g AS (SELECT *, CASE WHEN s - lag(s) OVER w >= 1800 THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s)),
k AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(s) AS start_s, max(s) + 1800 AS end_s, count(*) AS n FROM k GROUP BY user_id, session""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour session windows with a watermark, as the batch of a stream sees them."""
    from ..streaming.answers import sessions

    e = table(spark, sf_dir, "events").select("user_id", F.timestamp_seconds(seconds(F.col("ts"))).alias("ts"))
    return sessions(e, "30 minutes", "10 minutes").select("user_id", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"), "n")
