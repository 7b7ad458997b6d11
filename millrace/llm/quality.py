"""Quality by hierarchical empirical Bayes; DataFrame operations only.

A naive Bayes classifier over coarse style features gives each document evidence: the log likelihood
ratio of good to bad.  Hosts and paths have posteriors of their own: the mean of their documents'
posteriors (of their labels where known), shrunk to the level above by as many pseudo-documents as the
spread between sites of that level says, so sparse sites stay near the global prior.  A document's
score combines its evidence with its path's posterior, from which its own share is taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, materialize, read_table, require

BINS = 8


def counts_of(text: Column) -> dict[str, Column]:
    """What the features are made of, each counted once a text."""
    text = F.coalesce(text, F.lit(""))
    literal = lambda s: ((F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))) / len(s)).cast("int")
    return {
        "n_chars": F.length(text),
        "n_words": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
        "n_distinct": F.size(F.array_distinct(F.split(text, " "))),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_symbols": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,]")),
        "n_digits": F.regexp_count(text, F.lit("[0-9]")),
        "n_lonely": F.regexp_count(text, F.lit(r"[ \t\n][^\p{L}\p{N}\s][ \t\n]")), "n_runs": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]{2,}")), "n_lines": literal("\n"),
    }


#: Each feature: a count, what it is a share of, and where its bins end.
CUTS = {
    "upper": ("n_upper", "n_chars", (0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.6)),
    "symbols": ("n_symbols", "n_chars", (0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4)),
    "lonely": ("n_lonely", "n_words", (0.0, 0.05, 0.1, 0.2, 0.4, 0.6, 0.9)),
    "runs": ("n_runs", "n_words", (0.0, 0.05, 0.1, 0.2, 0.4, 0.6, 0.9)),
    "variety": ("n_distinct", "n_words", (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)),
    "word_length": ("n_chars", "n_words", (3.0, 4.0, 5.0, 6.0, 7.0, 9.0, 13.0)),
    "digits": ("n_digits", "n_chars", (0.0, 0.002, 0.01, 0.03, 0.1, 0.2, 0.4)),
    "lines": ("n_lines", "n_words", (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.3)),
}
FEATURES = tuple(CUTS)


def style() -> dict[str, Column]:
    """Each feature as a bin from 0 to BINS - 1."""

    def bins(n: str, of: str, cuts: tuple[float, ...]) -> Column:
        share = F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)
        return sum((F.when(share > c, 1).otherwise(0) for c in cuts), F.lit(0))

    return {f: bins(*of) for f, of in CUTS.items()}


def site_of(url: Column) -> tuple[Column, Column]:
    """Host (without scheme, port and www. or m.) and first path level of a URL; nulls stay null."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.\-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), r"^(?:www|m)\.", "")
    return host, F.concat(host, F.lit("/"), F.regexp_extract(url, r"^[A-Za-z][\w+.\-]*://[^/?#]*/([^/?#]*)", 1))


def evidence(rows: DataFrame) -> tuple[DataFrame, float]:
    """Add ``llr`` to ``rows`` (bins and a label that is null where unknown), and the prior log odds.

    Counts are one aggregate over features and bins: at most len(FEATURES) * BINS rows reach the driver.
    """
    known = rows.where("label IS NOT NULL")
    one = known.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("x"), "label")
    counts = one.groupBy("x.f", "x.b").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    good = sum(r["good"] for r in counts if r["f"] == FEATURES[0])
    bad = sum(r["n"] for r in counts if r["f"] == FEATURES[0]) - good
    import math

    llr = F.lit(0.0)
    for f in FEATURES:
        seen = {r["b"]: (r["good"], r["n"] - r["good"]) for r in counts if r["f"] == f}
        table = []
        for b in range(BINS):
            g, w = seen.get(b, (0, 0))
            table.append(F.lit(math.log((g + 0.5) / (good + 0.5 * BINS)) - math.log((w + 0.5) / (bad + 0.5 * BINS))))
        llr = llr + F.element_at(F.array(*table), F.col(f) + 1)
    return rows.withColumn("llr", llr), math.log((good + 1) / (bad + 1))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(sites: DataFrame) -> float:
    """Pseudo-documents of a level's prior, by moments: small where site means differ more than chance says."""
    r = sites.where("n > 1").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    if not r["n"] or r["k"] < 2:
        return 10.0
    n, k, mean = float(r["n"]), r["k"], r["s"] / r["n"]
    within = mean * (1 - mean)
    between = (r["q"] - n * mean * mean - (k - 1) * within) / max(n - r["n2"] / n, 1e-9)
    return min(max(within / between - 1, 1.0), 1e6) if between > 1e-12 and within > 0 else 1e6


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5) -> DataFrame:
    """``(doc_id, held_out, evidence, host_posterior, path_posterior, score, keep)`` for each row of ``docs``.

    Labels of ids whose crc32 leaves 0 by ``folds`` are not learned from and not used by any posterior.
    ``keep`` is ``score >= 0.5``.  Null text counts as empty; a null host or path is a site of its own.
    Without labels the evidence is 0 and all scores are 0.5.  Null ids and repeated rows stay, one result
    a row; of repeated labels of an id the smallest counts.  An empty table gives no rows.  Other columns
    are ignored, whatever their names.
    """
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col), folds, 0)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    rows = docs.select(F.col(id_col).alias("doc_id"), host.alias("host"), path.alias("path"), *[c.alias(f) for f, c in counts_of(F.col(text_col)).items()])
    rows = materialize(rows, "counts").join(given, "doc_id", "left")
    judged, prior = evidence(materialize(rows.select("doc_id", "host", "path", "label", *[c.alias(f) for f, c in style().items()]), "style"))
    own = F.coalesce(F.col("label").cast("double"), _sigmoid(F.col("llr") + prior))
    judged = materialize(judged.select("doc_id", "host", "path", "llr", own.alias("own")), "evidence")
    paths = materialize(judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("own").alias("s")), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    level = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    level, kh, kp = 0.5 if level is None else level, _strength(hosts), _strength(paths)
    sites = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select(F.col("p.host").alias("host"), F.col("p.path").alias("path"), F.col("p.n").alias("pn"), F.col("p.s").alias("ps"), F.col("h.n").alias("hn"), F.col("h.s").alias("hs"))
    sites = materialize(sites, "sites")
    out = judged.alias("d").join(sites.alias("s"), F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path")))
    without = lambda s, n, k, above: (F.col(s) - F.col("own") + k * above) / (F.col(n) - 1 + k)
    at_host = without("hs", "hn", kh, F.lit(level))
    at_path = without("ps", "pn", kp, at_host)
    out = out.select("doc_id", held_out(F.col("doc_id"), folds, 0).alias("held_out"), F.col("llr").alias("evidence"), at_host.alias("host_posterior"), at_path.alias("path_posterior"))
    final = _sigmoid(F.col("evidence") + _logit(F.col("path_posterior")))
    return out.withColumn("score", final).withColumn("keep", F.col("score") >= 0.5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source stands for the host, the language section of a source for the path; numbers to 6 places."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = score(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
    return out.withColumns({c: F.round(c, 6) for c in ("evidence", "host_posterior", "path_posterior", "score")})


def _bins_sql() -> str:
    share = lambda n, of: f"CASE WHEN {of} > 0 THEN {n}::DOUBLE / {of} ELSE 0.0::DOUBLE END"
    return ",\n  ".join(f"len(list_filter({list(cuts)}::DOUBLE[], lambda c: {share(n, of)} > c)) AS {f}" for f, (n, of, cuts) in CUTS.items())


#: crc32 of the id's digits, bit by bit: a byte is mixed in, then eight steps follow.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END), 4294967295::BIGINT)"""


def _strength_sql(sites: str) -> str:
    return f"""SELECT CASE WHEN n IS NULL OR k < 2 THEN 10.0 WHEN between_ > 1e-12 AND within_ > 0 THEN least(greatest(within_ / between_ - 1, 1.0), 1e6) ELSE 1e6 END::DOUBLE AS v FROM (
  SELECT n, k, s / n * (1 - s / n) AS within_, (q - n * (s / n) * (s / n) - (k - 1) * (s / n * (1 - s / n))) / greatest(n - n2 / n, 1e-9) AS between_ FROM (
    SELECT sum(n)::DOUBLE AS n, count(*) AS k, sum(s) AS s, sum(s * s / n) AS q, sum(n * n)::DOUBLE AS n2 FROM {sites} WHERE n > 1))"""


QUERIES = {"op6_quality": op6_quality}
SQL = {
    "op6_quality": rf"""
WITH given AS (SELECT doc_id, min(quality)::INT AS label FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL AND {_CRC_SQL} % 5 <> 0 GROUP BY 1),
counts AS (
  SELECT doc_id, source AS host, concat_ws('/', source, lang) AS path, length(t) AS n_chars, len(regexp_extract_all(t, '[^ 	-
]+')) AS n_words, len(list_distinct(string_split(t, ' '))) AS n_distinct,
         len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}\s.,]')) AS n_symbols, len(regexp_extract_all(t, '[0-9]')) AS n_digits,
         len(regexp_extract_all(t, '[ \t\n][^\p{{L}}\p{{N}}\s][ \t\n]')) AS n_lonely, len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}\s]{{2,}}')) AS n_runs, length(t) - length(replace(t, chr(10), '')) AS n_lines
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
styled AS (SELECT doc_id, host, path, label, {_bins_sql()} FROM counts LEFT JOIN given USING (doc_id)),
long AS (SELECT f, b, label FROM (UNPIVOT (SELECT label, {', '.join(f'{f}::INT AS {f}' for f in FEATURES)} FROM styled WHERE label IS NOT NULL) ON {', '.join(FEATURES)} INTO NAME f VALUE b)),
whole AS (SELECT coalesce(sum(label), 0)::DOUBLE AS good, count(*) - coalesce(sum(label), 0)::DOUBLE AS bad FROM styled WHERE label IS NOT NULL),
tables AS (
  SELECT f, b, ln((count_good + 0.5::DOUBLE) / (good + 4)) - ln((count_bad + 0.5::DOUBLE) / (bad + 4)) AS v FROM (
    SELECT g.f, g.b, coalesce(sum(label), 0) AS count_good, count(label) - coalesce(sum(label), 0) AS count_bad
    FROM (SELECT unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) AS f, b FROM range(8) r(b)) g LEFT JOIN long USING (f, b) GROUP BY 1, 2), whole),
judged AS (
  SELECT doc_id, host, path, label, {' + '.join(f't_{f}.v' for f in FEATURES)} AS llr
  FROM styled {' '.join(f"JOIN tables t_{f} ON t_{f}.f = '{f}' AND t_{f}.b = styled.{f}" for f in FEATURES)}),
owned AS (SELECT *, coalesce(label::DOUBLE, 1 / (1 + exp(-(llr + ln((good + 1) / (bad + 1)))))) AS own FROM judged, whole),
paths AS (SELECT host, path, count(*) AS n, sum(own) AS s FROM owned GROUP BY 1, 2),
hosts AS (SELECT host, sum(n)::BIGINT AS n, sum(s) AS s FROM paths GROUP BY 1),
level AS (SELECT coalesce(sum(s) / sum(n), 0.5) AS v FROM hosts),
kh AS ({_strength_sql("hosts")}), kp AS ({_strength_sql("paths")}),
at_host AS (
  SELECT o.*, p.n AS pn, p.s AS ps, (h.s - own + kh.v * level.v) / (h.n - 1 + kh.v) AS host_posterior
  FROM owned o JOIN paths p ON o.host IS NOT DISTINCT FROM p.host AND o.path IS NOT DISTINCT FROM p.path JOIN hosts h ON o.host IS NOT DISTINCT FROM h.host, level, kh),
at_path AS (SELECT *, (ps - own + kp.v * host_posterior) / (pn - 1 + kp.v) AS path_posterior FROM at_host, kp),
scored AS (SELECT *, 1 / (1 + exp(-(llr + ln(p / (1 - p))))) AS score FROM (SELECT *, least(greatest(path_posterior, 1e-6), 1 - 1e-6::DOUBLE) AS p FROM at_path))
SELECT doc_id, {_CRC_SQL} % 5 = 0 AS held_out, round(llr, 6) AS evidence, round(host_posterior, 6) AS host_posterior, round(path_posterior, 6) AS path_posterior, round(score, 6) AS score, score >= 0.5 AS keep
FROM scored
""",
}
