"""Segmentation against plain specifications on random and crafted transcripts."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import segment

SEGMENTS = "video string, ord int, start double, end double, text string"


def random_video(rng: random.Random, n: int) -> list[tuple]:
    out, t = [], 0.0
    for _ in range(n):
        t += rng.choice([0, 0, 1, 2, 5])
        length = rng.choice([2, 5, 9, 20])
        out.append((t, t + length, rng.choice(["so then", "Well", "that is it.", "Is it? ", "", "and! "])))
        t += length
    return out


def ends(text: str) -> bool:
    return text.rstrip()[-1:] in (".", "?", "!") and text.strip() != ""


def spec_capped(v, low, high, gap):
    clips, here = [], None
    for k, (s, e, text) in enumerate(v):
        if here and s - here[0] <= high and s - v[k - 1][1] < gap:
            here = (here[0], e, here[2] + 1)
            continue
        if here:
            clips.append(here)
        here = (s, e, 1) if k == 0 or ends(v[k - 1][2]) or text[:1].isupper() else None
    return [c for c in [*clips, *([here] if here else [])] if c[1] - c[0] >= low]


def spec_cuts(v, changes, tolerance):
    out = set()
    for t in changes:
        near = [(abs(e - t), k) for k, (_, e, text) in enumerate(v) if ends(text) and abs(e - t) <= tolerance]
        out |= {min(near)[1]} if near else set()
    return sorted(out)


def spec_merged(v, cuts, low, high):
    spans, first = [], 0
    for c in cuts:
        if v[c][1] - v[first][0] >= low:
            spans.append((first, c, "scene_change"))
            first = c + 1
    if first < len(v) and v[-1][1] - v[first][0] >= low:
        spans.append((first, len(v) - 1, "end_of_video"))
    out = []
    for a, b, reason in spans:
        if v[b][1] - v[a][0] <= high:
            out.append((v[a][0], v[b][1], b - a + 1, reason))
            continue
        inside = [s for s in v if s[0] >= v[a][0] and s[1] <= v[b][1]]
        at = 0
        for k in range(len(inside)):
            if inside[k][1] - inside[at][0] >= high:
                back = [j for j in range(at + 1, k) if ends(inside[j][2])]
                if back:
                    out.append((inside[at][0], inside[back[-1]][1], back[-1] - at + 1, "max_clip_split"))
                    at = back[-1] + 1
        if at < len(inside) and inside[-1][1] - inside[at][0] >= low:
            out.append((inside[at][0], inside[-1][1], len(inside) - at, "max_clip_remainder"))
    return sorted(out)


def spec_by_cuts(v, cuts, last, low):
    """cuts: position to topic, a later entry standing over an earlier one."""
    if not cuts:
        return [(v[0][0], v[-1][1], len(v), "no_cuts", "full_video")]
    marks = [0, *sorted(k for k in cuts if k > 0), len(v)]
    spans = [(v[a][0], v[b - 1][1], b - a, "end_of_video" if b == len(v) else "llm_verified", last if b == len(v) else cuts[b]) for a, b in zip(marks, marks[1:], strict=False)]
    return [s for s in spans if s[1] - s[0] >= low]


@pytest.fixture(scope="module")
def videos():
    rng = random.Random(13)
    return {f"v{k}": random_video(rng, rng.choice([1, 2, 10, 60])) for k in range(40)}


@pytest.fixture(scope="module")
def segments(spark, videos):
    return spark.createDataFrame([(v, k, *s) for v, segs in videos.items() for k, s in enumerate(segs)], SEGMENTS)


def test_capped(segments, videos):
    got = segment.capped(segments, 30, 80, 2).collect()
    want = Counter((v, *c) for v, segs in videos.items() for c in spec_capped(segs, 30, 80, 2))
    assert Counter((r["video"], r["start"], r["end"], r["n"]) for r in got) == want


def test_gap(segments, videos):
    got = segment.by_gap(segments, 2).collect()
    want = Counter()
    for v, segs in videos.items():
        parts = [[segs[0]]]
        for a, b in zip(segs, segs[1:], strict=False):
            if b[0] - a[1] >= 2:
                parts.append([])
            parts[-1].append(b)
        want.update((v, k, p[0][0], p[-1][1], len(p)) for k, p in enumerate(parts))
    assert Counter((r["video"], r["clip_idx"], r["start"], r["end"], r["n"]) for r in got) == want


@pytest.mark.parametrize("longest", [60, 120, 1e9])
def test_histogram_cuts(spark, segments, videos, longest):
    rng = random.Random(3)
    changes = {v: sorted({rng.uniform(0, segs[-1][1]) for _ in range(rng.randint(0, 6))}) for v, segs in videos.items()}
    table = spark.createDataFrame([(v, t) for v, ts in changes.items() for t in ts], "video string, time double")
    cuts = segment.nearest_cuts(segments, table, 10)
    assert Counter(tuple(r) for r in cuts.collect()) == Counter((v, k) for v, segs in videos.items() for k in spec_cuts(segs, changes[v], 10))
    got = segment.merged(segments, cuts, 30, longest).collect()
    want = Counter((v, *c) for v, segs in videos.items() for c in spec_merged(segs, spec_cuts(segs, changes[v], 10), 30, longest))
    assert Counter((r["video"], r["start"], r["end"], r["n"], r["reason"]) for r in got) == want


def test_model_cuts(spark, segments, videos):
    rng = random.Random(6)
    rows, final = [], {}
    for v, segs in videos.items():
        own = {}
        for extra in (0, 1):
            for _ in range(rng.randint(0, 4)):
                k = rng.randint(0, len(segs) + 2)
                if k not in own or extra and not own[k].startswith("x"):
                    topic = f"{'x' if extra else 't'}{k}"
                    rows.append((v, k, topic, extra))
                    own[k] = topic
        final[v] = {k: t for k, t in own.items() if k < len(segs)}
    cuts = spark.createDataFrame(rows, "video string, ord int, topic string, additional int")
    got = segment.by_cuts(segments, cuts, "last", 20).collect()
    want = Counter((v, *c) for v, segs in videos.items() for c in spec_by_cuts(segs, final[v], "last", 20))
    assert Counter((r["video"], r["start"], r["end"], r["n"], r["reason"], r["topic"]) for r in got) == want


def test_crafted_segmentation(spark):
    def clips(spans, cut_ords, exclusive=False):
        s = spark.createDataFrame([("v", k, float(a), float(b), "x.") for k, (a, b) in enumerate(spans)], SEGMENTS)
        if exclusive:
            cuts = spark.createDataFrame([("v", k, "t", 0) for k in cut_ords], "video string, ord int, topic string, additional int")
            return [(r["start"], r["end"]) for r in segment.by_cuts(s, cuts).orderBy("clip_idx").collect()]
        cuts = spark.createDataFrame([("v", k) for k in cut_ords], "video string, ord int")
        return [(r["start"], r["end"]) for r in segment.merged(s, cuts).orderBy("clip_idx").collect()]

    short = [(0, 20), (20, 40), (40, 100)]
    assert clips(short, [0, 1]) == [(0, 40), (40, 100)]  # a short span goes on
    assert clips(short, [1, 2], exclusive=True) == [(40, 100)]  # or falls out
    assert clips([(0, 10)], []) == [] and clips([(0, 10)], [], exclusive=True) == [(0, 10)]


def test_slices_and_containment(spark):
    s = spark.createDataFrame([("v", k, k * 10.0, k * 10.0 + 10, f"w{k}") for k in range(6)], SEGMENTS)
    c = spark.createDataFrame([("v", 0, 0.0, 25.0), ("v", 1, 25.0, 60.0)], "video string, clip_idx int, start double, end double")
    assert [(r["clip_idx"], r["text"]) for r in segment.sliced(s, c).orderBy("clip_idx").collect()] == [(0, "w0 w1 w2"), (1, "w2 w3 w4 w5")]
    assert sorted((r["clip_idx"], r["ord"]) for r in segment.contained(s, c).collect()) == [(0, 0), (0, 1), (1, 3), (1, 4), (1, 5)]
    v = spark.createDataFrame([("v", 100.0), ("w", 0.0)], "video string, duration double")
    assert {r["video"]: r["coverage_pct"] for r in segment.coverage(c, v).collect()} == {"v": 60.0, "w": 0.0}


def test_lag_similarity(spark):
    rows = [("v", 0, [1.0, 2.0, 3.0]), ("v", 1, None), ("v", 2, [2.0, 4.0, 6.0]), ("v", 3, [3.0, 2.0, 1.0]), ("v", 4, [1.0, 1.0, 1.0])]
    out = segment.lag_similarity(spark.createDataFrame(rows, "video string, ord int, hist array<double>")).orderBy("ord").collect()
    assert [r["ord"] for r in out] == [0, 2, 3, 4]
    assert [r["scene_change"] for r in out] == [False, False, True, False]
    assert out[1]["similarity"] == pytest.approx(1) and out[2]["similarity"] == pytest.approx(-1) and out[3]["similarity"] is None


def test_empty(spark, segments):
    none = segments.where(F.lit(False))
    cuts = spark.createDataFrame([], "video string, ord int")
    assert segment.capped(none).count() == segment.merged(none, cuts).count() == segment.by_gap(none, 3).count() == 0
