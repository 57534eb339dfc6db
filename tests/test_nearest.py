"""Nearest places against plain loops, over poles and the date line, for parts and tasks of few rows."""

import math
import random

import pytest

from leaseweave.operators import nearest


def metres(a, b):
    lat, lon, plat, plon = map(math.radians, (*a, *b))
    h = math.sin((plat - lat) / 2) ** 2 + math.cos(lat) * math.cos(plat) * math.sin((plon - lon) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(math.sqrt(min(1.0, h)))


def scattered(seed, n):
    """Over the whole globe, with a dense town, both poles and the date line."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        out.append(r.choice([
            (math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)), (r.gauss(37.5, 0.02), r.gauss(127, 0.02)),
            (r.uniform(89, 90), r.uniform(-180, 180)), (r.uniform(-1, 1), r.choice([-180, 180]) * r.uniform(0.998, 1)), (-90.0, r.uniform(-180, 180)),
        ]))
    return out


@pytest.mark.parametrize("part, leaf, task", [(50_000, 32, 200_000), (60, 4, 90)])
def test_nearest_places_equal_plain_loops(spark, monkeypatch, part, leaf, task):
    for name, value in (("PART_PLACES", part), ("LEAF_PLACES", leaf), ("TASK_POINTS", task)):
        monkeypatch.setattr(nearest, name, value)
    points, places = scattered(1, 1000), scattered(2, 1000)
    places += [places[3], places[3]]  # as near: the smallest idx counts
    df = spark.createDataFrame([*points, (None, 1.0), points[0]], "lat double, lon double")
    there = spark.createDataFrame([(i, f"p{i}", *x) for i, x in enumerate(places)] + [(5000, "nowhere", None, None)], "idx int, name string, lat double, lon double")
    got = {(r["lat"], r["lon"]): r for r in nearest.nearest_places(df, there, "name", 30_000).collect()}
    assert got.keys() == set(points)
    for x in set(points):
        d = [metres(x, p) for p in places]
        least = min(d)
        r = got[x]
        assert r["d"] == pytest.approx(least, abs=1e-3) and d[r["idx"]] == pytest.approx(least, abs=1e-3) and r["name"] == f"p{r['idx']}"
        assert abs(r["n"] - sum(v <= 30_000 for v in d)) == 0
    assert not any(r["idx"] in (1000, 1001) for r in got.values())
    assert nearest.nearest_places(df, there.limit(0), "name").count() == 0 and nearest.nearest_places(df.limit(0), there, "name").count() == 0
