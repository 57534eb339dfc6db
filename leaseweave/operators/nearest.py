"""Nearest places of points on the globe, for any number of both.

Places are ordered along a space-filling curve through the cube around the globe and cut into parts of bounded size, each
with its box. A point goes to the parts whose box may hold something nearer than what another part is sure to hold, and
there to the leaves of the part by the same rule. Boxes are of points on the unit sphere, so there are no poles and no
date line.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of a part, places of a leaf, and points that a part's task takes at once.
PART_PLACES, LEAF_PLACES, TASK_POINTS = 50_000, 32, 200_000
RADIUS_M = 6_371_000.0
#: By how much boxes are taken larger, against rounding (about a millimetre).
SLACK = 2e-10


def on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)


def along_curve(xyz: np.ndarray) -> np.ndarray:
    """Place on the Z curve: 20 bits of each coordinate, interleaved."""
    cells = np.clip((xyz + 1) * (1 << 19), 0, (1 << 20) - 1).astype(np.int64)
    out = np.zeros(len(xyz), np.int64)
    for bit in range(20):
        for axis in range(3):
            out |= ((cells[:, axis] >> bit) & 1) << (3 * bit + axis)
    return out


def metres(lat: np.ndarray, lon: np.ndarray, plat: np.ndarray, plon: np.ndarray) -> np.ndarray:
    """Great-circle distance, as `functions.geo.haversine` has it."""
    lat, lon, plat, plon = map(np.radians, (lat, lon, plat, plon))
    a = np.sin((plat - lat) / 2) ** 2 + np.cos(lat) * np.cos(plat) * np.sin((plon - lon) / 2) ** 2
    return 2 * RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def reach(xyz: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest chord from each point to each box."""
    nearest = np.maximum(np.maximum(low[None] - xyz[:, None], xyz[:, None] - high[None]), 0)
    farthest = np.maximum(np.abs(xyz[:, None] - low[None]), np.abs(xyz[:, None] - high[None]))
    return np.sqrt((nearest**2).sum(2)), np.sqrt((farthest**2).sum(2))


def chord(within_m: float | None) -> float:
    """The chord of an arc of `within_m` metres; that of nothing if None."""
    return -1.0 if within_m is None else 2 * np.sin(min(within_m / RADIUS_M, np.pi) / 2)


def wanted(xyz: np.ndarray, low: np.ndarray, high: np.ndarray, also: float) -> tuple[np.ndarray, np.ndarray]:
    """(point, box) of every box that may hold the nearest place, or one within the chord `also`."""
    least, most = reach(xyz, low, high)
    sure = np.maximum(most.min(1, keepdims=True), also) + SLACK
    return np.nonzero(least <= sure)


class Part:
    """The places of a part in leaves along the curve."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, idx: np.ndarray):
        xyz = on_sphere(lat, lon)
        order = np.argsort(along_curve(xyz), kind="stable")
        self.lat, self.lon, self.idx, xyz = lat[order], lon[order], idx[order], xyz[order]
        self.first = np.arange(0, len(order), LEAF_PLACES)
        self.low, self.high = np.minimum.reduceat(xyz, self.first), np.maximum.reduceat(xyz, self.first)
        self.last = np.append(self.first[1:], len(order))
        self.order = order

    def nearest(self, lat: np.ndarray, lon: np.ndarray, within_m: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distance and position of each point's nearest place (the smallest idx of equally near ones), and how many places
        lie within `within_m`."""
        n = len(lat)
        best, at, count = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        step = max(1, 1_000_000 // len(self.first))
        for i in range(0, n, step):
            part = slice(i, i + step)
            point, leaf = wanted(on_sphere(lat[part], lon[part]), self.low, self.high, chord(within_m))
            sizes = (self.last - self.first)[leaf]
            who = np.repeat(point, sizes) + i
            place = np.arange(sizes.sum()) + np.repeat(self.first[leaf] - (np.cumsum(sizes) - sizes), sizes)
            d = metres(lat[who], lon[who], self.lat[place], self.lon[place])
            order = np.lexsort((self.idx[place], d, who))
            new = order[np.flatnonzero(np.diff(who[order], prepend=-1))]
            best[who[new]], at[who[new]] = d[new], self.order[place[new]]
            if within_m is not None:
                np.add.at(count, who[d <= within_m], 1)
        return best, at, count


def nearest_places(points: DataFrame, places: DataFrame, name: str, within_m: float | None = None) -> DataFrame:
    """(lat, lon, d, idx, name, n): per distinct coordinate of `points` its nearest place, and how many are within.

    `points` has lat, lon; `places` has idx (long), `name`, lat, lon. Coordinates that are null have no row; without places
    there are no rows.
    """
    listed = places.select(F.col("idx").cast("long").alias("idx"), F.col(name).cast("string").alias("name"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    where = points.select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    doubles = pa.float64()

    def ranked(batches):
        for b in batches:
            code = along_curve(on_sphere(b.column("lat").to_numpy(), b.column("lon").to_numpy()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], names=[*b.schema.names, "code"])

    coded = listed.mapInArrow(ranked, "idx long, name string, lat double, lon double, code long")
    number = coded.count()
    cuts = sorted(set(coded.agg(F.percentile_approx("code", [i / (number // PART_PLACES + 1) for i in range(1, number // PART_PLACES + 1)], 10_000)).first()[0] or [])) if number > PART_PLACES else []

    def parted(batches):  # the box of a part, task by task
        for b in batches:
            part = np.searchsorted(np.array(cuts, np.int64), b.column("code").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(part.astype(np.int32))], names=["idx", "name", "lat", "lon", "part"])

    in_parts = coded.mapInArrow(parted, "idx long, name string, lat double, lon double, part int")

    def boxes(batches):
        for b in batches:
            xyz, part = on_sphere(b.column("lat").to_numpy(), b.column("lon").to_numpy()), b.column("part").to_numpy()
            for p in np.unique(part):
                mine = xyz[part == p]
                yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), *[pa.array([float(x)], doubles) for x in (*mine.min(0), *mine.max(0))]], names=["part", *"abcdef"])

    found = in_parts.mapInArrow(boxes, "part int, a double, b double, c double, d double, e double, f double").groupBy("part").agg(*[F.min(c).alias(c) for c in "abc"], *[F.max(c).alias(c) for c in "def"])
    rows = sorted(tuple(r) for r in found.collect())  # a row for every PART_PLACES places
    numbers = np.array([r[0] for r in rows], np.int32)
    low, high = (np.array([r[i : i + 3] for r in rows]).reshape(-1, 3) for i in (1, 4))

    def dealt(batches):
        for b in batches:
            lat, lon = b.column("lat").to_numpy(), b.column("lon").to_numpy()
            step = max(1, 1_000_000 // max(1, len(rows)))
            for i in range(0, len(lat) if len(rows) else 0, step):
                point, box = wanted(on_sphere(lat[i : i + step], lon[i : i + step]), low, high, chord(within_m))
                yield pa.RecordBatch.from_arrays([pa.array(lat[i + point]), pa.array(lon[i + point]), pa.array(numbers[box])], names=["lat", "lon", "part"])

    asked = where.mapInArrow(dealt, "lat double, lon double, part int")
    # A part that many points ask is taken by several tasks, each with its places.
    loads = asked.groupBy("part").agg(F.ceil(F.count("*") / TASK_POINTS).alias("_tasks"))
    none = F.lit(None)
    to_part = asked.join(F.broadcast(loads), "part").select("part", F.pmod(F.xxhash64("lat", "lon"), F.col("_tasks")).alias("task"), F.lit(1).alias("kind"), none.cast("long").alias("idx"), none.cast("string").alias("name"), "lat", "lon")
    held = in_parts.join(F.broadcast(loads), "part").select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tasks") - 1)).alias("task"), F.lit(0).alias("kind"), "idx", "name", "lat", "lon")
    mixed = held.unionByName(to_part).repartition("part", "task").sortWithinPartitions("part", "task", "kind")
    kind = "lat double, lon double, d double, idx long, name string, n long"

    def search(batches):
        def pieces():
            for b in batches:
                key = np.stack([b.column(i).to_numpy().astype(np.int64) for i in (0, 1, 2)])
                edges = np.flatnonzero(np.any(np.diff(key, prepend=-1) != 0, 0)) if b.num_rows else []
                for i, j in zip(edges, [*edges[1:], b.num_rows]):
                    yield tuple(key[:, i].tolist()), b.slice(i, j - i)

        part = None
        for (number, task, side), group in groupby(pieces(), key=lambda x: x[0]):
            if side == 0:
                table = pa.Table.from_batches([b for _, b in group])
                part, names, ids = Part(table.column("lat").to_numpy(), table.column("lon").to_numpy(), table.column("idx").to_numpy()), table.column("name").combine_chunks(), table.column("idx").combine_chunks()
                continue
            for _, b in group:
                d, at, n = part.nearest(b.column("lat").to_numpy(), b.column("lon").to_numpy(), within_m)
                yield pa.RecordBatch.from_arrays([b.column("lat"), b.column("lon"), pa.array(d), ids.take(pa.array(at)), names.take(pa.array(at)), pa.array(n)], names=["lat", "lon", "d", "idx", "name", "n"])

    each = mixed.mapInArrow(search, kind)
    best = F.min(F.struct("d", "idx", "name")).alias("_best")
    return each.groupBy("lat", "lon").agg(best, F.sum("n").alias("n")).select("lat", "lon", "_best.*", "n")
