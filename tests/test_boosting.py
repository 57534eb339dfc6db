"""Quantile boosting against plain loops, and against a forest on rows that neither has seen."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaseweave.operators import boosting, model
from leaseweave.operators.boosting import QuantileBoosting


def rows_of(seed, n):
    """(k, x, z, _y): a level per kind, a step in x, noise that grows with z; some of x and k are missing."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        k, x, z = r.choice("abcdef"), r.random(), r.random()
        y = "abcdef".index(k) % 3 + (2.0 if x > 0.6 else 0.0) + r.gauss(0, 0.1 + z)
        out.append((None if r.random() < 0.1 else k, None if r.random() < 0.1 else x, z, y + (1.5 if out and x < 0.05 else 0)))
    return out


SCHEMA = "k string, x double, z double, _y double"


def plain_boosting(rows, features, quantiles, rounds, rate, depth, min_rows, l2, smooth, edges):
    """The same trees by loops over rows, with all rows and features; values as 4-byte floats, as the blocks hold them."""
    f32 = lambda v: float(np.float32(v))
    y = [f32(r["_y"]) for r in rows]
    out = []
    for q in quantiles:
        start = sorted(y_ for y_ in (r["_y"] for r in rows))[max(0, math.ceil(q * len(rows)) - 1)]
        value = [f32(start)] * len(rows)
        for _ in range(rounds):
            gradient = [q if y[i] >= value[i] else q - 1 for i in range(len(rows))]
            nodes = {0: list(range(len(rows)))}
            for _level in range(depth):
                for node, of in [(n, o) for n, o in nodes.items() if n >= 2**_level - 1]:
                    score = lambda part: sum(gradient[i] for i in part) ** 2 / (len(part) + l2)
                    best = None
                    for f in features:
                        bins = {}
                        for i in of:
                            v = rows[i][f]
                            bins.setdefault(0 if v is None else (sum(e < v for e in edges[f]) + 1 if f in edges else "abcdef".index(v) + 1), []).append(i)
                        order = [b for b in sorted(bins) if b]
                        if f not in edges:
                            order.sort(key=lambda b: sum(gradient[i] for i in bins[b]) / (len(bins[b]) + smooth))
                        for missing in (True, False) if 0 in bins else (False,):
                            left = list(bins[0]) if missing else []
                            for b in order:
                                left = left + bins[b]
                                right = [i for i in of if i not in set(left)]
                                if len(left) >= min_rows and len(right) >= min_rows:
                                    gain = score(left) + score(right) - score(of)
                                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                        best = gain, left, right
                    if best:
                        nodes[2 * node + 1], nodes[2 * node + 2] = best[1:]
                        del nodes[node]
            for of in nodes.values():
                left_over = sorted(f32(f32(y[i]) - value[i]) for i in of)
                step = f32(np.float32(left_over[max(0, math.ceil(q * len(of)) - 1)]) * np.float32(rate))
                for i in of:
                    value[i] = f32(value[i] + step)
        out.append(value)
    return out


def test_trees_equal_plain_loops(spark):
    rows = [dict(zip(("k", "x", "z", "_y"), r), id=i) for i, r in enumerate(rows_of(1, 300))]
    df = spark.createDataFrame([(r["k"], r["x"], r["z"], r["_y"], r["id"]) for r in rows], SCHEMA + ", id long").repartition(3)
    fitted = QuantileBoosting(["k", "x", "z"], rounds=3, depth=2, min_rows=15, rows_share=1.0, features_share=1.0, bins=8, quantiles=(0.1, 0.5, 0.9)).fit(df)
    got = {r["id"]: (r["q_lo"], r["q_mid"], r["q_hi"]) for r in fitted.predict(df).collect()}
    want = plain_boosting(rows, ["k", "x", "z"], (0.1, 0.5, 0.9), 3, 0.1, 2, 15, 1.0, 10.0, fitted.bins.edges)
    for i in range(300):
        assert got[i] == pytest.approx(tuple(v[i] for v in want), abs=1e-5)


def pinball(df, q, column):
    return df.select(F.avg(F.greatest(q * (F.col("_y") - F.col(column)), (q - 1) * (F.col("_y") - F.col(column))))).first()[0]


def test_boosting_beats_the_forest_and_stops_early(spark, tmp_path):
    train, valid, test = (spark.createDataFrame(rows_of(seed, n), SCHEMA).cache() for seed, n in ((2, 3000), (3, 1000), (4, 2000)))
    fitted = QuantileBoosting(["k", "x", "z"], rounds=60, patience=4, rate=0.3, depth=3, min_rows=20).fit(train, valid)
    assert all(0 < n <= 60 and n == min(range(len(x)), key=x.__getitem__) + 1 and len(series) == n for n, x, series in zip(fitted.best, fitted.losses, fitted.trees))
    assert any(len(x) < 60 for x in fitted.losses)
    forest = model.QuantileForest(["k", "x", "z"], trees=8, depth=5).fit(train)
    ours, theirs = fitted.predict(test).cache(), forest.predict(test).cache()
    for q, c in ((0.1, "q_lo"), (0.5, "q_mid"), (0.9, "q_hi")):
        assert pinball(ours, q, c) < pinball(theirs, q, c)
    fitted.save(spark, str(tmp_path / "m"))
    again = QuantileBoosting.load(spark, str(tmp_path / "m"))
    key = lambda out: sorted(map(repr, out.collect()))
    assert key(again.predict(test)) == key(ours)
    odd = spark.createDataFrame([("unseen", None, float("nan"), 0.0), (None, 1e9, -1e9, 0.0)], SCHEMA)
    assert len(fitted.predict(odd).collect()) == 2 and fitted.predict(odd.limit(0)).count() == 0
    assert fitted.importances(spark).agg(F.sum("gain_share")).first()[0] == pytest.approx(1, abs=1e-3)


def test_bits_keep_the_order_of_numbers():
    x = np.array([-np.inf, -5.5, -1e-30, 0.0, 1e-30, 2.0, 3e38], np.float32)
    bits = boosting.ordered_bits(x)
    assert (np.diff(bits.astype(np.int64)) > 0).all() and [boosting.from_bits(int(b)) for b in bits] == x.tolist()


def test_residuals_are_counted_in_bounded_parts():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 5000, 300) for _ in range(60)]
    told = list(boosting.tallied(iter(parts), 1000))
    assert len(told) > 5 and all(keys.size < 1300 for keys, _ in told)  # a task once held all different residuals
    total = np.zeros(5000, np.int64)
    for keys, n in told:
        total[keys] += n
    assert (total == np.bincount(np.concatenate(parts), minlength=5000)).all()
    assert list(boosting.tallied(iter([]))) == []


def test_one_task_grows_what_many_grow(spark, monkeypatch):
    train, valid = (spark.createDataFrame(rows_of(seed, n), SCHEMA).repartition(3).cache() for seed, n in ((2, 1500), (3, 500)))
    fit = lambda: QuantileBoosting(["k", "x", "z"], rounds=3, depth=3, min_rows=20).fit(train, valid)
    alone = fit()
    monkeypatch.setattr(boosting, "ALONE", -1)
    many = fit()
    assert alone.best == many.best and np.allclose(alone.losses, many.losses) and np.allclose(alone.gain, many.gain)
    # A split may be told with its sides changed: their gains are equal but for rounding.
    assert all((a.feature == b.feature).all() for a, b in zip(sum(alone.trees, []), sum(many.trees, [])))
    told = lambda fitted: np.array(sorted(map(tuple, fitted.predict(train).select("z", "_y", "q_lo", "q_mid", "q_hi").collect())))
    assert np.allclose(told(alone), told(many))
    assert not any(QuantileBoosting(["k", "x", "z"]).fit(train.limit(0)).trees[0][0].value)


def test_the_query_is_grown_until_validation_gains_nothing(spark, monkeypatch):
    """It once stopped after 6 rounds of trees of depth 3 on one horizon, with a patience of 20."""
    from leaseweave.plans import catalog

    seen, fit = [], QuantileBoosting.fit
    monkeypatch.setattr(QuantileBoosting, "fit", lambda self, train, valid: seen.append(self) or fit(self, train, valid))
    rows = catalog.queries()["quantile_boosting"](spark, "/root/testdata/sf0.001").groupBy("horizon_days").count().collect()
    model, s = seen[0], boosting.Settings()
    assert model.settings == s and len(rows) == len(catalog.CFG.horizons)
    assert all(len(x) >= min(s.rounds, n + s.patience) or not series[-1].feature[0] >= 0 for x, n, series in zip(model.losses, model.best, model.trees))
