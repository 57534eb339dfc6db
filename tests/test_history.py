"""History windows against properties that hold for any series, and against plain loops over random ones."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaseweave.operators import history
from leaseweave.operators.history import PastWindow, history_at_offset, history_at_offsets, past_windows, previous_event
from leaseweave.operators.ranks import exact_quantiles, order_statistics, selected, small

START = dt.date(2019, 3, 1)
STATS = {"count": "n", "median": "med", "mean": "avg", "std": "dev", "min": "least", "max": "most"}


def drawn(seed, n=160, days=220, groups=("u", "v", None), gaps=0.15):
    """Rows (id, day, group, value): some days hold several, some values are missing."""
    r = random.Random(seed)
    return [(i, START + dt.timedelta(r.randrange(days)), r.choice(groups), None if r.random() < gaps else float(r.randint(1, 50))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "tx_id long, contract_date date, g string, v double")


def windowed(spark, rows, days, offset=0, least=2, **more):
    out = past_windows(frame(spark, rows), [PastWindow(("g",), "v", days, dict(STATS), offset, least)], **more)
    return {r["tx_id"]: tuple(r[c] if r[c] is None else round(r[c], 9) for c in STATS.values()) for r in out.collect()}


def by_loop(rows, days, offset=0, least=2):
    out = {}
    for i, day, group, _ in rows:
        seen = [v for _, d, g, v in rows if g == group and v is not None and 1 <= (day - d).days - offset <= days]
        if len(seen) < least:
            out[i] = (len(seen), None, None, None, None, None)
        else:
            out[i] = (len(seen), statistics.median(seen), statistics.fmean(seen), statistics.stdev(seen) if len(seen) > 1 else None, min(seen), max(seen))
    return out


@pytest.mark.parametrize("days, offset, least, slice_days", [(1, 0, 1, None), (17, 0, 2, None), (45, 20, 3, 9), (45, 20, 3, 64), (400, 0, 1, 1000), (30, 90, 2, 30)])
def test_every_statistic_equals_a_plain_loop(spark, days, offset, least, slice_days):
    rows = drawn(days + offset)
    got, expected = windowed(spark, rows, days, offset, least, slice_days=slice_days), by_loop(rows, days, offset, least)
    assert got.keys() == expected.keys()
    for i in got:
        assert all(a == b if None in (a, b) else a == pytest.approx(b, rel=1e-9) for a, b in zip(got[i], expected[i])), (got[i], expected[i])


def test_large_groups_are_cut_into_slices(spark, monkeypatch):
    rows = drawn(70, n=300, days=900)
    spec = [PastWindow(("g",), "v", 20, dict(STATS), 5, 2)]
    assert history.measured_slice(frame(spark, rows), spec, "contract_date") is None
    monkeypatch.setattr(history, "SLICE_ROWS", 20)
    assert 50 <= history.measured_slice(frame(spark, rows), spec, "contract_date") < 250
    assert windowed(spark, rows, 20, 5) == windowed(spark, rows, 20, 5, slice_days=None)


def test_values_of_a_day_reach_no_row_up_to_that_day(spark):
    rows = drawn(71)
    turn = sorted(r[1] for r in rows)[80]
    changed = [(i, d, g, v if d < turn or v is None else v * 1000 + 7) for i, d, g, v in rows]
    before, after = windowed(spark, rows, 60), windowed(spark, changed, 60)
    assert all(before[i] == after[i] for i, d, _, _ in rows if d <= turn) and before != after


def test_order_of_rows_and_ids_do_not_matter(spark):
    rows = drawn(72)
    assert windowed(spark, rows, 30) == windowed(spark, rows[::-1], 30)


def test_an_offset_is_a_shift_of_the_day(spark):
    rows = drawn(73, gaps=0)
    later = [(1000 + i, d + dt.timedelta(25), g, None) for i, d, g, _ in rows]
    both = windowed(spark, rows + later, 40, offset=25)
    alone = windowed(spark, rows, 40)
    assert all(both[1000 + i] == alone[i] for i in alone)


def test_rows_without_value_count_where_no_value_is_asked_for(spark):
    rows = drawn(74)
    out = past_windows(frame(spark, rows), [PastWindow(("g",), None, 50, {"count": "rows"}), PastWindow(("g",), "v", 50, {"count": "valued"})]).collect()
    for r in out:
        seen = [v for _, d, g, v in rows if g == r["g"] and 1 <= (r["contract_date"] - d).days <= 50]
        assert (r["rows"], r["valued"]) == (len(seen), sum(v is not None for v in seen))


def test_a_group_is_never_held_whole(monkeypatch):
    import pyarrow as pa

    n, sizes, sweep = 4000, [], history.rolling.swept
    monkeypatch.setattr(history, "SWEEP_ROWS", 100)
    monkeypatch.setattr(history, "OUT_ROWS", 30)
    monkeypatch.setattr(history.rolling, "swept", lambda table, *rest: sizes.append(table.num_rows) or sweep(table, *rest))
    table = pa.table({"g": ["a"] * (n - 50) + ["b"] * 50, "v": [float(i * 37 % 101) for i in range(n)], "_day": [i // 3 for i in range(n)], "_own": [0] * n, "_slice": [0] * n})
    spec = PastWindow(("g",), "v", 40, {"count": "c", "median": "m"}, 5)
    out = pa.Table.from_batches(history._streamed(table.to_batches(77), ["g"], [spec], 3, ["c", "m"]))
    whole = sweep(table, [spec], "_day", "_slice", np.arange(n))
    assert out.column("c").combine_chunks().equals(whole["c"]) and out.column("m").combine_chunks().equals(whole["m"]) and max(sizes) < 400


@pytest.mark.parametrize("offset, slice_rows", [(0, None), (1, None), (33, None), (0, 5), (33, 25)])
def test_the_latest_earlier_value(spark, monkeypatch, offset, slice_rows):
    if slice_rows:
        monkeypatch.setattr(history, "SLICE_ROWS", slice_rows)
    rows = drawn(75 + offset, days=900 if slice_rows else 220)
    found = previous_event(frame(spark, rows), ["g"], "v", offset).collect()
    assert sorted(r["tx_id"] for r in found) == sorted(r[0] for r in rows)
    for r in found:
        seen = [(d, i, v) for i, d, g, v in rows if g == r["g"] and v is not None and (r["contract_date"] - d).days > offset]
        day, _, value = max(seen, default=(None, None, None))
        assert (r["prev_value"], r["prev_date"]) == (value, day)


CONTRACT = "tx_id long, contract_date date, gu string, dong string, rent_type string, housing_category string, area_bin string, property_id string, price_10k double, deposit_10k double"


def contracts(spark, seed, n=150, blank=0):
    """Random contracts; each of the first `blank` has a twin of negative id without prices."""
    r = random.Random(seed)
    rows = [(i, START + dt.timedelta(r.randrange(450)), "g", r.choice("xy"), "r", "c", r.choice("ab"), str(r.randrange(12)), float(r.randint(30, 90)), float(r.randint(500, 900))) for i in range(n)]
    return spark.createDataFrame(rows + [(-1 - i, *x[1:8], None, None) for i, x in enumerate(rows[:blank])], CONTRACT)


def test_twins_without_price_are_known_by_the_same_features(spark):
    out = {r["tx_id"]: r.asDict() for r in history_at_offset(contracts(spark, 5, blank=40), 90).collect()}
    same = lambda row: {k: v for k, v in row.items() if k not in ("tx_id", "price_10k", "deposit_10k")}
    assert all(same(out[i]) == same(out[-1 - i]) for i in range(40))


def test_offsets_in_one_pass_equal_single_passes(spark):
    df = contracts(spark, 6)
    features = ["dong_price_median_90d", "gu_price_trend_3m", "property_last_price", "property_days_since_last_transaction", "has_comp_90d_history"]
    both = history_at_offsets(df, {0: 30, 60: 90}, features=features)
    for h, offset in ((0, 30), (60, 90)):
        rows = lambda out: sorted(tuple(r[c] for c in ("tx_id", *features)) for r in out.collect())
        assert repr(rows(both.where(f"horizon_days = {h}"))) == repr(rows(history_at_offset(df, offset)))


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 1.0, 1.0, 1.0, 2.0], [float(i * 7919 % 1000) for i in range(1500)], [5.0] * 900 + [6.0] * 100 + [None]])
def test_order_statistics_equal_sorting(spark, values):
    df = spark.createDataFrame([(k, v) for k in ("a", None) for v in values] + [("z", 1.5)], "k string, v double")
    kept = sorted(v for v in values if v is not None)
    out = {r["k"]: r for r in exact_quantiles(df, F.col("v"), (0.0, 0.1, 0.5, 0.97, 1.0), ["k"]).collect()}
    assert out["z"]["q"] == [1.5] * 5 and len(out) == (3 if kept else 1)
    for k in ("a", None) if kept else ():
        at = [f * (len(kept) - 1) for f in (0.0, 0.1, 0.5, 0.97, 1.0)]
        expected = [kept[int(x)] + (kept[min(int(x) + 1, len(kept) - 1)] - kept[int(x)]) * (x - int(x)) for x in at]
        assert out[k]["n"] == len(kept) and out[k]["q"] == pytest.approx(expected)
    whole = order_statistics(df, F.col("v"), lambda n: [n - 1]).collect()
    assert whole[0]["q"] == [max([*kept, 1.5])]


def test_small_tables_only_are_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(small(spark.range(5))).lower() and "broadcast" not in plan(small(spark.range(50), 10)).lower()


@pytest.mark.parametrize("accuracy", [10_000, 40])
def test_quantiles_of_many_columns_equal_sorting(spark, accuracy):
    r = random.Random(9)
    rows = [(r.choice(["a", "b", None]), r.random(), None if r.random() < 0.3 else float(r.randint(0, 3)), None if i else 1.0) for i in range(3000)] + [("one", 5.0, None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double")
    wanted = {"x_mid": (F.col("x"), 0.5), "x_high": (F.col("x") * 2, 0.9), "y_mid": (F.col("y"), 0.5), "y_end": (F.col("y"), 1.0), "z_low": (F.col("z"), 0.1)}

    def plain(values, f):
        kept = sorted(v for v in values if v is not None)
        at = f * (len(kept) - 1)
        return None if not kept else pytest.approx(kept[int(at)] + (kept[min(int(at) + 1, len(kept) - 1)] - kept[int(at)]) * (at - int(at)))

    for by in (["k"], []):
        for got in selected(df, wanted, by, accuracy).collect():
            mine = [x for x in rows if not by or x[0] == got["k"]]
            for name, i, scale, f in (("x_mid", 1, 1, 0.5), ("x_high", 1, 2, 0.9), ("y_mid", 2, 1, 0.5), ("y_end", 2, 1, 1.0), ("z_low", 3, 1, 0.1)):
                assert got[name] == plain([None if x[i] is None else x[i] * scale for x in mine], f), (by, name)


@pytest.mark.parametrize("sample", [2_000_000_000, 9, 20_000])
def test_rechecks_of_all_rows_need_no_global_order(spark, sample, monkeypatch):
    from leaseweave.operators import quality

    monkeypatch.setattr(quality, "SMALL", 5 if sample == 9 else 10_000)  # a larger sample is numbered
    df = frame(spark, drawn(31)).withColumnRenamed("id", "tx_id")
    value = next(c for c, t in df.dtypes if t == "double")
    key, day = next(c for c, t in df.dtypes if t == "string"), next(c for c, t in df.dtypes if t == "date")
    df = past_windows(df.withColumnRenamed(day, "contract_date"), [PastWindow((key,), value, 17, {"count": "n", "median": "m"})])
    out = quality.recheck_windows(df, [key], 17, "n", "m", 3, sample, value)
    assert tuple(out.first()) == (min(sample, df.count()), 0)
    assert "TakeOrdered" not in out._jdf.queryExecution().executedPlan().toString()
    wrong = df.withColumn("n", F.col("n") + (F.col("tx_id") % 7 == 2).cast("int")).withColumn("m", F.when(F.col("tx_id") % 5 != 1, F.col("m")))
    bad = df.where("tx_id % 7 = 2 OR tx_id % 5 = 1 AND m IS NOT NULL").count()
    assert sample < 1000 or tuple(quality.recheck_windows(wrong, [key], 17, "n", "m", 3, sample, value).first())[1] == bad


def test_sweep_of_the_horizon_table_holds_only_what_windows_reach(monkeypatch):
    """Seven horizons over one group of ten years, with stretches of 50 rows: no stretch is swept with the whole group."""
    import pyarrow as pa

    n, held = 4000, []
    swept = history.rolling.swept
    monkeypatch.setattr(history, "SWEEP_ROWS", 50)
    monkeypatch.setattr(history.rolling, "swept", lambda table, *more: (held.append(table.num_rows), swept(table, *more))[1])
    specs = [PastWindow(("g",), "v", 90, {"median": f"m{h}"}, h + 30) for h in range(0, 181, 30)]
    day = np.arange(n, dtype=np.int32)
    rows = pa.RecordBatch.from_pydict({"g": pa.array(["u"] * n), "v": pa.array(day.astype(float)), "_day": day, "_own": np.zeros(n, np.int32), "_slice": np.zeros(n, np.int32)})
    out = pa.Table.from_batches(history._streamed([rows.slice(at, 100) for at in range(0, n, 100)], ["g"], specs, 2, [f"m{h}" for h in range(0, 181, 30)]))
    assert out.num_rows == n and max(held) <= 2 * (90 + 210 + 51) + 100
    assert out.column("m180")[n - 1].as_py() == pytest.approx(n - 1 - 210 - 45.5)


def test_group_sizes_are_counted_before_the_sweeps(spark, monkeypatch):
    seen, slice_of = [], history.slice_of
    monkeypatch.setattr(history, "slice_of", lambda df, *rest: seen.append(set(df.columns)) or slice_of(df, *rest))
    df = spark.createDataFrame([(1, "g", "d", "f", "c", "0-15", "p", dt.date(2024, 1, 1), 5.0, 1.0)], "tx_id long, gu string, dong string, rent_type string, housing_category string, area_bin string, property_id string, contract_date date, price_10k double, deposit_10k double")
    plans = [history.add_history(df), history.history_at_offset(df, 3), history.history_at_offsets(df, {0: 0, 90: 90})]
    assert len(seen) >= 6 and all(x <= set(df.columns) for x in seen)  # rows of a sweep are not counted: that runs it again
    assert [p.count() for p in plans] == [1, 1, 2]
