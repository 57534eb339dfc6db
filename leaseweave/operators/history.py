"""Leakage-free history: time-range windows strictly before a contract, and the last contract before it.

A window of W days at offset O holds the rows of the same group with t - O - W <= day < t - O, so neither the row
itself nor others of its day count. A NULL group key is a group. A window at an offset is that of an earlier day, so all
windows of all offsets and key sets come from one sweep over each group (see `rolling`), and key sets that contain the
coarsest one share an exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..config import DEFAULT, EngineConfig
from ..functions.scalars import ratio
from . import rolling

@dataclass(frozen=True)
class PastWindow:
    """`outputs` names a column per statistic: count, median, mean, std, min, max.

    count counts the rows with a value (all rows if `value` is None); the others are NULL below `min_count` values.
    """

    keys: tuple[str, ...]
    value: str | None
    days: int
    outputs: dict = field(hash=False, default_factory=dict)
    offset: int = 0
    min_count: int = 3


#: Rows of a group of the windows' keys above which its days are cut into slices, so that no task gets a whole district.
SLICE_ROWS = 1_000_000


def measured_slice(df: DataFrame, specs: Sequence[PastWindow], date: str) -> int | None:
    """Days of a slice for the coarsest keys and the longest reach of `specs`."""
    return slice_of(df, min((s.keys for s in specs), key=len), max(s.days + s.offset for s in specs), date)


def slice_of(df: DataFrame, keys: Sequence[str], reach: int, date: str) -> int | None:
    """Days of a slice: about SLICE_ROWS rows of the largest group of `keys`, and what windows reach back, so that a row is
    in two or three slices at most. None if no group is that large."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(F.unix_date(F.col(date))) - F.min(F.unix_date(F.col(date))) + 1).alias("span"))
    largest = sizes.where(F.col("n") > SLICE_ROWS).agg(F.min(F.floor(F.col("span") * SLICE_ROWS / F.col("n")))).first()[0]
    return None if largest is None else max(int(largest), reach)


#: Rows that a sweep takes at once, and gives out at once.
SWEEP_ROWS, OUT_ROWS = 50_000, 10_000


def past_windows(df: DataFrame, specs: Sequence[PastWindow], date: str = "contract_date", slice_days: int | str | None = "auto") -> DataFrame:
    """`df` with the columns of all `specs`.

    `slice_days` cuts every group into slices of so many days; a row is copied to the later slices whose windows reach
    back to it. Results are the same, and a group of any size becomes many tasks of bounded span. By default the sizes
    of the groups decide; None cuts nothing. A row without a date has empty windows and is in none.
    """
    specs = sorted(specs, key=lambda s: (len(s.keys), s.keys))
    names, sweeps = [name for s in specs for name in s.outputs.values()], []
    while specs:  # one sweep for all key sets that contain the coarsest one
        together = [s for s in specs if set(specs[0].keys) <= set(s.keys)]
        sweeps.append(together)
        specs = [s for s in specs if s not in together]
    columns = [F.col(f"`{c}`") for c in df.columns]
    # Sizes are told before the first sweep: a sweep adds no rows, and to count its rows would be to run it once more.
    cut = [measured_slice(df, together, date) if slice_days == "auto" else slice_days for together in sweeps]
    for together, days in zip(sweeps, cut):
        df = _sweep(df, together, date, days)
    return df.select(*columns, *[F.col(f"`{name}`") for name in names])


def _sweep(df: DataFrame, specs: Sequence[PastWindow], date: str, slice_days: int | None) -> DataFrame:
    keys, reach = list(specs[0].keys), max(s.days + s.offset for s in specs)
    rows = df.withColumn("_day", F.unix_date(F.col(date)))
    if slice_days is None:
        rows = rows.withColumns({"_own": F.lit(0), "_slice": F.lit(0)})
    else:
        own, last = (F.floor(x / slice_days).cast("int") for x in (F.col("_day"), F.col("_day") + reach))
        later = F.when(F.col("_day").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(own, last))
        rows = rows.withColumn("_own", own).withColumn("_slice", F.explode(later))
    rows = rows.repartition(*keys, "_slice").sortWithinPartitions(*keys, "_slice", "_day")
    added = {name: "long" if stat == "count" else "double" for s in specs for stat, name in s.outputs.items()}
    out = StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in added.items())).fields])
    width = len(df.columns)
    return rows.mapInArrow(lambda batches: _streamed(batches, keys, specs, width, list(added)), out)


def _streamed(batches, keys: Sequence[str], specs: Sequence[PastWindow], width: int, names: Sequence[str]):
    """The first `width` columns of rows that are sorted by `keys`, slice and day, with the columns `names` of `specs`.

    Windows end before their day, so a stretch of rows needs of what came before only what its windows reach back to. No
    more is held, however large a group is.
    """
    reach = max(s.days + s.offset for s in specs)
    needed = list(dict.fromkeys([*keys, *(k for s in specs for k in s.keys), *(s.value for s in specs if s.value is not None), "_day", "_slice"]))

    def swept(before: pa.Table | None, table: pa.Table):
        narrow = table.select(needed)
        own = np.flatnonzero(pc.fill_null(pc.equal(table.column("_own"), table.column("_slice")), True).to_numpy())
        if before is not None:
            narrow = pa.concat_tables([before, narrow])
        shift = narrow.num_rows - table.num_rows
        found = rolling.swept(narrow, specs, "_day", "_slice", own + shift)
        for at in range(0, own.size, OUT_ROWS):
            kept = table.select(range(width)).take(own[at : at + OUT_ROWS])
            for name in names:
                kept = kept.append_column(name, found[name].slice(at, OUT_ROWS))
            yield from kept.combine_chunks().to_batches()
        return narrow

    def reached(narrow: pa.Table) -> pa.Table:
        """What windows of later rows may hold: rows of the last group no further back than they reach."""
        group = rolling.codes([narrow.column(k).combine_chunks() for k in (*keys, "_slice")])
        last = np.flatnonzero(group == group[-1])
        day = narrow.column("_day").take(pa.array(last))
        latest = pc.max(day).as_py()
        within = np.zeros(last.size, bool) if latest is None else pc.fill_null(pc.greater_equal(day, latest - reach), False).to_numpy()
        return narrow.take(pa.array(last[within])).combine_chunks()

    before, held, n = None, [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SWEEP_ROWS):
            held.append(batch.slice(at, SWEEP_ROWS))
            n += held[-1].num_rows
            if n >= max(SWEEP_ROWS, 0 if before is None else before.num_rows):
                table, held, n = pa.Table.from_batches(held), [], 0
                before = reached((yield from swept(before, table)))
                table = None
    if held:
        yield from swept(before, pa.Table.from_batches(held))


def past_window(df: DataFrame, keys: Sequence[str], value: str | None, window_days: int, stats: Sequence[str] = ("count", "median"), offset_days: int = 0, min_count: int = 3, date: str = "contract_date", prefix: str = "") -> DataFrame:
    """`df` with one column per statistic, named `prefix` and the statistic."""
    return past_windows(df, [PastWindow(tuple(keys), value, window_days, {s: f"{prefix}{s}" for s in stats}, offset_days, min_count)], date)


def previous_event(df: DataFrame, keys: Sequence[str], value: str, offset_days: int = 0, date: str = "contract_date", tie: str = "tx_id", names: tuple[str, str] = ("prev_value", "prev_date"), slice_days: int | str | None = "auto") -> DataFrame:
    """`df` with value and date of the latest row of the group before day - offset that has a value.

    Of several on that day the one with the largest `tie` counts.
    """
    return previous_events(df, keys, value, {offset_days: names}, date, tie, slice_days)


def previous_events(df: DataFrame, keys: Sequence[str], value: str, names: dict[int, tuple[str, str]], date: str = "contract_date", tie: str = "tx_id", slice_days: int | str | None = "auto") -> DataFrame:
    """previous_event at several offsets over one sort; `names` has the two columns of each offset.

    A group that is too large for a task is cut into slices of days as windows are. What lies further back than a slice
    and its reach comes to it as one row, the latest event there, found by a prefix maximum over the slices of the group.
    """
    keys, reach = list(keys), max(names) + 1
    event = F.when(F.col(value).isNotNull(), F.struct(F.col("_day").alias("d"), F.col(tie).alias("t"), F.col(value).alias("v"), F.col(date).alias("at")))
    columns = [F.col(f"`{c}`") for c in df.columns]
    rows = df.withColumn("_day", F.unix_date(F.col(date))).select(*columns, "_day", event.alias("_event"))
    if slice_days == "auto":
        slice_days = slice_of(df, keys, reach, date)
    if slice_days is None:
        by = Window.partitionBy(*keys).orderBy("_day")
    else:
        own, last = (F.floor(x / slice_days).cast("int") for x in (F.col("_day"), F.col("_day") + reach))
        later = F.when(F.col("_day").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(own, last))
        # An event is out of reach from the slice after its last one on.
        gone = rows.where("_event IS NOT NULL").groupBy(*keys, (last + 1).alias("_slice")).agg(F.max("_event").alias("_event")).withColumn("_asked", F.lit(False))
        asked = rows.where("_day IS NOT NULL").select(*keys, own.alias("_slice")).distinct().withColumns({"_event": F.lit(None).cast(gone.schema["_event"].dataType), "_asked": F.lit(True)})
        upto = Window.partitionBy(*keys).orderBy("_slice")  # two rows a slice at most
        carried = gone.unionByName(asked).withColumn("_event", F.max("_event").over(upto)).where("_asked AND _event IS NOT NULL").select(*keys, "_slice", "_event", F.col("_event.d").alias("_day"))
        rows = rows.withColumn("_own", own).withColumn("_slice", F.explode(later)).unionByName(carried, allowMissingColumns=True)
        by = Window.partitionBy(*keys, "_slice").orderBy("_day")
    found = [F.max("_event").over(by.rangeBetween(Window.unboundedPreceding, -1 - offset)).alias(f"_prev{offset}") for offset in names]
    if slice_days is None:
        rows = rows.select(*columns, *found)
    else:  # a carried row has no slice of its own
        rows = rows.withColumn("_mine", F.col("_own").eqNullSafe(F.col("_slice"))).select(*columns, "_mine", *found).where("_mine")
    return rows.select(*columns, *[F.col(f"_prev{o}.{part}").alias(n) for o, pair in names.items() for part, n in zip(("v", "at"), pair)])


def _specs(offset: int, cfg: EngineConfig, tag: str = "", price: str = "price_10k") -> list[PastWindow]:
    """All windows behind the history features at an offset; output names end with `tag`."""
    n, t, mid = cfg.min_count, cfg.trend_days, cfg.rolling_windows[1]

    def window(keys, value, days, outputs, shift=0, least=n):
        return PastWindow(keys, value, days, {stat: name + tag for stat, name in outputs.items()}, offset + shift, least)

    specs = []
    for w in cfg.rolling_windows:
        more = {"mean": f"dong_price_mean_{w}d", "std": f"dong_price_std_{w}d"} if w == mid else {}
        counted = {"count": f"comp_tx_count_{w}d"} if w == mid else {}
        specs.append(window(cfg.dong_keys, price, w, {"count": f"dong_tx_count_{w}d", "median": f"dong_price_median_{w}d", **more}))
        specs.append(window(cfg.comp_keys, price, w, {"median": f"comp_price_median_{w}d", **counted}))
    return [
        *specs,
        window(cfg.gu_keys, price, 90, {"count": "gu_tx_count_90d", "median": "gu_price_median_90d"}),
        window(cfg.gu_keys, price, 90, {"median": "_gu_before"}, t), window(cfg.gu_keys, price, 90, {"median": "_gu_year"}, 365),
        window(cfg.dong_keys, price, t, {"median": "_dong_before"}, t), window(cfg.comp_keys, price, t, {"median": "_comp_before"}, t),
        window(cfg.dong_keys, "deposit_10k", mid, {"median": f"dong_deposit_median_{mid}d"}), window(cfg.comp_keys, "deposit_10k", mid, {"median": f"comp_deposit_median_{mid}d"}),
        window(cfg.property_keys, price, cfg.property_days, {"count": f"property_tx_count_{cfg.property_days}d", "median": f"property_price_median_{cfg.property_days}d"}, least=1),
    ]


#: Features made of windows' columns: trends of a median against an earlier one, and whether a value is known.
TRENDS = {
    "dong_price_trend_3m": ("dong_price_median_90d", "_dong_before"), "comp_price_trend_3m": ("comp_price_median_90d", "_comp_before"),
    "gu_price_trend_3m": ("gu_price_median_90d", "_gu_before"), "gu_price_trend_12m": ("gu_price_median_90d", "_gu_year"),
}
KNOWN = {"has_property_history": "property_last_price", "has_comp_90d_history": "comp_price_median_90d", "has_dong_90d_history": "dong_price_median_90d"}


def _derived(offset: int, tag: str = "") -> dict[str, Column]:
    days = F.datediff(F.date_sub(F.col("contract_date"), offset), F.col(f"`property_last_date{tag}`")).cast("double")
    out = {"property_days_since_last_transaction": days}
    out |= {name: ratio(F.col(f"`{now}{tag}`"), F.col(f"`{before}{tag}`")) for name, (now, before) in TRENDS.items()}
    return out | {name: F.col(f"`{of}{tag}`").isNotNull().cast("int") for name, of in KNOWN.items()}


def history_at_offsets(df: DataFrame, offsets: dict[int, int], cfg: EngineConfig = DEFAULT, features: Sequence[str] | None = None, label: str = "horizon_days") -> DataFrame:
    """One row per row of `df` and entry of `offsets` (label: offset), with `features` known that many days before.

    All offsets share the exchanges and sorts of one pass over the rows; only the frames differ.
    """
    features = list(features or FEATURES)
    wanted = {*features, *(x for f in features for x in (TRENDS.get(f, ()) or ((KNOWN[f],) if f in KNOWN else ())))}
    if "property_days_since_last_transaction" in wanted:
        wanted.add("property_last_price")
    names, parts, specs = df.columns, [], []
    rows = df
    for value, offset in offsets.items():
        tag = f"@{value}"
        for s in _specs(offset, cfg, tag):
            kept = {stat: name for stat, name in s.outputs.items() if name.removesuffix(tag) in wanted}
            if kept:
                specs.append(PastWindow(s.keys, s.value, s.days, kept, s.offset, s.min_count))
    rows = past_windows(rows, specs)
    if "property_last_price" in wanted:
        last = {o: (f"property_last_price@{v}", f"property_last_date@{v}") for v, o in offsets.items()}
        rows = previous_events(rows, cfg.property_keys, "price_10k", last, slice_days=slice_of(df, cfg.property_keys, max(last) + 1, "contract_date"))
    for value, offset in offsets.items():
        tag = f"@{value}"
        derived = _derived(offset, tag)
        parts.append(F.struct(F.lit(value).alias(label), *[(derived[f] if f in derived else F.col(f"`{f}{tag}`")).alias(f) for f in features]))
    return rows.select(*names, F.explode(F.array(*parts)).alias("_h")).select(*names, "_h.*")


def history_at_offset(df: DataFrame, offset: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """History features known `offset` days before the contract; the district count is of priced rows."""
    cut = slice_of(df, cfg.property_keys, offset + 1, "contract_date")
    df = previous_event(past_windows(df, _specs(offset, cfg)), cfg.property_keys, "price_10k", offset, names=("property_last_price", "property_last_date"), slice_days=cut)
    return df.withColumns(_derived(offset)).drop("property_last_date", "_dong_before", "_comp_before", "_gu_before", "_gu_year")


def add_history(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """History features as of the contract day; the district count is of all rows, priced or not."""
    specs = [s for s in _specs(0, cfg) if s.keys != cfg.gu_keys] + [PastWindow(cfg.gu_keys, None, 90, {"count": "gu_tx_count_90d"}, 0, cfg.min_count)]
    cut = slice_of(df, cfg.property_keys, 1, "contract_date")
    df = previous_event(past_windows(df, specs), cfg.property_keys, "price_10k", names=("property_last_price", "property_last_date"), slice_days=cut)
    derived = {name: c for name, c in _derived(0).items() if not name.startswith("gu_")}
    return df.withColumns(derived).drop("_dong_before", "_comp_before")


FEATURES = [
    *[name for s in _specs(0, DEFAULT) for name in s.outputs.values() if not name.startswith("_")], "property_last_price",
    "property_days_since_last_transaction", *TRENDS, *KNOWN,
]
