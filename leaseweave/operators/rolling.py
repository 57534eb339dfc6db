"""Order statistics and moments of many time windows of many groups, in numpy.

Values are ranked once and kept as a wavelet matrix: per bit of the rank, how many earlier values have it clear. The k-th
value of any stretch of days is then found by one step per bit, however long the stretch, and sums come from prefix sums,
so no window is counted twice. All windows of all groups go through each step together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa


class Wavelet:
    """The k-th smallest value of any range of positions."""

    def __init__(self, values: np.ndarray):
        self.sorted, ranks = np.unique(values, return_inverse=True)
        self.levels = []
        for bit in range(max(1, int(self.sorted.size - 1).bit_length()) - 1, -1, -1):
            clear = (ranks >> bit) & 1 == 0
            before = np.concatenate([[0], np.cumsum(clear)]).astype(np.int32 if ranks.size < 1 << 31 else np.int64)
            self.levels.append((bit, before))
            ranks = np.concatenate([ranks[clear], ranks[~clear]])

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Value number k (from 0) of the positions low .. high - 1, of which there must be more than k."""
        low, high, k, rank = low.copy(), high.copy(), k.copy(), np.zeros(k.size, np.int64)
        for bit, before in self.levels:
            a, b = before[low], before[high]
            upper = k >= b - a
            rank |= upper.astype(np.int64) << bit
            k -= np.where(upper, b - a, 0)
            low = np.where(upper, before[-1] + low - a, a)
            high = np.where(upper, before[-1] + high - b, b)
        return self.sorted[rank]


class Series:
    """The values of all groups in order of group and day; `place` is group * span + day, ascending."""

    def __init__(self, place: np.ndarray, values: np.ndarray | None):
        if values is not None:
            place, values = place[~np.isnan(values)], values[~np.isnan(values)]
        order = np.argsort(place, kind="stable")
        self.place, self.values, self.made = place[order], None if values is None else values[order], {}

    def _once(self, name: str, make):
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    def _sums(self):
        centre = self.values.mean() if self.values.size else 0.0
        x = (self.values - centre).astype(np.longdouble)
        return centre, np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])

    def statistics(self, low: np.ndarray, high: np.ndarray, wanted: Sequence[str], least: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """(values, which are missing) of each statistic over positions low .. high - 1; below `least` values only counts
        are known."""
        n = high - low
        out = {"count": (n, np.zeros(n.size, bool))} if "count" in wanted else {}
        known = n >= max(1, least)
        a, b, m = low[known], high[known], n[known]

        def put(stat, found, also=None):
            full, missing = np.zeros(n.size), ~known
            full[known] = found
            if also is not None:
                missing = missing.copy()
                missing[known] = ~also
            out[stat] = full, missing

        if {"median", "min", "max"} & set(wanted):
            tree = self._once("tree", lambda: Wavelet(self.values))
            if "median" in wanted:
                middle = tree.kth(a, b, (m - 1) // 2).astype(float)
                even = m % 2 == 0
                middle[even] += (tree.kth(a[even], b[even], m[even] // 2) - middle[even]) * 0.5
                put("median", middle)
            if "min" in wanted:
                put("min", tree.kth(a, b, np.zeros(m.size, np.int64)))
            if "max" in wanted:
                put("max", tree.kth(a, b, m - 1))
        if {"mean", "std"} & set(wanted):
            centre, sums, squares = self._once("sums", self._sums)
            total = sums[b] - sums[a]
            if "mean" in wanted:
                put("mean", (centre + total / m).astype(float))
            if "std" in wanted:
                spread = np.maximum(squares[b] - squares[a] - total * total / m, 0)
                put("std", np.sqrt(spread / np.maximum(m - 1, 1)).astype(float), m > 1)
        return out


def codes(columns: Sequence[pa.Array]) -> np.ndarray:
    """A number per row that is equal for equal rows of `columns`; nulls are equal."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        part = c.dictionary_encode("encode")
        ids = part.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.unique(out * (len(part.dictionary) + 1) + ids, return_inverse=True)[1]
    return out


def swept(table: pa.Table, specs: Sequence, day: str, part: str, own: np.ndarray) -> dict[str, pa.Array]:
    """The output columns of all `specs` (history.PastWindow) for the rows `own`. The table has whole groups, or parts of
    them that are told apart by the column `part`."""
    days = table.column(day).to_numpy()
    known = ~np.isnan(days) if days.dtype.kind == "f" else np.ones(days.size, bool)
    days = np.where(known, days, 0).astype(np.int64)
    reach = max(s.days + s.offset for s in specs)
    first = int(days[known].min()) if known.any() else 0
    span = (int(days[known].max()) - first if known.any() else 0) + reach + 2
    out: dict[str, pa.Array] = {}
    for keys in dict.fromkeys(s.keys for s in specs):
        group = codes([table.column(k).combine_chunks() for k in (*keys, part)])
        place = group * span + (days - first) + reach + 1  # windows stay inside the group's span
        asked, back = np.unique(place[own], return_inverse=True)
        for value in dict.fromkeys(s.value for s in specs if s.keys == keys):
            numbers = None if value is None else table.column(value).cast(pa.float64()).to_numpy()
            series = Series(place[known], None if numbers is None else numbers[known])
            ends: dict[int, np.ndarray] = {}
            for s in (s for s in specs if s.keys == keys and s.value == value):
                for lag in (s.offset, s.offset + s.days):
                    if lag not in ends:
                        ends[lag] = np.searchsorted(series.place, asked - lag)
                for stat, (found, missing) in series.statistics(ends[s.offset + s.days], ends[s.offset], list(s.outputs), s.min_count).items():
                    found, missing = found[back], missing[back]
                    if stat == "count":
                        found = np.where(known[own], found, 0)
                    else:
                        missing = missing | ~known[own]
                    out[s.outputs[stat]] = pa.array(found, pa.int64() if stat == "count" else pa.float64(), mask=missing)
    return out
