"""Arrays over whole series laid one after the other, as folds.by_series() gives them: values with which of them are there."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from candela.functions.windows import HELD, QUICK_SERIES, QUICK_WINDOW, TENTH, UNIT_BITS


def numbers(column):
    """(values, there) of an Arrow column as doubles; a missing value is NaN."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.float64())
    return column.fill_null(np.nan).to_numpy(), column.is_valid().to_numpy()


def places(heads, rows: int):
    """The place of each row in its series, from 0; heads: the first row of each series."""
    import numpy as np

    return np.arange(rows) - np.repeat(heads, np.diff(np.append(heads, rows)))


def lagged(x, there, place, k: int):
    """(values, there) k rows before in the series."""
    import numpy as np

    return (x, there) if k == 0 else (np.roll(x, k), np.roll(there, k) & (place >= k))


def last_means(x, there, spans: tuple[int, ...], heads) -> list:
    """(mean, there) of the last n rows for each span, with the exact sums of windows.moving_means() to the last bit.

    Ten digits as longs hold the sums of most series, which are taken together; others are added one by one.
    """
    import numpy as np

    rows = len(x)
    place, size = places(heads, rows), np.diff(np.append(heads, rows))
    with np.errstate(all="ignore"):
        near = np.rint(x * TENTH) / TENTH
        # With room for the last bits of this test: a series that fails it is tested anew, exactly.
        sure = ~there | (np.isfinite(x) & (np.abs(near - x) <= 0.9 * HELD * np.abs(x)))
        top = np.maximum.reduceat(np.where(there & np.isfinite(x), np.abs(x), 0.0), heads)
        known = np.add.reduceat(there.astype(np.int64), heads)
        quick = np.logical_and.reduceat(sure, heads) & (top * max(spans) < QUICK_WINDOW) & (top * known < QUICK_SERIES)
        tenths = np.where(there & np.repeat(quick, size), np.rint(x * TENTH), 0.0).astype(np.int64)
    # Running over all series: what longs lose at 2^63 is the same on both ends of a window.
    total = np.concatenate([[0], np.cumsum(tenths)])
    count = np.concatenate([[0], np.cumsum(there)])
    end, out = np.arange(1, rows + 1), []
    for n in spans:
        start = np.maximum(end - n, 0)
        on = (place >= n - 1) & (count[end] - count[start] >= n)
        out.append((np.where(on, (total[end] - total[start]) / TENTH / n, np.nan), on))
    for first, n in zip(heads[~quick], size[~quick]):
        at = slice(first, first + n)
        for (mean, on), of in zip(out, _single_means(x[at].tolist(), there[at].tolist(), spans)):
            mean[at] = np.where(on[at], of, np.nan)
    return out


def _tenths(x: float) -> int | None:
    """x in units of ten digits, halves away from zero; None beyond decimal(28,10)."""
    if not abs(x) < 1e18:
        return None
    whole = int(Decimal(repr(x)).scaleb(10).to_integral_value(ROUND_HALF_UP))
    return whole if abs(whole) < 10**28 else None


def tenths(x, there):
    """(x in units of ten digits as exact integers, which have one): halves away from zero, none beyond decimal(28,10).

    Longs where they hold sums of all of them, else Python's integers.
    """
    import numpy as np

    with np.errstate(all="ignore"):
        scaled = x * TENTH
        near = np.rint(scaled)
        # A last bit of a product may decide a half: then, and for large values, each is taken apart.
        sure = there & (np.abs(x) < QUICK_WINDOW) & (np.abs(scaled - near) < 0.25)
    odd = np.flatnonzero(there & ~sure)
    out, held = np.where(sure, near, 0.0).astype(np.int64), sure.copy()
    if not len(odd) and float(np.abs(np.where(sure, x, 0.0)).sum()) < QUICK_SERIES:
        return out, held
    out = out.astype(object)
    for k in odd:
        exact = _tenths(float(x[k]))
        if exact is not None:
            out[k], held[k] = exact, True
    return out, held


def _single_means(x: list[float], there: list[bool], spans: tuple[int, ...]) -> list[list[float]]:
    """last_means() of one series with any values, from exact integers; only windows without a missing value count."""
    finite = [on and math.isfinite(v) for v, on in zip(x, there)]
    tenths = [_tenths(v) if on else 0 for v, on in zip(x, there)]
    held = all(t is not None and abs(t / 10**10 - v) <= HELD * abs(v) for v, on, t in zip(x, there, tenths) if on)
    top = max((abs(v) for v, on in zip(x, finite) if on), default=0.0)
    if held and top * max(spans) < QUICK_WINDOW and top * sum(there) < QUICK_SERIES:
        whole, mean = [round(v * TENTH) if on else 0 for v, on in zip(x, there)], lambda total: float(total) / TENTH
    elif held:
        # A difference of two decimals of 38 digits keeps nine behind the point.
        whole, mean = tenths, lambda total: (1 if total > 0 else -1) * ((abs(total) + 5) // 10) / 10**9
    else:
        unit = 2.0 ** (math.ceil(math.log(top) / math.log(2)) - UNIT_BITS) if top else 1.0
        whole, mean = [round(v / unit) if on else 0 for v, on in zip(x, finite)], lambda total: float(total) * unit
    total, odd = [0], [0]
    for w, on, fine in zip(whole, there, finite):
        total.append(total[-1] + w)
        odd.append(odd[-1] + (on and not fine))
    return [[math.nan if i < n - 1 or odd[i + 1] > odd[i + 1 - n] else mean(total[i + 1] - total[i + 1 - n]) / n for i in range(len(x))] for n in spans]
