"""Indicators that each bar hands on to the next, for symbols of any length.

A symbol's bars lie in chunks. What a chunk makes of the state that it is given is summed up without
knowing that state: a mean with exponential weights is an affine map of the value before, a band of
SuperTrend keeps its value or takes one that does not depend on it, and its side is a map of two
values. The summaries of a symbol (one row a chunk) are followed from chunk to chunk, and then every
chunk replays its bars from the state it is given. Symbols of one chunk are replayed at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.sources.tables import chunked

#: Bars of a symbol that one task works on.
CHUNK = 1_000_000


class Ewm:
    """An exponentially weighted mean, value by value. The first value seeds it; a gap repeats it and fades its weight."""

    def __init__(self, alpha: float):
        self.alpha, self.keep, self.value, self.gap = alpha, 1 - alpha, None, 0

    def step(self, x: float | None) -> float | None:
        if x is None:
            self.gap += self.value is not None
        elif self.value is None:
            self.value = x
        elif not self.gap:
            self.value = self.value + self.alpha * (x - self.value)
        else:
            old = self.keep ** (self.gap + 1)
            self.value, self.gap = (old * self.value + self.alpha * x) / (old + self.alpha), 0
        return self.value


class EwmMap:
    """What a run of values makes of an Ewm's state: an affine map of its value from the first value in the run on."""

    def __init__(self, alpha: float):
        self.alpha, self.keep = alpha, 1 - alpha
        self.skipped, self.first, self.a, self.b, self.gap = 0, None, 1.0, 0.0, 0

    def step(self, x: float | None) -> None:
        if self.first is None:
            if x is None:
                self.skipped += 1
            else:
                self.first = x
        elif x is None:
            self.gap += 1
        else:
            old = self.keep ** (self.gap + 1)
            self.a, self.b, self.gap = old * self.a / (old + self.alpha), (old * self.b + self.alpha * x) / (old + self.alpha), 0

    def numbers(self) -> list[float]:
        return [self.skipped, math.nan if self.first is None else self.first, self.a, self.b, self.gap]


def after_map(numbers: list[float], alpha: float, value: float | None, gap: int) -> tuple[float | None, int]:
    """The state of an Ewm after the run that ``numbers`` sum up."""
    skipped, first, a, b, new_gap = numbers
    if math.isnan(first):
        return value, gap + int(skipped) if value is not None else 0
    if value is None:
        value = first
    else:
        old = (1 - alpha) ** (gap + int(skipped) + 1)
        value = (old * value + alpha * first) / (old + alpha)
    return a * value + b, int(new_gap)


class SuperTrend:
    """Bands that only tighten while price stays within; the line is the upper band in a fall, the lower in a rise."""

    def __init__(self, mult: float):
        self.mult, self.top, self.floor, self.below, self.close = mult, None, None, True, None

    def step(self, high: float, low: float, close: float, atr: float) -> tuple[float, int]:
        middle, reach = (high + low) / 2.0, self.mult * atr
        top, floor = middle + reach, middle - reach
        if self.top is None:
            self.top, self.floor, self.close = top, floor, close
            return top, -1
        # Where both bands met, the line counts as the upper one.
        was_below = self.below or self.top == self.floor
        if not (top < self.top or self.close > self.top):
            top = self.top
        if not (floor > self.floor or self.close < self.floor):
            floor = self.floor
        self.below = close <= top if was_below else close < floor
        self.top, self.floor, self.close = top, floor, close
        line = top if self.below else floor
        return line, 1 if line == floor else -1


class BandMap:
    """What bars make of an upper band: it stays as long as no bar's own band is below it and no close before is above it,
    else it takes that bar's band. Values that leave at one bar go on together, so only the few that differ are kept."""

    def __init__(self):
        self.low, self.high = -math.inf, math.inf  # bands in here are still as they were
        self.spans: list[tuple[float, float, int, float]] = []  # bands from, to, whose value they have now; 1 if they were too high
        self.values: dict[int, float] = {}

    def step(self, band: float, close: float) -> None:
        left = [k for k, v in self.values.items() if v > band or v < close]
        new = len(self.spans)
        spans = []
        if self.low <= self.high and self.high > band:
            spans.append((band if band >= self.low else math.nextafter(self.low, -math.inf), self.high, new, 1.0))
            self.high = band
        if self.low <= self.high and self.low < close:
            spans.append((self.low, close if close <= self.high else math.nextafter(self.high, math.inf), new, 0.0))
            self.low = close
        if not left and not spans:
            return
        if left:
            new = left[0]
            gone = set(left[1:])
            self.spans = [(a, b, new if k in gone else k, up) for a, b, k, up in self.spans]
            for k in gone:
                del self.values[k]
        self.spans += [(a, b, new, up) for a, b, _, up in spans]
        self.values[new] = band

    def numbers(self) -> list[float]:
        return [self.low, self.high, *(n for a, b, k, up in self.spans for n in (a, b, self.values[k], up))]


def after_band(numbers: list[float], band: float) -> float:
    """The band after the bars that ``numbers`` sum up."""
    if numbers[0] <= band <= numbers[1]:
        return band
    spans = zip(numbers[2::4], numbers[3::4], numbers[4::4], numbers[5::4])
    return next(v for a, b, v, up in spans if (a < band <= b if up else a <= band < b))


@dataclass(frozen=True)
class Periods:
    """Spans and multiples of the recursive indicators."""

    ema_trend: int = 50
    ema_pullback: int = 20
    atr: int = 14
    rsi: int = 14
    adx: int = 14
    st_atr: int = 10
    st_mult: float = 3.0


RECURSIVE = ["ema_trend", "ema_pullback", "atr", "rsi", "adx", "st_line", "st_dir"]
#: The means that depend on the bars alone, in order; ADX averages what three of them give.
MEANS = ["ema_trend", "ema_pullback", "atr", "st_atr", "gain", "loss", "range", "plus", "minus"]


def alphas(p: Periods) -> dict[str, float]:
    wilder = {"atr": p.atr, "st_atr": p.st_atr, "gain": p.rsi, "loss": p.rsi, "range": p.adx, "plus": p.adx, "minus": p.adx, "dx": p.adx}
    return {"ema_trend": 2 / (p.ema_trend + 1), "ema_pullback": 2 / (p.ema_pullback + 1)} | {k: 1 / n for k, n in wilder.items()}


def inputs(before: tuple | None, high: float, low: float, close: float) -> tuple:
    """What a bar gives to each of MEANS; ``before`` is the bar before it."""
    tr, up, down, won, lost = high - low, 0.0, 0.0, None, None
    if before is not None:
        h0, l0, c0 = before
        tr = max(tr, abs(high - c0), abs(low - c0))
        rise, fall = high - h0, l0 - low
        up, down = (rise if rise > fall and rise > 0 else 0.0), (fall if fall > rise and fall > 0 else 0.0)
        won, lost = max(close - c0, 0.0), max(c0 - close, 0.0)
    return close, close, tr, tr, won, lost, tr, up, down


def movement(r: float, u: float, d: float) -> float | None:
    """The directional movement that ADX averages, of the means of range, rises and falls."""
    plus, minus = (100.0 * u / r, 100.0 * d / r) if r else (0.0, 0.0)
    return 100.0 * abs(plus - minus) / (plus + minus) if plus + minus else None


@dataclass
class Start:
    """The state that a chunk begins with."""

    means: list[tuple[float | None, int]]
    dx: tuple[float | None, int] = (None, 0)
    top: float | None = None
    floor: float | None = None
    below: bool = True

    def ewms(self, p: Periods) -> tuple[list[Ewm], Ewm]:
        a = alphas(p)
        out = [Ewm(a[name]) for name in MEANS] + [Ewm(a["dx"])]
        for m, (value, gap) in zip(out, [*self.means, self.dx]):
            m.value, m.gap = value, gap
        return out[:-1], out[-1]


def _bars(pdf: pd.DataFrame) -> tuple[tuple | None, list[tuple], pd.DataFrame]:
    """The bar before a chunk, its own bars, and its rows in order."""
    pdf = pdf.sort_values("i", ignore_index=True)
    rows = list(zip(*(pdf[c].tolist() for c in ("high", "low", "close"))))
    lead = bool(pdf["_copy"].iloc[0])
    return (rows[0] if lead else None), rows[lead:], pdf.iloc[int(lead) :].reset_index(drop=True)


def replayed(pdf: pd.DataFrame, p: Periods, start: Start) -> pd.DataFrame:
    before, bars, pdf = _bars(pdf)
    means, dx = start.ewms(p)
    trend = SuperTrend(p.st_mult)
    trend.top, trend.floor, trend.below, trend.close = start.top, start.floor, start.below, before and before[2]
    rows = []
    for high, low, close in bars:
        slow, fast, atr, st_atr, won, lost, r, u, d = (m.step(x) for m, x in zip(means, inputs(before, high, low, close)))
        rsi = 50.0 if not lost else 100.0 - 100.0 / (1.0 + won / lost)
        strength = dx.step(movement(r, u, d))
        line, side = trend.step(high, low, close, st_atr)
        rows.append((slow, fast, atr, rsi, 0.0 if strength is None else strength, line, side))
        before = high, low, close
    return pd.concat([pdf, pd.DataFrame(rows, columns=RECURSIVE)], axis=1)


def _sum_means(pdf: pd.DataFrame, p: Periods, start: Start) -> list[float]:
    before, bars, _ = _bars(pdf)
    a = alphas(p)
    maps = [EwmMap(a[name]) for name in MEANS]
    for bar in bars:
        for m, x in zip(maps, inputs(before, *bar)):
            m.step(x)
        before = bar
    return [n for m in maps for n in m.numbers()]


def _sum_bands(pdf: pd.DataFrame, p: Periods, start: Start) -> list[float]:
    """Of dx and both bands; the floor is the upper band of the bars turned upside down. A symbol's first bar sets the bands."""
    before, bars, _ = _bars(pdf)
    means, _ = start.ewms(p)
    dx, top, floor = EwmMap(alphas(p)["dx"]), BandMap(), BandMap()
    for high, low, close in bars:
        *_, st_atr, _, _, r, u, d = (m.step(x) for m, x in zip(means, inputs(before, high, low, close)))
        dx.step(movement(r, u, d))
        middle, reach = (high + low) / 2.0, p.st_mult * st_atr
        c = before[2] if before else math.inf
        top.step(middle + reach, c)
        floor.step(-(middle - reach), -c if before else math.inf)
        before = high, low, close
    upper = top.numbers()
    return [*dx.numbers(), len(upper), *upper, *floor.numbers()]


def _sum_sides(pdf: pd.DataFrame, p: Periods, start: Start) -> list[float]:
    """Where the close ends, below or not, if it began so or not."""
    before, bars, _ = _bars(pdf)
    means, _ = start.ewms(p)
    both = []
    for below in (False, True):
        t = SuperTrend(p.st_mult)
        t.top, t.floor, t.below, t.close = start.top, start.floor, below, before and before[2]
        both.append(t)
    for high, low, close in bars:
        *_, st_atr, _, _, _, _, _ = (m.step(x) for m, x in zip(means, inputs(before, high, low, close)))
        for t in both:
            t.step(high, low, close, st_atr)
        before = high, low, close
    return [float(t.below) for t in both]


def _after_means(state: Start, numbers: list[float], p: Periods) -> Start:
    a = alphas(p)
    return Start([after_map(numbers[5 * k : 5 * k + 5], a[name], *state.means[k]) for k, name in enumerate(MEANS)])


def _after_bands(state: Start, numbers: list[float], p: Periods) -> Start:
    n = 6 + int(numbers[5])
    new = lambda part, sign, band: sign * after_band(part, math.inf if band is None else sign * band)
    return Start([], after_map(numbers[:5], alphas(p)["dx"], *state.dx), new(numbers[6:n], 1, state.top), new(numbers[n:], -1, state.floor))


def _after_sides(state: Start, numbers: list[float], p: Periods) -> Start:
    return Start([], below=bool(numbers[int(state.below)]))


def _flat(values: list[tuple[float | None, int]]) -> list[float]:
    return [x for v, g in values for x in (math.nan if v is None else v, float(g))]


def _pairs(flat: list[float]) -> list[tuple[float | None, int]]:
    return [(None if math.isnan(v) else v, int(g)) for v, g in zip(flat[::2], flat[1::2])]


def _start_of(pdf: pd.DataFrame) -> Start:
    """The state that the columns of a chunk's rows hold; what is not known yet is as at the start."""
    row = pdf.iloc[0]
    means = _pairs(row["_means"]) if "_means" in pdf else [(None, 0)] * len(MEANS)
    if "_bands" not in pdf:
        return Start(means)
    value, gap, top, floor = row["_bands"]
    bands = [None if math.isnan(x) else x for x in (top, floor)]
    return Start(means, _pairs([value, gap])[0], *bands, bool(row["_below"][0]) if "_below" in pdf else True)


def _as_row(state: Start, what: str) -> list[float]:
    if what == "_means":
        return _flat(state.means)
    if what == "_bands":
        return _flat([state.dx]) + [math.nan if x is None else x for x in (state.top, state.floor)]
    return [float(state.below)]


STEPS = [("_means", _sum_means, _after_means), ("_bands", _sum_bands, _after_bands), ("_below", _sum_sides, _after_sides)]


def _handed_on(rows: DataFrame, p: Periods, what: str, sum_up, after) -> DataFrame:
    """symbol, _chunk and the array ``what``: the state that each chunk begins with."""

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["symbol", "_chunk"]].head(1).assign(numbers=[sum_up(pdf, p, _start_of(pdf))])

    def followed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values("_chunk", ignore_index=True), Start([(None, 0)] * len(MEANS)), []
        for numbers in pdf["numbers"]:
            out.append(_as_row(state, what))
            state = after(state, list(numbers), p)
        return pdf[["symbol", "_chunk"]].assign(**{what: out})

    sums = rows.groupBy("symbol", "_chunk").applyInPandas(summed, "symbol string, _chunk long, numbers array<double>")
    return sums.groupBy("symbol").applyInPandas(followed, f"symbol string, _chunk long, {what} array<double>")


def recursive(bars: DataFrame, periods: Periods = Periods(), size: int | None = None) -> DataFrame:
    """``bars`` with ema_trend, ema_pullback, atr, rsi, adx, st_line and st_dir."""
    daily = size is None and dict(bars.dtypes)["date"] == "date"
    size = size or CHUNK
    keep = ["symbol", "date", "open", "high", "low", "close", "volume", "i"]
    rows = chunked(bars.select(*keep), "symbol", 1, 0, size)
    # With a bar a day a chunk is 2,700 years, so no second one is looked for.
    steps = [] if daily or rows.where("_chunk > 0").isEmpty() else STEPS
    for what, sum_up, after in steps:
        rows = rows.join(_handed_on(rows, periods, what, sum_up, after), ["symbol", "_chunk"])
    extra = ", ".join(f"{c} {'int' if c == 'st_dir' else 'double'}" for c in RECURSIVE)
    schema = f"symbol string, date {dict(bars.dtypes)['date']}, open double, high double, low double, close double, volume double, i long, " + extra

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return replayed(pdf, periods, _start_of(pdf))[[*keep, *RECURSIVE]]

    return rows.groupBy("symbol", "_chunk").applyInPandas(run, schema)
