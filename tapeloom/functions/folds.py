"""The recurrences folded over tokens' closed bars in Arrow batches.

Each step is that of ``recurrences``, with the same order of operations, taken
for many tokens at once: the states of a batch's tokens are arrays, and a step
moves all of them one session on. Spark gathers and deals out the tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells (tokens by sessions) that are folded at once.
CELLS = 1 << 20
#: Elements of a batch's lists that a function takes at once. What it derives of an element is up to a kilobyte.
PART = 1 << 17
WILDER = "struct<n: int, last: double, gain: double, loss: double>"
Maybe = tuple[np.ndarray, np.ndarray]  # values, and where they are not null


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring lists that fill few cells when padded to the longest."""
    at, longest = 0, 0
    for k, size in enumerate(np.diff(offsets).tolist()):
        longest = max(longest, size)
        if k > at and longest * (k + 1 - at) > CELLS:
            yield at, k
            at, longest = k, size
    if at < len(offsets) - 1:
        yield at, len(offsets) - 1


def in_parts(fold: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """A fold of lists, taken over runs of neighbouring ones with at most ``PART`` elements (or one list).

    A batch is bounded by its bytes as they come; with its parts taken one after the other, what is derived of them is bounded too.
    """

    def run(*lists: pa.Array) -> pa.Array:
        ends, at, parts = _offsets(lists[0])[1:], 0, []
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
            parts.append(fold(*(x.slice(at, to - at) for x in lists)))
            at = to
        return pa.concat_arrays(parts) if parts else fold(*lists)

    return run


def _flat(lists: pa.Array) -> Maybe:
    return _maybe(lists.flatten())


def _maybe(values: pa.Array) -> Maybe:
    ok = values.is_valid().to_numpy(zero_copy_only=False)
    kind = pa.int32() if pa.types.is_date32(values.type) else pa.int64() if pa.types.is_timestamp(values.type) or pa.types.is_integer(values.type) else pa.float64()
    values = values.cast(kind)
    return values.fill_null(0).to_numpy(zero_copy_only=False), ok


class Wilder:
    """Wilder's states of some tokens (``recurrences.wilder``)."""

    def __init__(self, tokens: int, period: int) -> None:
        self.period = period
        self.n = np.zeros(tokens, np.int32)
        self.last, self.gain, self.loss = np.zeros((3, tokens))
        self.last_ok, self.loss_ok = np.ones((2, tokens), bool)

    def after(self, price: np.ndarray, ok: np.ndarray) -> Wilder:
        p, n, out = self.period, self.n, object.__new__(Wilder)
        d, known = price - self.last, ok & self.last_ok
        rose = known & ((d > 0) | np.isnan(d))
        average = lambda held, change: np.where(n == 0, 0.0, np.where(n < p, held + change, np.where(n == p, (held + change) / float(p), (held * float(p - 1) + change) / float(p))))
        out.period, out.n, out.last, out.last_ok = p, n + np.int32(1), price, ok
        out.gain, out.loss = average(self.gain, np.where(rose, d, 0.0)), average(self.loss, np.where(rose, 0.0, -d))
        out.loss_ok = (n == 0) | (self.loss_ok & known)
        return out

    def where(self, on: np.ndarray, other: Wilder) -> Wilder:
        out = object.__new__(Wilder)
        out.period = self.period
        for name in ("n", "last", "gain", "loss", "last_ok", "loss_ok"):
            setattr(out, name, np.where(on, getattr(other, name), getattr(self, name)))
        return out

    def rsi(self) -> Maybe:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.loss == 0, 100.0, 100.0 - 100.0 / (1.0 + self.gain / self.loss)), (self.n > self.period) & self.loss_ok

    def parts(self) -> dict[str, Maybe]:
        every = np.ones(len(self.n), bool)
        return {"n": (self.n, every), "last": (self.last, self.last_ok), "gain": (self.gain, every), "loss": (self.loss, self.loss_ok)}


class Table:
    """Columns of all bars, filled by sessions of blocks of tokens."""

    def __init__(self, bars: int) -> None:
        self.bars, self.columns = bars, {}

    def put(self, at: np.ndarray, name: str, got: Maybe, live: np.ndarray) -> None:
        if name not in self.columns:
            self.columns[name] = np.zeros(self.bars, got[0].dtype), np.zeros(self.bars, bool)
        for held, new in zip(self.columns[name], got, strict=True):
            held[at] = new[live]

    def column(self, name: str) -> Maybe:
        return self.columns.get(name, (np.zeros(self.bars), np.zeros(self.bars, bool)))

    def array(self, name: str, kind: pa.DataType | None = None) -> pa.Array:
        values, ok = self.columns.get(name, (np.zeros(0), np.zeros(0, bool)))
        out = pa.array(values, mask=~ok)
        return out.cast(kind) if kind is not None else out

    def state(self, name: str) -> pa.Array:
        return pa.StructArray.from_arrays([self.array(f"{name}.{c}", pa.int32() if c == "n" else pa.float64()) for c in ("n", "last", "gain", "loss")], ["n", "last", "gain", "loss"])


def _sessions(offsets: np.ndarray, *columns: Maybe) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[Maybe]]]:
    """By block of tokens and session: the tokens' number, the session, its bars, whose they are, and their values and nulls."""
    for first, last in _blocks(offsets):
        starts, sizes = offsets[first:last], np.diff(offsets[first : last + 1])
        sessions = np.arange(int(sizes.max(initial=0)))[:, None]
        every = sessions < sizes
        places = np.where(every, starts + sessions, 0)
        padded = [(values[places], ok[places] & every) for values, ok in columns]  # a session's bars lie together
        for t, live in enumerate(every):
            yield last - first, t, places[t][live], live, [(values[t], ok[t]) for values, ok in padded]


def _listed(offsets: np.ndarray, arrays: dict[str, pa.Array]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(arrays.values()), list(arrays)))


def _offsets(lists: pa.Array) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))


class Bars:
    """The bars of a batch's tokens (lists of structs), end to end, with looks at other bars of the same token."""

    def __init__(self, lists: pa.Array) -> None:
        self.offsets = offsets = _offsets(lists)
        self.rows, sizes = lists.flatten(), np.diff(offsets)
        self.place = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], sizes)
        self.left = np.repeat(sizes, sizes) - 1 - self.place

    def shifted(self, got: Maybe, n: int) -> Maybe:
        """What is ``n`` bars back (below 0: ahead); null where the token has no such bar."""
        if n == 0:
            return got
        return np.roll(got[0], n), np.roll(got[1], n) & (self.place >= n if n > 0 else self.left >= -n)

    def extremes(self, value: Maybe, widths: set[int], highest: bool, ahead: bool = False) -> dict[int, Maybe]:
        """The highest or lowest value of the last (``ahead``: next) n bars with the bar itself, for each width n.

        Nulls are left out and NaN is above all numbers, as in Spark's max and min.
        A frame is two overlapping ones of a width that doubles.
        """
        pick, none = (np.maximum, -np.inf) if highest else (np.fmin, np.nan)
        side = -1 if ahead else 1

        def wider(got: Maybe, by: int) -> Maybe:
            more, ok = self.shifted(got, side * by)
            return pick(got[0], np.where(ok, more, none)), got[1] | ok

        held, width = {1: (np.where(value[1], value[0], none), value[1])}, 1
        while 2 * width <= max(widths):
            held[2 * width], width = wider(held[width], width), 2 * width
        part = {w: 1 << (w.bit_length() - 1) for w in widths}
        return {w: wider(held[x], w - x) if w > x else held[x] for w, x in part.items()}

    def of(self, name: str) -> Maybe:
        return _maybe(self.rows.field(name))


class Reading:
    """Values to be compared as columns are: a null gives no true, and NaN is above all numbers."""

    def __init__(self, got: Maybe | float) -> None:
        self.values, self.ok = got if isinstance(got, tuple) else (np.float64(got), np.True_)

    def __gt__(self, other: Reading | float) -> np.ndarray:
        return _above(self, other if isinstance(other, Reading) else Reading(other))

    def __lt__(self, other: Reading | float) -> np.ndarray:
        return _above(other if isinstance(other, Reading) else Reading(other), self)

    def __ge__(self, other: Reading | float) -> np.ndarray:
        other = other if isinstance(other, Reading) else Reading(other)
        return self.ok & other.ok & ~_above(other, self)

    def __le__(self, other: Reading | float) -> np.ndarray:
        return (other if isinstance(other, Reading) else Reading(other)) >= self

    def between(self, low: float, high: float) -> np.ndarray:
        return (self >= low) & (self <= high)


def _above(a: Reading, b: Reading) -> np.ndarray:
    return a.ok & b.ok & ((a.values > b.values) | (np.isnan(a.values) & ~np.isnan(b.values)))


TIMESTAMP = pa.timestamp("us", tz="UTC")


def _cloud(a: Maybe, b: Maybe, top: bool) -> Maybe:
    """The greater (or lesser) of two, of which either may be null."""
    pick, none = (np.maximum, -np.inf) if top else (np.fmin, np.nan)
    return pick(np.where(a[1], a[0], none), np.where(b[1], b[0], none)), a[1] | b[1]


def ichimoku_lines(bars: Bars, lines: dict[str, tuple[int, int]], first_bar: int) -> dict[str, Maybe]:
    """Every Ichimoku line (null before the bar ``first_bar``), both clouds' edges and the references, as ``indicators.with_ichimoku`` gives them."""
    of = {c: bars.of(c) for c in ("open", "high", "low", "close")}
    widths = {last - first + 1 for first, last in lines.values()}
    with np.errstate(invalid="ignore"):
        top, bottom = bars.extremes(of["high"], widths, True), bars.extremes(of["low"], widths, False)
        middle = {w: ((top[w][0] + bottom[w][0]) / 2, top[w][1] & bottom[w][1]) for w in widths}
        got = dict(of)
        for k, (first, last) in lines.items():
            value, ok = bars.shifted(middle[last - first + 1], -last)
            got[k] = value, ok & (bars.place >= first_bar)
        for s in ("", "_52"):
            (a, a_ok), (b, b_ok) = got[f"past_conversion{s}"], got[f"past_base{s}"]
            span = (a + b) / 2, a_ok & b_ok
            got |= {f"cloud_top{s}": _cloud(span, got[f"span_b{s}"], True), f"cloud_bottom{s}": _cloud(span, got[f"span_b{s}"], False)}
    return got | {f"{c}_{n}": bars.shifted(of[c], n) for c in ("high", "low") for n in (26, 27)} | {"prev_close": bars.shifted(of["close"], 1)}


def hilega_lines(bars: Bars, rsi: int = 9, ema: int = 3, weighted: int = 21) -> dict[str, Maybe]:
    """``rsi``, ``ema`` and ``wma``, those of the bar before (``was_``), and ``past_wma`` of the one before that."""
    out = _hilega(bars.offsets, bars.of("close"), rsi, ema, False)
    got = {c: out.column(c) for c in ("rsi", "ema")}
    total, ok = None, True
    for n in range(weighted):  # the oldest first, as ``indicators.wma`` adds them
        value, known = bars.shifted(got["rsi"], weighted - 1 - n)
        total, ok = value * float(n + 1) if total is None else total + value * float(n + 1), ok & known
    got["wma"] = total / (weighted * (weighted + 1) / 2), ok
    return got | {f"was_{c}": bars.shifted(got[c], 1) for c in ("rsi", "ema", "wma")} | {"past_wma": bars.shifted(got["wma"], 2)}


def mtf_lines(bars: Bars, zone: str, period: int = 14) -> dict[str, Maybe]:
    """``rsi``, ``rsi_weekly`` and ``rsi_monthly`` by the dates in a zone, and ``was_rsi`` of the bar before."""
    when = pc.local_timestamp(bars.rows.field("date").cast(pa.timestamp("us", tz=zone)))
    days = when.cast(pa.timestamp("s"), safe=False).fill_null(0).to_numpy(zero_copy_only=False).astype("datetime64[D]")
    dated = when.is_valid().to_numpy(zero_copy_only=False)
    week, month = (days.astype(np.int64) + 3) // 7, days.astype("datetime64[M]").astype(np.int64)  # day 0 was a Thursday
    out = _multi_timeframe(bars.offsets, bars.of("close"), {"week": (week, dated), "month": (month, dated)}, period, False)
    got = {c: out.column(c) for c in ("rsi", "rsi_weekly", "rsi_monthly")}
    return got | {"was_rsi": bars.shifted(got["rsi"], 1)}


def forward_looks(bars: Bars, days: list[int]) -> dict[str, tuple[Maybe, pa.DataType]]:
    """What lies ahead: for the k-th of ``days`` the close ``__c<k>`` and date ``__d<k>`` of the bar that many sessions on (null where
    there is none), the highest high ``__<k>_hi`` and lowest low ``__<k>_lo`` on the way."""
    if not days:
        return {}
    number, got = pa.float64(), {}
    top, bottom = bars.extremes(bars.of("high"), set(days), True, ahead=True), bars.extremes(bars.of("low"), set(days), False, ahead=True)
    for k, n in enumerate(days):
        got |= {f"__c{k}": (bars.shifted(bars.of("close"), -n), number), f"__d{k}": (bars.shifted(bars.of("date"), -n), TIMESTAMP)}
        got |= {f"__{k}_hi": (bars.shifted(top[n], -1), number), f"__{k}_lo": (bars.shifted(bottom[n], -1), number)}
    return got


Rule = tuple[str, int, Callable[[Bars, str], tuple[np.ndarray, list[str]]]]


def found(bars: Column, rules: list[Rule], days: list[int], zone: str) -> Column:
    """For an array of a token's bars in order: an array of its signals, in order, with their forward looks.

    A rule is a strategy's name, its warm-up and what gives for every bar the
    number of its variant (0 for none) and the variants' names. Only bars with a
    signal leave the function.
    """

    def fold(lists: pa.Array) -> pa.Array:
        held = Bars(lists)
        at, rule, variant, names = [], [], [], []
        for k, (_, warmup, of) in enumerate(rules):
            number, called = of(held, zone)
            hit = np.flatnonzero((number > 0) & (held.place >= warmup))
            at, rule, variant = [*at, hit], [*rule, np.full(len(hit), k)], [*variant, number[hit] - 1 + len(names)]
            names += called
        at, rule, variant = (np.concatenate(x) for x in (at, rule, variant))
        order = np.argsort(at, kind="stable")
        at, rule, variant = at[order], rule[order], variant[order]
        got = {"session_idx": pa.array(held.place[at], pa.int32()), "date": held.rows.field("date").take(pa.array(at)).cast(TIMESTAMP), "strategy": pa.array([r[0] for r in rules]).take(pa.array(rule)), "variant": pa.array(names).take(pa.array(variant)), "entry_price": held.rows.field("close").take(pa.array(at))}
        for name, ((values, ok), kind) in forward_looks(held, days).items():
            got[name] = pa.array(values[at], mask=~ok[at]).cast(kind)
        return _listed(np.searchsorted(at, held.offsets), got)

    kind = "session_idx: int, date: timestamp, strategy: string, variant: string, entry_price: double" + "".join(f", `__c{k}`: double, `__d{k}`: timestamp, `__{k}_hi`: double, `__{k}_lo`: double" for k in range(len(days)))
    return F.arrow_udf(in_parts(fold), f"array<struct<{kind}>>")(bars)


def _starting(new: np.ndarray, got: Maybe, least: bool | None) -> Maybe:
    """Runs that begin at ``new``: their least or greatest value, or (None) their sum; null where all are."""
    big = np.iinfo(np.int64)
    of, none = {None: (np.add, 0), True: (np.minimum, big.max), False: (np.maximum, big.min)}[least]
    return of.reduceat(np.where(got[1], got[0], none), new), np.logical_or.reduceat(got[1], new)


def walk(date: Column, place: list[Column], dx: Column, tx: Column, ln: Column, q: Column) -> Column:
    """For arrays of a token's lines, in any order: an array of its daily bars, in order (``candles.from_lineitem`` has the rules)."""

    def fold(dates: pa.Array, *columns: pa.Array) -> pa.Array:
        offsets = _offsets(dates)
        token = np.repeat(np.arange(len(dates)), np.diff(offsets))
        all_ = [_flat(c) for c in (dates, *columns)]
        keys = [token]
        for values, ok in all_[:-4]:  # nulls first
            keys += [values] if ok.all() else [ok, values]
        order = np.lexsort(keys[::-1])
        (when, dated), *_, dx, tx, ln, q = [(values[order], ok[order]) for values, ok in all_]
        if not len(order):
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([], pa.struct([("date", TIMESTAMP), *((c, pa.float64()) for c in ("open", "high", "low", "close")), ("volume", pa.int64())])))
        of = lambda sums: sums - np.concatenate(([0], sums))[offsets[token]]
        px = of(np.cumsum(np.where(dx[1], dx[0], 0))) + 500, of(np.cumsum(dx[1])) > 0
        new = np.flatnonzero(np.concatenate(([True], (np.diff(token) != 0) | (np.diff(when) != 0) | (dated[1:] != dated[:-1]))))
        last = np.concatenate((new[1:], [len(order)])) - 1
        o = (px[0] - dx[0] + ln[0] - 4)[new], (px[1] & dx[1] & ln[1])[new]
        h, l, t, v = _starting(new, px, False), _starting(new, px, True), _starting(new, tx, False), _starting(new, q, None)
        big = np.iinfo(np.int64)
        high = np.maximum(np.where(h[1], h[0], big.min), np.where(o[1], o[0], big.min)), (h[1] | o[1]) & t[1]
        low = np.minimum(np.where(l[1], l[0], big.max), np.where(o[1], o[0], big.max)), (l[1] | o[1]) & v[1]
        got = {"date": (when[new], dated[new]), "open": o, "high": (high[0] + np.where(high[1], t[0], 0), high[1]), "low": (low[0] - np.where(low[1], np.fmod(v[0], 5), 0), low[1]), "close": (px[0][last], px[1][last]), "volume": v}
        days = np.concatenate(([0], np.cumsum(np.bincount(token[new], minlength=len(dates)))))
        kinds = {"date": TIMESTAMP, "volume": pa.int64()}
        return _listed(days, {k: pa.array(values, mask=~ok).cast(kinds.get(k, pa.float64())) for k, (values, ok) in got.items()})

    return F.arrow_udf(in_parts(fold), "array<struct<date: timestamp, open: double, high: double, low: double, close: double, volume: long>>")(date, *place, dx, tx, ln, q)


def _hilega(offsets: np.ndarray, close: Maybe, rsi: int, ema: int, state: bool) -> Table:
    k, out = 2.0 / (ema + 1.0), Table(int(offsets[-1]))
    for tokens, t, at, live, (price,) in _sessions(offsets, close):
        if t == 0:
            day, n, held = Wilder(tokens, rsi), np.zeros(tokens, np.int32), np.zeros(tokens)
        day = day.after(*price)
        value, ok = day.rsi()
        new = np.where(n < ema - 1, held + value, np.where(n == ema - 1, (held + value) / float(ema), value * k + held * (1 - k)))
        held, n = np.where(ok, new, held), n + ok.astype(np.int32)
        out.put(at, "rsi", (value, ok), live)
        out.put(at, "ema", (held, n >= ema), live)
        if state:
            every = np.ones(tokens, bool)
            for name, got in {**{f"day.{c}": x for c, x in day.parts().items()}, "ema.n": (n, every), "ema.value": (held, every)}.items():
                out.put(at, name, got, live)
    return out


def hilega(close: Column, rsi: int, ema: int, state: bool) -> Column:
    """For an array of closes in order: an array of ``rsi`` and its exponential average ``ema``, null where not defined; with ``state`` both recurrences' states."""

    def fold(closes: pa.Array) -> pa.Array:
        offsets = _offsets(closes)
        out = _hilega(offsets, _flat(closes), rsi, ema, state)
        got = {"rsi": out.array("rsi"), "ema": out.array("ema")}
        if state:
            got |= {"day_state": out.state("day"), "ema_state": pa.StructArray.from_arrays([out.array("ema.n", pa.int32()), out.array("ema.value")], ["n", "value"])}
        return _listed(offsets, got)

    more = f", day_state: {WILDER}, ema_state: struct<n: int, value: double>" if state else ""
    return F.arrow_udf(in_parts(fold), f"array<struct<rsi: double, ema: double{more}>>")(close)


def _multi_timeframe(offsets: np.ndarray, close: Maybe, buckets: dict[str, Maybe], period: int, state: bool) -> Table:
    names, out = list(buckets), Table(int(offsets[-1]))
    for tokens, t, at, live, (price, *now) in _sessions(offsets, close, *buckets.values()):
        if t == 0:
            day, done = Wilder(tokens, period), {b: Wilder(tokens, period) for b in names}
            was, before = (np.zeros(tokens), np.ones(tokens, bool)), {b: (np.zeros(tokens, np.int32), np.zeros(tokens, bool)) for b in names}
        day = day.after(*price)
        out.put(at, "rsi", day.rsi(), live)
        for b, (key, ok) in zip(names, now, strict=True):
            over = ok & before[b][1] & (key != before[b][0])
            if over.any():
                done[b] = done[b].where(over, done[b].after(*was))
            before[b] = key, ok
            out.put(at, f"rsi_{b}ly", done[b].after(*price).rsi(), live)
            if state:
                for c, x in {**{f"{b}.{c}": x for c, x in done[b].parts().items()}, f"{b}.bucket": before[b]}.items():
                    out.put(at, c, x, live)
        was = price
        if state:
            for c, x in {**{f"day.{c}": x for c, x in day.parts().items()}, "close": price}.items():
                out.put(at, c, x, live)
    return out


def multi_timeframe(close: Column, buckets: dict[str, Column], period: int, state: bool) -> Column:
    """For arrays of closes and of the dates of their ``buckets``, in order: an array of ``rsi`` and ``rsi_<bucket>ly``; with ``state`` also ``day_state`` and ``<bucket>_state``."""
    names = list(buckets)

    def fold(closes: pa.Array, *keys: pa.Array) -> pa.Array:
        offsets = _offsets(closes)
        out = _multi_timeframe(offsets, _flat(closes), dict(zip(names, map(_flat, keys), strict=True)), period, state)
        got = {"rsi": out.array("rsi"), **{f"rsi_{b}ly": out.array(f"rsi_{b}ly") for b in names}}
        if state:
            bucket = lambda b: out.array(f"{b}.bucket", pa.int32()).cast(pa.date32())
            got |= {"day_state": out.state("day"), **{f"{b}_state": pa.StructArray.from_arrays([out.state(b), bucket(b), out.array("close")], ["done", "bucket", "close"]) for b in names}}
        return _listed(offsets, got)

    kind = "rsi: double" + "".join(f", rsi_{b}ly: double" for b in names)
    if state:
        kind += f", day_state: {WILDER}" + "".join(f", {b}_state: struct<done: {WILDER}, bucket: date, close: double>" for b in names)
    return F.arrow_udf(in_parts(fold), f"array<struct<{kind}>>")(close, *buckets.values())
