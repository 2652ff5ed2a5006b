"""Implausible spikes in measurements: extreme-value cut-offs per source, stuck and impossible values."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import whole_groups
from ..session import durable, written


@dataclass(frozen=True)
class Signal:
    """What is possible for a signal, and the least spread it is credited with."""

    name: str
    low: float
    high: float
    resolution: float
    zero_is_rest: bool = False
    window: int = 25  # readings in a running median; the medians stand for level, trend and season


#: Physical limits (mmHg-like differential pressure, °C, counts, hPa) and resolutions.
SIGNALS = (
    Signal("smoothedpressure", -400.0, 400.0, 0.05),
    Signal("temp", 10.0, 50.0, 0.02),
    Signal("activity", 0.0, 5000.0, 1.0, zero_is_rest=True, window=11),
    Signal("atmpressure", 300.0, 1100.0, 0.1),
)

STRIDE = 4  # the running median is taken at every fourth reading
STUCK = 30  # equal readings that count as stuck
THRESHOLD = 0.90  # quantile of the absolute residual over which the tail is fitted
#: Bounds of the fitted tail, the scale as a share of its threshold (0.35 is that of a normal tail): in a short source
#: half of the excesses may be spikes, and a tail fitted to those has no cut-off to speak of.
MAX_SHAPE, MAX_SCALE = 0.1, 1.5
RISK = 1e-8  # chance of a reading of the fitted tail to pass the cut-off
SEASON, PHASES, SEASONS = 86_400.0, 24, 3  # length of the season in seconds, its parts, and how many a source must span to have one
#: Residuals are counted in bins of 1/16 octave from 2^-14 on, by sign; bin 0 holds what is below.
PER_OCTAVE, LEAST, BINS = 16, -14, 16 * 40
PART_ROWS, MOST_PARTS = 200_000, 100_000  # rows of a piece of the sorted readings, and most pieces


@dataclass
class Around:
    """What lies before and after a piece of a source: runs of equal readings, and readings for the running medians."""

    run_before: tuple[float, int] = (math.nan, 0)
    run_after: tuple[float, int] = (math.nan, 0)
    before: np.ndarray = field(default_factory=lambda: np.empty(0))
    after: np.ndarray = field(default_factory=lambda: np.empty(0))
    n_before: int = 0
    n_all: int | None = None


def residuals(x: np.ndarray, window: int, around: Around | None = None, stride: int = STRIDE) -> np.ndarray:
    """Reading minus the nearest of three running medians: of the readings before, around and after it.

    An excursion of a few readings leaves all three; the start or end of a lasting change of level
    agrees with one.  At the ends of a source the windows are shifted, not cut.  ``around`` has the readings
    before and after a piece of a source and its place in it, so that a piece gets what the whole would.
    """
    around = around or Around()
    total = len(x) if around.n_all is None else around.n_all
    if not len(x):
        return x
    w = min(window, total)
    have = np.r_[around.before, x, around.after]
    shift = around.n_before - len(around.before)  # place of the first of them in the source
    starts = np.arange(-(-shift // stride) * stride, min(total - w, shift + len(have) - w) + 1, stride)
    if total - w + w <= shift + len(have):
        starts = np.unique(np.r_[starts, total - w])
    starts = starts[starts >= shift] - shift
    part = np.lib.stride_tricks.sliding_window_view(have, w)[starts]
    middle = np.partition(part, w // 2, axis=1)[:, w // 2] if w % 2 else np.median(part, axis=1)
    edges = (starts[1:] + starts[:-1]) / 2
    own = np.arange(len(around.before), len(around.before) + len(x))
    best = None
    for back in (w // 2, w - 1, 0):
        r = x - middle[np.searchsorted(edges, own - back)]
        best = r if best is None else np.where(np.abs(r) < np.abs(best), r, best)
    return best


def _bins(r: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        b = np.floor((np.log2(np.abs(r)) - LEAST) * PER_OCTAVE) + 1
    return np.clip(b, 0, BINS - 1).astype(np.int64)


_UPPER = 2.0 ** (LEAST + np.arange(BINS) / PER_OCTAVE)
_MIDDLE = np.r_[0.0, _UPPER[1:] * 2 ** (-0.5 / PER_OCTAVE)]
_MIDDLE = np.r_[_MIDDLE, -_MIDDLE]  # below zero after those above


def histogram(r: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Counts of residuals by part of the season and signed bin, as one row of numbers."""
    return np.bincount((phase * 2 + (r < 0)) * BINS + _bins(r), minlength=PHASES * 2 * BINS)


def season_and_cutoff(counts: np.ndarray, seasonal: bool, s: Signal) -> tuple[np.ndarray, float]:
    """Median residual of each part of the season, and the cut-off for what residuals then differ from it.

    Both come from the counts alone, so pieces of a source only have to be added up.  Without enough
    seasons, or in parts with fewer than ten readings, the season is zero.
    """
    by_phase = counts.reshape(PHASES, 2 * BINS)
    profile = np.zeros(PHASES)
    if not seasonal:
        both = by_phase.sum(axis=0)
        return profile, tail_cutoff(both[:BINS] + both[BINS:], s)
    order = np.argsort(_MIDDLE, kind="stable")
    n = by_phase.sum(axis=1)
    at = (np.cumsum(by_phase[:, order], axis=1) * 2 >= n[:, None]).argmax(axis=1)
    profile = np.where(n >= 10, _MIDDLE[order][at], 0.0)
    rest = np.zeros(BINS, np.int64)
    for k in np.flatnonzero(n):
        have = np.flatnonzero(by_phase[k])
        np.add.at(rest, _bins(_MIDDLE[have] - profile[k]), by_phase[k][have])
    return profile, tail_cutoff(rest, s)


def tail_cutoff(counts: np.ndarray, s: Signal, threshold: float = THRESHOLD, risk: float = RISK) -> float:
    """Cut-off for the absolute residual from a generalized Pareto fit over ``threshold``.

    The fit uses the quantiles of the excesses (Pickands), since a few spikes can't move those;
    shape and scale are pulled to those of a normal tail where excesses are few.  What the
    cut-off excludes is taken out and the tail fitted again.
    """
    kept = counts.astype(float)
    cut = math.inf
    for _ in range(4):
        total = kept.sum()
        if not total:
            return math.inf
        cum = np.cumsum(kept) / total

        def quantile(p: float) -> float:
            return float(_UPPER[min(int(np.searchsorted(cum, p)), BINS - 1)])

        u = max(quantile(threshold), 1.5 * s.resolution)
        above = kept[_UPPER > u].sum()
        rate = above / total
        # prior: the tail of a normal distribution beyond its threshold, worth as much as 20 excesses
        scale, shape, weight = 0.35 * u, 0.0, above / (above + 20)
        if above >= 8:
            q2, q3 = quantile(1 - rate / 2) - u, quantile(1 - rate / 4) - u
            if q2 > 0 and q3 > q2:
                xi = float(np.clip(math.log2((q3 - q2) / q2), -0.25, MAX_SHAPE))
                beta = xi * q2 / (2.0**xi - 1) if abs(xi) > 1e-6 else q2 / math.log(2)
                shape, scale = weight * xi, weight * min(beta, MAX_SCALE * u) + (1 - weight) * scale
        excess = max(rate, 1e-3) / risk
        reach = scale / shape * (excess**shape - 1) if abs(shape) > 1e-6 else scale * math.log(excess)
        new = u + reach
        if new >= cut * 0.999:
            break
        cut = new
        kept = np.where(_UPPER > cut, 0, kept)
    return cut


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return start, np.diff(np.r_[start, len(x)])


def _stuck(x: np.ndarray, s: Signal, around: Around) -> np.ndarray:
    start, own = _runs(x)
    length = own.copy()
    if x[0] == around.run_before[0]:
        length[0] += around.run_before[1]
    if x[-1] == around.run_after[0]:
        length[-1] += around.run_after[1]
    bad = length >= STUCK
    if s.zero_is_rest:
        bad &= x[start] != 0
    return np.repeat(bad, own)


def _fit_for_tail(x: np.ndarray, s: Signal, around: Around) -> np.ndarray:
    """Readings that are possible and not part of a stuck run."""
    return (x >= s.low) & (x <= s.high) & ~_stuck(x, s, around)


def _read(group: pd.DataFrame, s: Signal) -> tuple[np.ndarray, np.ndarray]:
    v = group[s.name].to_numpy(float)
    at = np.flatnonzero(~np.isnan(v))
    return at, v[at]


def _phase(group: pd.DataFrame) -> np.ndarray:
    season = group["__season"].to_numpy(float)
    return np.where(np.isnan(season), 0, np.floor(np.nan_to_num(season) % SEASON / (SEASON / PHASES))).astype(np.int64)


def _spans_seasons(lo: float | None, hi: float | None) -> bool:
    return lo is not None and hi is not None and hi - lo >= SEASONS * SEASON


def flag_spikes(
    readings: DataFrame,
    keys: list[str],
    row_id: str,
    time: str,
    line: str,
    signals: tuple[Signal, ...] = SIGNALS,
    season: str | None = None,
    part_rows: int = PART_ROWS,
    n_rows: int | None = None,
) -> DataFrame:
    """Readings that can't be measurements: ``keys, row_id, signal_name, value, reason``.

    ``impossible`` (outside the signal's limits), ``stuck`` (one of ``STUCK`` or more equal readings of
    a source in unbroken order of ``time, line``) or ``spike``: the residual from the source's running
    medians, less the source's usual residual at that time of the season, lies beyond a cut-off that the
    source's own fitted tail passes with probability ``RISK``.  ``season`` is a column of seconds (``time``
    if not given); a source that spans fewer than ``SEASONS`` days has no season.

    Null and NaN values are passed over; rows with a null or NaN time sort last, in the order of ``line``;
    null keys form one source; a source of a few readings is judged by the prior tail; repeated rows are
    judged each.

    All rows (``n_rows``, counted if not given) are sorted over the whole cluster into pieces of about ``part_rows``, whatever source they
    are of, and written to the shared folder.  A source that lies in one piece is judged there.  Of one that
    reaches over several, each piece first gives its runs, then its readings next to the cuts, then its
    counts of residuals; put together in order, these give each piece what the whole source would, so the
    result does not hang on the cuts.  Per cut the driver holds some 50 numbers a signal, for ``MOST_PARTS``
    cuts at most.
    """
    spark = readings.sparkSession
    nil = lambda c: F.when(F.isnan(c), None).otherwise(c)
    rows = readings.select(
        *keys,
        F.col(row_id).cast("bigint").alias("__id"),
        nil(F.col(time).cast("double")).alias("__t"),
        nil(F.col(season or time).cast("double")).alias("__season"),
        F.col(line).cast("bigint").alias("__line"),
        *[F.col(s.name).cast("double").alias(s.name) for s in signals],
    )
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows.count() if n_rows is None else n_rows) // part_rows))
    order = [*keys, F.col("__t").asc_nulls_last(), "__line", "__id"]
    placed = rows.repartitionByRange(min(n_parts, MOST_PARTS), *order).sortWithinPartitions(*order)
    pieces = written(placed.drop("__t", "__line").withColumn("__part", F.spark_partition_id()))
    key = F.struct(*keys)
    ends = pieces.groupBy("__part").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy("__part").collect()
    chains: dict[tuple, list[int]] = {}  # parts of each source that lies in several
    for a, b in zip(ends, ends[1:]):
        if tuple(a.hi) == tuple(b.lo):
            chains.setdefault(tuple(a.hi), [a["__part"]]).append(b["__part"])
    around = _around(pieces, keys, signals, chains)
    given = _given(pieces, keys, signals, chains, around)

    kinds = dict(readings.dtypes)
    flag_schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", __id bigint, signal_name string, value double, reason string"

    def judged(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        source = _key_of(group, keys)
        beside = around.get((int(group["__part"].iloc[0]), source), {})
        phase = None
        for s in signals:
            at, x = _read(group, s)
            if not len(at):
                continue
            near = beside.get(s.name, Around())
            impossible = (x < s.low) | (x > s.high)
            stuck = _stuck(x, s, near)
            fit = ~impossible & ~stuck
            reason = np.where(impossible, "impossible", np.where(stuck, "stuck", ""))
            r = residuals(x[fit], s.window, near)
            if len(r):
                if phase is None:
                    phase = _phase(group)
                if source in chains:
                    profile, cut = given[source].get(s.name, (np.zeros(PHASES), math.inf))
                else:
                    t = group["__season"].to_numpy(float)
                    known = t[~np.isnan(t)]
                    profile, cut = season_and_cutoff(histogram(r, phase[at][fit]), bool(len(known)) and _spans_seasons(known.min(), known.max()), s)
                reason[np.flatnonzero(fit)[np.abs(r - profile[phase[at][fit]]) > cut]] = "spike"
            bad = np.flatnonzero(reason != "")
            if len(bad):
                out = group[[*keys, "__id"]].iloc[at[bad]].copy()
                out["signal_name"], out["value"], out["reason"] = s.name, x[bad], reason[bad]
                yield out

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for group in whole_groups(batches, [*keys, "__part"]):
            held += judged(group)
            if len(held) > 200:
                yield pd.concat(held)
                held = []
        if held:
            yield pd.concat(held)

    return pieces.mapInPandas(judge, flag_schema).select(*keys, F.col("__id").alias(row_id), "signal_name", "value", "reason")


def _key_of(group: pd.DataFrame, keys: list[str]) -> tuple:
    return tuple(None if pd.isna(v) else v for v in group[keys].iloc[0])


def _of_chains(pieces: DataFrame, keys: list[str], chains: dict[tuple, list[int]]) -> DataFrame:
    """Rows of the sources that lie in several pieces, in their order; the list of those has two entries a piece at most."""
    kinds = dict(pieces.dtypes)
    names = pieces.sparkSession.createDataFrame(list(chains), ", ".join(f"`__k{i}` {kinds[k]}" for i, k in enumerate(keys)))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return pieces.join(F.broadcast(names), same, "left_semi")


def _summaries(pieces: DataFrame, keys: list[str], signals: tuple[Signal, ...], chains: dict, what: Callable, fields: str) -> DataFrame:
    """One row per piece of a chain and signal, with what ``what`` makes of its readings."""
    kinds = dict(pieces.dtypes)
    names = [*keys, "__part", "signal_name", *[f.split()[0] for f in fields.split(", ")]]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, [*keys, "__part"]):
            source, part = _key_of(group, keys), int(group["__part"].iloc[0])
            out = []
            for s in signals:
                at, x = _read(group, s)
                if len(at):
                    out.append([*source, part, s.name, *what(group, source, part, s, at, x)])
            yield pd.DataFrame(out, columns=names, dtype=object)

    return _of_chains(pieces, keys, chains).mapInPandas(each, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", __part int, signal_name string, {fields}")


def _around(pieces: DataFrame, keys: list[str], signals: tuple[Signal, ...], chains: dict[tuple, list[int]]) -> dict:
    """What lies around each piece of each chain: ``(part, source) -> signal -> Around``."""
    found: dict[tuple, dict[str, Around]] = {(p, k): {s.name: Around() for s in signals} for k, parts in chains.items() for p in parts}
    if not chains:
        return found

    def runs(group, source, part, s, at, x):
        start, n = _runs(x)
        return float(x[0]), int(n[0]), float(x[-1]), int(n[-1]), len(start) == 1

    got = _summaries(pieces, keys, signals, chains, runs, "head double, head_n bigint, tail double, tail_n bigint, single boolean").collect()
    of = {(r["__part"], tuple(r[k] for k in keys), r.signal_name): r for r in got}
    for source, parts in chains.items():
        for s in signals:
            for ahead, walk in ((True, parts), (False, parts[::-1])):
                value, n = math.nan, 0
                for p in walk:
                    here = found[p, source][s.name]
                    if ahead:
                        here.run_before = (value, n)
                    else:
                        here.run_after = (value, n)
                    r = of.get((p, source, s.name))
                    if r is not None:
                        v, m = (r.tail, r.tail_n) if ahead else (r["head"], r.head_n)
                        value, n = v, (n if r.single and v == value else 0) + m
    partial = {k: {n: Around(a.run_before, a.run_after) for n, a in v.items()} for k, v in found.items()}

    def readings_at_ends(group, source, part, s, at, x):
        fit = x[_fit_for_tail(x, s, partial[part, source][s.name])]
        reach = s.window + 2 * STRIDE
        return len(fit), fit[:reach].tolist(), fit[-reach:].tolist()

    got = _summaries(pieces, keys, signals, chains, readings_at_ends, "n bigint, first array<double>, last array<double>").collect()
    of = {(r["__part"], tuple(r[k] for k in keys), r.signal_name): r for r in got}
    for source, parts in chains.items():
        for s in signals:
            reach = s.window + 2 * STRIDE
            total = sum(of[p, source, s.name].n for p in parts if (p, source, s.name) in of)
            kept, n = np.empty(0), 0
            for p in parts:
                here = found[p, source][s.name]
                here.before, here.n_before, here.n_all = kept, n, total
                if r := of.get((p, source, s.name)):
                    kept, n = np.r_[kept, r["last"]][-reach:], n + r.n
            kept = np.empty(0)
            for p in parts[::-1]:
                found[p, source][s.name].after = kept
                if r := of.get((p, source, s.name)):
                    kept = np.r_[r["first"], kept][:reach]
    return found


def _given(pieces: DataFrame, keys: list[str], signals: tuple[Signal, ...], chains: dict, around: dict) -> dict[tuple, dict]:
    """Season and cut-off of each source in several pieces: ``source -> signal -> (profile, cut)``."""
    out: dict[tuple, dict] = {k: {} for k in chains}
    if not chains:
        return out

    def counted(group, source, part, s, at, x):
        near = around[part, source][s.name]
        fit = _fit_for_tail(x, s, near)
        h = histogram(residuals(x[fit], s.window, near), _phase(group)[at][fit])
        t = group["__season"].to_numpy(float)
        known = t[~np.isnan(t)]
        have = np.flatnonzero(h)
        return have.tolist(), h[have].tolist(), float(known.min()) if len(known) else None, float(known.max()) if len(known) else None

    parts = durable(_summaries(pieces, keys, signals, chains, counted, "bins array<int>, counts array<bigint>, lo double, hi double"))
    spans = parts.groupBy(*keys, "signal_name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    pairs = parts.select(*keys, "signal_name", F.explode(F.arrays_zip("bins", "counts")).alias("p"))
    sums = pairs.groupBy(*keys, "signal_name", F.col("p.bins").alias("bin")).agg(F.sum("p.counts").alias("n"))
    whole = sums.groupBy(*keys, "signal_name").agg(F.collect_list(F.struct("bin", "n")).alias("h"))  # as many entries at most as there are bins
    same = F.col("a.signal_name") == F.col("b.signal_name")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    whole = whole.alias("a").join(spans.alias("b"), same).select("a.*", "b.lo", "b.hi")
    by_name = {s.name: s for s in signals}

    @F.pandas_udf("struct<profile array<double>, cut double>")
    def fitted(h: pd.Series, name: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
        found = []
        for pairs_, n, a, b in zip(h, name, lo, hi):
            counts = np.zeros(PHASES * 2 * BINS, np.int64)
            for p in pairs_:
                counts[p["bin"]] = p["n"]
            known = not (pd.isna(a) or pd.isna(b))
            profile, cut = season_and_cutoff(counts, known and _spans_seasons(a, b), by_name[n])
            found.append((profile.tolist(), cut))
        return pd.DataFrame(found, columns=["profile", "cut"])

    for r in whole.select(*keys, "signal_name", fitted("h", "signal_name", "lo", "hi").alias("f")).collect():
        out[tuple(r[k] for k in keys)][r.signal_name] = (np.array(r.f.profile), r.f.cut)
    return out
