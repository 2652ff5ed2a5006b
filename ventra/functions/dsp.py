"""Signal kernels for grouped tasks: zero-phase filters, smoothing, peaks, splines, spectra.

Each works on one segment as arrays; Spark spreads the segments.
"""

from __future__ import annotations

import numpy as np


def _sections(cutoff: float, rate: float, high: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Third-order Butterworth as a first- and a second-order section (bilinear, pre-warped)."""
    k = np.tan(np.pi * cutoff / rate)
    one = np.array([1.0, -1.0]) if high else np.array([k, k])
    two = np.array([1.0, -2.0, 1.0]) if high else np.array([k * k, 2 * k * k, k * k])
    return [(one / (1 + k), np.array([1.0, -(1 - k) / (1 + k)])), (two / (1 + k + k * k), np.array([1.0, (2 * k * k - 2), (1 - k + k * k)]) / np.array([1.0, 1 + k + k * k, 1 + k + k * k]))]


_RESPONSES: dict[tuple[float, bool], np.ndarray] = {}


def _response(share: float, high: bool) -> np.ndarray:
    """Impulse response of both sections in turn, up to where it has died away; ``share`` is cut-off by rate."""
    if (share, high) not in _RESPONSES:
        sections = _sections(share, 1.0, high)
        slowest = max(np.abs(np.roots(a)).max() for _, a in sections)
        n = int(np.ceil(np.log(1e-16) / np.log(slowest))) + 4
        # the response of all poles by their powers, then the zeros: no loop over samples
        a = np.convolve(sections[0][1], sections[1][1])
        poles = np.roots(a)
        weights = poles ** (len(poles) - 1) / np.array([np.prod(q - np.delete(poles, i)) for i, q in enumerate(poles)])
        powers = np.exp(np.log(poles.astype(complex))[:, None] * np.arange(n))
        free = (weights[:, None] * powers).sum(axis=0).real
        _RESPONSES[share, high] = np.convolve(free, np.convolve(sections[0][0], sections[1][0]))[:n]
    return _RESPONSES[share, high]


def reach(share: float, high: bool = False) -> int:
    """Readings after which a one-way filter has forgotten what it saw."""
    return len(_response(share, high))


def _one_way(x: np.ndarray, high: bool, cutoff: float, rate: float) -> np.ndarray:
    """Both sections in turn, from the steady state of the first sample: as if it had stood there for ever."""
    h = _response(cutoff / rate, high)
    n = len(h) - 1
    size = 1 << (n + len(x) + n).bit_length()
    steady = np.r_[np.full(n, x[0]), x]
    return np.fft.irfft(np.fft.rfft(steady, size) * np.fft.rfft(h, size), size)[n : n + len(x)]


def zero_phase(x: np.ndarray, cutoff: float, rate: float, high: bool = False) -> np.ndarray:
    """Butterworth filter forward and backward over the signal, extended oddly by 12 samples."""
    n = 12
    if len(x) <= n:
        raise ValueError("the signal is shorter than its extension")
    padded = np.r_[2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]]
    once = _one_way(padded, high, cutoff, rate)
    return _one_way(once[::-1], high, cutoff, rate)[::-1][n:-n]


_FITS: dict[int, np.ndarray] = {}


def _quadratic_fit(half: int) -> np.ndarray:
    if half not in _FITS:
        _FITS[half] = np.linalg.pinv(np.vander(np.arange(-half, half + 1), 3, increasing=True).astype(float))
    return _FITS[half]


def smooth(x: np.ndarray, derivative: bool = False, rate: float = 1.0, half: int = 17) -> np.ndarray:
    """Quadratic least-squares smoothing over 2·half+1 points, or its slope; ends from the end fits."""
    width = 2 * half + 1
    k = np.arange(-half, half + 1)
    fit = _quadratic_fit(half)
    taps = fit[1] * rate if derivative else fit[0]
    if len(x) < width:
        raise ValueError("the signal is shorter than the window")
    out = np.empty(len(x))
    out[half:-half] = np.convolve(x, taps[::-1], "valid")
    for part, at, where in ((x[:width], k[:half], slice(0, half)), (x[-width:], k[half + 1 :], slice(len(x) - half, None))):
        c = fit @ part
        out[where] = (c[1] + 2 * c[2] * at) * rate if derivative else c[0] + c[1] * at + c[2] * at**2
    return out


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Strict local maxima, the middle of a plateau; ends are none."""
    step = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.r_[0, step + 1], np.r_[step, len(x) - 1]
    level = x[starts]
    peak = np.zeros(len(starts), bool)
    peak[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (starts[peak] + ends[peak]) // 2


def prominences(x: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prominence of each local maximum with the bases to its left and right (the nearest of equals).

    Between two maxima only the lowest reading matters, so a stack of maxima that are not yet topped
    settles all bases in one pass to each side; the ends of the signal stand as maxima too.
    """
    n = len(x)
    if not len(peaks):
        return np.empty(0), np.empty(0, int), np.empty(0, int)
    tops = np.unique(np.r_[0, local_maxima(x), peaks, n - 1])
    sides = []
    for v in (x, x[::-1]):
        at = tops if v is x else n - 1 - tops[::-1]
        height = v[at].tolist()
        low_at = [0] * len(at)
        for i in range(1, len(at)):  # last of the lowest between the maximum before and this one
            part = v[at[i - 1] : at[i] + 1][::-1]
            low_at[i] = int(at[i]) - int(part.argmin())
        base = [int(at[0])] * len(at)
        stack: list[int] = []
        for i, h in enumerate(height):
            low = low_at[i] if i else int(at[0])
            while stack and height[stack[-1]] <= h:
                k = base[stack.pop()]
                if v[k] < v[low]:
                    low = k
            base[i] = low
            stack.append(i)
        of = dict(zip(at.tolist(), base))
        sides.append(np.array([of[int(p) if v is x else n - 1 - int(p)] for p in peaks]))
    left, right = sides[0], n - 1 - sides[1]
    return x[peaks] - np.maximum(x[left], x[right]), left, right


def find_peaks(x: np.ndarray, prominence: float, distance: int = 1) -> np.ndarray:
    """Local maxima, thinned to ``distance`` with the highest kept, then by prominence."""
    p = local_maxima(x)
    keep = np.ones(len(p), bool)
    for i in np.argsort(x[p], kind="stable")[::-1] if distance > 1 else ():
        if keep[i]:
            a, b = np.searchsorted(p, [p[i] - distance + 1, p[i] + distance])
            keep[a:b] = False
            keep[i] = True
    p = p[keep]
    return p[prominences(x, p)[0] >= prominence]


def _down_to(x: np.ndarray, p: int, h: float, step: int) -> int:
    """First index from ``p`` on in direction ``step`` that is at ``h`` or lower; looked for in ever longer pieces."""
    size = 32
    while True:
        part = x[p : p + size] if step > 0 else x[max(0, p - size + 1) : p + 1][::-1]
        hit = np.flatnonzero(part <= h)
        if len(hit):
            return p + step * int(hit[0])
        size *= 4


def peak_widths(x: np.ndarray, peaks: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Width in samples at ``share`` of the prominence below each peak, crossings interpolated."""
    prom, left, right = prominences(x, peaks)
    out = np.empty(len(peaks))
    for i, p in enumerate(peaks):
        h = x[p] - share * prom[i]
        ends = []
        for step, base in ((-1, left[i]), (1, right[i])):
            a = _down_to(x, int(p), max(h, x[base]), step)
            ends.append(a - step * (h - x[a]) / (x[a - step] - x[a]) if x[a] < h else a)
        out[i] = ends[1] - ends[0]
    return out


#: The onset is where the slope reaches this share of its steepest; a slope above this bound counts as level.
ONSET_SHARE, LEVEL_SLOPE = 0.1, -0.5


def onsets(slope: np.ndarray, starts: np.ndarray, peaks: np.ndarray, share: float = ONSET_SHARE, level: float = LEVEL_SLOPE) -> np.ndarray:
    """Onset before each peak: where the fall that leads to it begins.

    Between ``starts`` and a peak the fall is followed back from its steepest reading to where the slope
    last turned negative (one pass marks those for the whole signal), or, if it never was anything
    else, to where it is most level; from there on the onset is the first reading with ``share`` of the
    steepest slope before the steepest reading itself.
    """
    falls = slope < 0
    turn = np.r_[False, falls[1:] & ~falls[:-1]]
    last_turn = np.maximum.accumulate(np.where(turn, np.arange(len(slope)), -1)) if len(slope) else slope
    out = np.array(starts, dtype=np.int64)
    for i, (a, b) in enumerate(zip(starts, peaks)):
        steepest = a + int(slope[a:b].argmin()) if b > a else a
        if steepest == a:
            continue
        since = last_turn[steepest - 1]
        if since <= a:
            flat = a + int(np.abs(slope[a:steepest]).argmin())
            since = flat if slope[flat] > level else a
        fall = slope[since:steepest]
        reached = fall <= share * fall.min()
        out[i] = since + int(reached.argmax()) if reached.any() else steepest - 1
    return out


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through the points with the not-a-knot condition at both ends."""
    n, h = len(x), np.diff(x)
    if n < 4:
        raise ValueError("fewer than four points")
    a, r = np.zeros((n, n)), np.zeros(n)
    i = np.arange(1, n - 1)
    a[i, i - 1], a[i, i], a[i, i + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    d = np.diff(y) / h
    r[1:-1] = 6 * np.diff(d)
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, r)
    j = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t = at - x[j]
    return y[j] + t * (d[j] - h[j] * (2 * m[j] + m[j + 1]) / 6) + t**2 * m[j] / 2 + t**3 * (m[j + 1] - m[j]) / (6 * h[j])


def welch(x: np.ndarray, rate: float, nperseg: int, overlap: float = 0.5, nfft: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """One-sided spectral density: mean removed once, Hamming windows, mean over windows."""
    x = x - x.mean()
    nperseg = min(nperseg, len(x))
    step = max(1, nperseg - int(round(nperseg * overlap)))
    w = np.hamming(nperseg)
    parts = np.lib.stride_tricks.sliding_window_view(x, nperseg)[::step] * w
    nfft = max(nfft, nperseg)
    p = np.abs(np.fft.rfft(parts, nfft, axis=1)) ** 2 / (rate * (w**2).sum())
    p[:, 1 : -1 if nfft % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(nfft, 1 / rate), p.mean(axis=0)


def simpson(y: np.ndarray, x: np.ndarray) -> float:
    """Composite Simpson rule on even steps; the last interval of an even count is corrected."""
    n = len(y)
    if n < 2:
        return float("nan")
    h = (x[-1] - x[0]) / (n - 1)
    if n == 2:
        return float(h * (y[0] + y[1]) / 2)
    m = n if n % 2 else n - 1
    s = h / 3 * (y[0] + y[m - 1] + 4 * y[1 : m - 1 : 2].sum() + 2 * y[2 : m - 2 : 2].sum())
    if n % 2 == 0:
        s += h * (5 * y[-1] + 8 * y[-2] - y[-3]) / 12
    return float(s)
