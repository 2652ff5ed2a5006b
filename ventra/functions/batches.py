"""Batches of sorted rows inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame], ids: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups, one at a time, of rows that come sorted by ``ids``."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.zeros(len(pdf), bool)
        for c in ids:
            v = pdf[c]
            new |= ~(v.eq(v.shift()) | (v.isna() & v.shift().isna())).to_numpy()
        new[0] = bool(held) and not _same(held[-1][ids].iloc[-1], pdf[ids].iloc[0])
        cut = np.flatnonzero(new)
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(pdf)]):
            if held and new[a]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            if b > a:
                held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _same(a: pd.Series, b: pd.Series) -> bool:
    return all((pd.isna(x) and pd.isna(y)) or x == y for x, y in zip(a, b))
