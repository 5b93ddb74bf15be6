"""Jaro-Winkler similarity for columns of name pairs, an Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_WEIGHT = 0.1
PREFIX_MAX = 4


def _codes(texts: pd.Series, width: int) -> np.ndarray:
    """Code points, right-padded with zeros to ``width``."""
    return np.array(texts.tolist(), dtype=f"<U{width}").view(np.uint32).reshape(len(texts), width)


def _matched_in_order(codes: np.ndarray, taken: np.ndarray) -> np.ndarray:
    order = np.argsort(~taken, axis=1, kind="stable")
    return np.take_along_axis(codes, order, axis=1)


def jaro_winkler_block(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Similarity of equally long columns of non-null texts; loops run over positions, not rows."""
    len_l, len_r = left.str.len().to_numpy(), right.str.len().to_numpy()
    width = int(max(len_l.max(), len_r.max(), 1))
    a, b = _codes(left, width), _codes(right, width)
    reach = np.maximum(np.maximum(len_l, len_r) // 2 - 1, 0)
    a_taken, b_taken = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    widest = int(reach.max())
    for i in range(int(len_l.max())):
        waiting = i < len_l
        for j in range(max(0, i - widest), min(width, i + widest + 1)):
            found = waiting & (abs(i - j) <= reach) & (j < len_r) & ~b_taken[:, j] & (a[:, i] == b[:, j])
            a_taken[:, i] |= found
            b_taken[:, j] |= found
            waiting &= ~found
    matches = a_taken.sum(axis=1)
    swapped = _matched_in_order(a, a_taken) != _matched_in_order(b, b_taken)
    swapped &= np.arange(width) < matches[:, None]
    halves = swapped.sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (matches / len_l + matches / len_r + (matches - halves) / matches) / 3.0
    jaro = np.where(matches == 0, 0.0, jaro)
    head = min(PREFIX_MAX, width)
    same = (a[:, :head] == b[:, :head]) & (np.arange(head) < np.minimum(len_l, len_r)[:, None])
    prefix = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    score = jaro + prefix * PREFIX_WEIGHT * (1.0 - jaro)
    return np.where((left == right).to_numpy(), 1.0, score)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=left.index)
    known = left.notna() & right.notna()
    # Similar lengths together, so that one long text does not widen a whole batch.
    size = np.maximum(left[known].str.len(), right[known].str.len())
    for _, rows in size.groupby(np.ceil(np.log2(size.clip(lower=1)))).groups.items():
        out.loc[rows] = jaro_winkler_block(left.loc[rows], right.loc[rows])
    return out


# Marked so that a filter on the score does not make Spark compute it a second time.
jaro_winkler = jaro_winkler.asNondeterministic()
