"""Groups of sorted Arrow batches, without a call into Spark's group-wise functions for each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list[pd.DataFrame]]:
    """Lists of whole groups: rows that agree on ``keys`` follow each other in the batches.

    Each list holds the groups that end in one batch, so a list's rows stay near a batch's number plus
    the longest group's.
    """
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        rest.append(batch)
        whole = pd.concat(rest, ignore_index=True) if len(rest) > 1 else batch
        values = [whole[k].to_numpy() for k in keys]
        change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        if len(change):
            edges = [0, *change.tolist()]
            yield [whole.iloc[a:b] for a, b in zip(edges, edges[1:], strict=False)]
            whole = whole.iloc[edges[-1] :]
        rest = [whole]
    if rest:
        yield [rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True)]


def spans(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Like ``groups``, but each list as one frame and the starts of its groups, with the end."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        rest.append(batch)
        whole = pd.concat(rest, ignore_index=True) if len(rest) > 1 else batch.reset_index(drop=True)
        values = [whole[k].to_numpy() for k in keys]
        change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        if len(change):
            yield whole.iloc[: change[-1]], np.concatenate([[0], change])
            whole = whole.iloc[change[-1] :].reset_index(drop=True)
        rest = [whole]
    if rest:
        whole = pd.concat(rest, ignore_index=True)
        yield whole, np.array([0, len(whole)])


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that the edges (a, b) reach, for each of ``n``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
