"""Helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def whole_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by `key`, cut anew so that no group is split. Groups must be of bounded size."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = frame[key].iloc[-1]
        ends = int((frame[key] != last).to_numpy().nonzero()[0][-1]) + 1 if frame[key].iloc[0] != last else 0
        if held and held[-1][key].iloc[-1] != frame[key].iloc[0]:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        if ends:
            yield pd.concat([*held, frame.iloc[:ends]], ignore_index=True)
            held = []
        held.append(frame.iloc[ends:])
    if held:
        yield pd.concat(held, ignore_index=True)
