"""Whole groups out of sorted Arrow batches, many groups to a frame."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd


def whole_groups(batches: Iterable[pd.DataFrame], by: Sequence[str], block: int = 100_000) -> Iterator[pd.DataFrame]:
    """Frames that end with a group's last row; the rest waits for the next batch."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size >= block:
            whole = pd.concat(held, ignore_index=True)
            last = np.ones(len(whole), bool)
            for c in by:
                last &= (whole[c] == whole[c].iloc[-1]).to_numpy()
            cut = int(np.argmax(last))
            held, size = [whole.iloc[cut:]], len(whole) - cut
            if cut:
                yield whole.iloc[:cut].reset_index(drop=True)
    if size:
        yield pd.concat(held, ignore_index=True)
