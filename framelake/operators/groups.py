"""Many small groups in one call: a call of Python for each group costs more than what is done with a small one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_groups(df: DataFrame, keys: list[str], order: str | list[str], run, schema: str, rows: int = 50_000) -> DataFrame:
    """run(frame) over whole groups of `keys`, sorted by `order`: many small groups at a time, a frame of about `rows` rows or of one larger group. The groups of a
    frame differ in size by less than a factor of two, so that they can be laid out side by side."""

    def cut(batches):
        import numpy as np
        import pandas as pd

        held, size, wanted = [], 0, rows
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < wanted:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = int(np.flatnonzero(whole["_place"].to_numpy() == 1)[-1])  # where the group begins that may go on
            if last:
                yield from alike(whole.iloc[:last].reset_index(drop=True))
            held, size = [whole.iloc[last:]], len(whole) - last
            wanted = max(rows, 2 * size)
        if size:
            yield from alike(pd.concat(held, ignore_index=True))

    def alike(frame):
        import numpy as np

        _, own, _ = lines_of(frame, keys)
        kind = np.frexp(np.bincount(own))[1][own]
        for k in np.unique(kind):
            yield run(frame[kind == k].reset_index(drop=True))

    along = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_first(c) for c in ([order] if isinstance(order, str) else order)])
    return df.withColumn("_place", F.row_number().over(along)).mapInPandas(cut, schema)  # the window brings groups together and sorts them, without a shuffle where they are together


def changes(frame, keys: list[str]):
    """Whether a row of a sorted frame is the first of its group."""
    import numpy as np

    first = np.ones(len(frame), np.bool_)
    first[1:] = np.any([frame[k].to_numpy()[1:] != frame[k].to_numpy()[:-1] for k in keys], axis=0)
    return first


def lines_of(frame, keys: list[str]):
    """(first row of each group, a row's group, its place there)."""
    import numpy as np

    first = np.flatnonzero(changes(frame, keys))
    own = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(frame)]))
    return first, own, np.arange(len(frame)) - first[own]
