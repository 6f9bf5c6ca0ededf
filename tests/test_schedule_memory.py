"""A stream's micro-batch with many attempts of one site."""

import tracemalloc

import numpy as np
import pandas as pd

from galewatch.streaming import schedule


class Captured:
    """Stands for the stream: takes the function that a site's rows go through."""

    def groupBy(self, *_):  # noqa: N802
        return self

    def applyInPandasWithState(self, run, *_):  # noqa: N802
        self.run = run
        raise StopIteration


class Held:
    exists, get = False, None

    def update(self, counters):
        self.exists, self.get = True, tuple(counters)


def batches(n, size=10_000):
    kinds = np.array(["processed", "no_new_scan", "no_cells", "error", None, "no_scans"], dtype=object)
    for first in range(0, n, size):
        seq = n - 1 - np.arange(first, first + size)  # newest first
        cells = pd.Series(np.where(seq % 7 == 0, np.nan, seq % 4))
        yield pd.DataFrame({"site": ["A"] * size, "seq": seq, "status": kinds[(seq * 7 + seq // 11) % 6], "cells_found": cells, "chips_processed": seq % 3, "raw_detections": (seq % 5 == 0).astype(int), "detections": (seq % 11 == 0).astype(int)})


def test_a_site_costs_bytes_not_objects_per_attempt():
    stream = Captured()
    try:
        schedule.stream(stream)
    except StopIteration:
        pass
    n, rows, largest, held = 400_000, 0, 0, Held()
    tracemalloc.start()
    for frame in stream.run(("A",), batches(n), held):
        assert frame["seq"].iloc[0] == rows
        rows, largest = rows + len(frame), max(largest, len(frame))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and largest <= 10_000
    assert peak < 60 * n, peak / n  # before: some 500 bytes for each
    told, counters = schedule._folded(pd.concat(list(batches(n))).sort_values("seq").itertuples(), (0, 0, 0, 0))
    assert held.get == counters
