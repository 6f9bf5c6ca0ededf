"""Queries take their whole tables."""

import pytest
from conftest import SMALL, same

from galewatch.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["upload_site", "azimuth_window"])
def test_every_event_has_a_row(spark, name):
    n = same(spark, SMALL, QUERIES[name], ORACLES[name])
    assert n == spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_cells_from_the_engine_threshold_on(spark):
    from galewatch.plans.radar_queries import CONFIG
    from galewatch.plans.views import sweep_gates

    assert CONFIG.cell_dbz_threshold == 40.0
    gates = {}
    for g in sweep_gates(spark, SMALL).collect():
        if g["dbz"] >= 40.0:
            gates.setdefault(g["sweep_id"], {})[g["ray_idx"], g["gate_idx"]] = g["dbz"]
    want = []
    for sweep, left in gates.items():
        found, label = [], 0
        for first in sorted(left):
            if first not in left:
                continue
            label += 1
            todo, cell = [first], {}
            while todo:
                y, x = p = todo.pop()
                if p in left:
                    cell[p] = left.pop(p)
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
            if len(cell) >= 5:
                centre = [round(sum(p[k] for p in cell) / len(cell)) for k in (0, 1)]
                found.append((-max(cell.values()), label, len(cell), *centre))
        want += [(sweep, label, n, -peak, y, x, i) for i, (peak, label, n, y, x) in enumerate(sorted(found))]
    got = QUERIES["connected_cells"](spark, SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
