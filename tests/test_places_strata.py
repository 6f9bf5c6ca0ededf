"""Places met in strata of population: the same places, fewer meetings."""

import pytest
from conftest import SMALL, duck, normal

from galewatch.plans import report_queries, reports
from galewatch.plans.catalog import ORACLES

SF = SMALL.replace("0.001", "0.01")


@pytest.mark.parametrize("stratum", [1, 30, 400])
def test_strata_show_the_same_places(spark, monkeypatch, stratum):
    want = normal(duck(SF).execute(ORACLES["places_on_maps"]).df())
    monkeypatch.setattr(reports, "STRATUM", stratum)
    assert normal(report_queries.places_on_maps(spark, SF).toPandas()) == want and len(want) > 100


def test_a_full_map_meets_no_further_stratum(spark, monkeypatch):
    monkeypatch.setattr(reports, "STRATUM", 40)
    kept = []
    made = reports.stored
    monkeypatch.setattr(reports, "stored", lambda rows, name: kept.append(made(rows, name)) or kept[-1])
    places = spark.range(2000).selectExpr("concat('p', id) AS name", "cast(id % 40 AS double) AS lon", "cast(id div 40 AS double) AS lat", "CASE WHEN id % 10 > 0 THEN id * 7919 % 2003 END AS pop_max")
    maps = spark.createDataFrame([(1, 0.0, 40.0, 0.0, 50.0), (2, 3.0, 4.0, 3.0, 4.0), (3, 9.0, 2.0, 0.0, 9.0)], "map int, west double, east double, south double, north double")
    got = [(r["map"], r["place_rank"], r["name"]) for r in reports.places_on_maps(places, maps, 0, 5).orderBy("map", "place_rank").collect()]
    every = sorted(((-(r["pop_max"] or 0), r["name"], r["lon"], r["lat"]) for r in places.collect()))
    near = [x for x in every if 3 <= x[2] <= 4 and 3 <= x[3] <= 4]
    assert got == [(1, k + 1, every[k][1]) for k in range(5)] + [(2, k + 1, x[1]) for k, x in enumerate(near[:5])]
    assert [k.where("map = 1").count() for k in kept] == [5] + [0] * (len(kept) - 1) and len(kept) > 1
