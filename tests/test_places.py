"""Places from files of all kinds, and the life-cycle queries against their SQL."""

import json
import struct

import pytest
from conftest import SMALL, same

from galewatch.plans import reports, round_queries
from galewatch.plans.catalog import ORACLES
from galewatch.sources import places, sites

ROWS = [("Tulsa", -95.99, 36.15, 413066), ("Ñandú", -60.5, -30.25, None), ("Zero", 0.0, 0.0, 0)]


def shapefile(path, rows, fields=(("NAME", 20), ("POP_MAX", 12), ("OTHER", 5))):
    shp = b"".join(struct.pack(">2i", i + 1, 10) + struct.pack("<i2d", 1, x, y) if x is not None else struct.pack(">2i", i + 1, 2) + struct.pack("<i", 0) for i, (_, x, y, _) in enumerate(rows))
    path.with_suffix(".shp").write_bytes(b"\0" * 100 + shp)
    head = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([k]) + b"\0" * 15 for n, k in fields)
    width = 1 + sum(k for _, k in fields)
    body = b"".join((b"*" if n == "deleted" else b" ") + n.encode().ljust(20) + ("" if p is None else str(p)).encode().rjust(12) + b"x".ljust(5) for n, _, _, p in rows)
    path.with_suffix(".dbf").write_bytes(b"\x03" + b"\0" * 3 + struct.pack("<IHH", len(rows), 32 + len(head) + 1, width) + b"\0" * 20 + head + b"\r" + body)


def test_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "shapes").mkdir()
    shapefile(tmp_path / "shapes/a", [*ROWS, ("no shape", None, None, 5), ("deleted", 1.0, 1.0, 5)])
    shapefile(tmp_path / "shapes/b", [("Far", 10.0, 20.0, "n/a")])
    got = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = sorted(ROWS, key=str)
    assert got(places.read_places(spark, str(tmp_path / "shapes/a.shp"))) == want
    assert got(places.shapefiles(spark, str(tmp_path / "shapes"))) == sorted([*ROWS, ("Far", 10.0, 20.0, None)], key=str)
    df = spark.createDataFrame(ROWS, "name string, lon double, lat double, pop_max long")
    df.write.parquet(str(tmp_path / "p.parquet"))
    df.write.option("header", "true").csv(str(tmp_path / "c.csv"))
    (tmp_path / "g.geojson").write_text("\n".join(json.dumps({"type": "Feature", "properties": {"name": n, "pop_max": p}, "geometry": {"type": "Point", "coordinates": [x, y]}}) for n, x, y, p in ROWS) + '\n{"type": "Feature", "geometry": null}')
    for name in ("p.parquet", "c.csv", "g.geojson"):
        assert got(places.read_places(spark, str(tmp_path / name))) == want, name
    inside = reports.places_inside(places.read_places(spark, str(tmp_path / "shapes/a.shp")), -100.0, -90.0, 30.0, 40.0, 1000)
    assert [r["name"] for r in inside.collect()] == ["Tulsa"]


def test_other_shapes_are_refused():
    with pytest.raises(ValueError):
        places.points(b"\0" * 100 + struct.pack(">2i", 1, 10) + struct.pack("<i2d", 5, 1.0, 2.0))


def test_locations_from_files(spark, tmp_path):
    (tmp_path / "source.py").write_text("""X = 1\nLOCATIONS = {\n  "KTLX": {"lat": 35.5, "lon": -97.25, "elev": 1213},\n  'TOKC': {'lat': 35.25, 'lon': -97.5, 'elev': -99999},
      "KZZZ": {"lat": 1.0, "lon": 2.0}, "KBAD": {"lat": "x"}, "KZZZ": {"lat": 3.0, "lon": 2.0}}\n""")
    got = sites.read_locations(spark, str(tmp_path / "source.py"))
    assert sorted(map(tuple, got.collect())) == [("KTLX", 35.5, -97.25, 1213.0), ("KZZZ", 3.0, 2.0, None), ("TOKC", 35.25, -97.5, -99999.0)]
    got.write.parquet(str(tmp_path / "l.parquet"))
    got.write.option("header", "true").csv(str(tmp_path / "l.csv"))
    for name in ("l.parquet", "l.csv"):
        assert sorted(map(tuple, sites.read_locations(spark, str(tmp_path / name)).collect())) == sorted(map(tuple, got.collect()))
    (tmp_path / "empty.py").write_text("pass")
    assert sites.read_locations(spark, str(tmp_path / "none.py")) is None is sites.read_locations(spark, str(tmp_path / "empty.py"))
    known = {r["site_id"]: r for r in sites.build_catalog(spark, got).collect()}
    assert "TOKC" not in known and known["KZZZ"]["elev_ft"] is None and known["KTLX"]["lat"] == 35.3331  # the checked core sites go first
    assert {r["site_id"]: r["elev_ft"] for r in sites.build_catalog(spark, got, include_terminal=True).collect()}["TOKC"] is None


@pytest.mark.parametrize("name", ["seeded_queue", "tracks_in_order", "padded_results", "selected_chip", "latest_tracks", "polling_rounds"])
def test_queries_equal_sql(spark, name):
    assert same(spark, SMALL, getattr(round_queries, name), ORACLES[name]) > 0
