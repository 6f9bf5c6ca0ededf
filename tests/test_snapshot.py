"""Maintained snapshots against the whole log folded at once."""

import random

from galewatch.functions.tables import children
from galewatch.streaming import snapshot

SCHEMA = "track string, site string, at long, note string"


def test_snapshot_equals_folded_log(spark, tmp_path):
    rng, path, log = random.Random(1), str(tmp_path / "tracks"), []
    files = []
    for batch in range(6):
        rows = [(rng.choice([None, *(f"t{k}" for k in range(40))]), "s", batch * 100 + rng.randrange(60), f"b{batch}") for _ in range(30)]
        log += rows
        df = spark.createDataFrame(rows, SCHEMA)
        for _ in range(1 + batch % 2):  # a batch that is repeated changes nothing
            snapshot.merge(df, path, ["track"], ["at"], parts=4)
        files.append(sum(len([f for f in children(spark, f"{path}/{p}") if f.endswith(".parquet")]) for p in children(spark, path) if p.startswith("_part")))
    got = {r["track"]: (r["at"], r["note"]) for r in snapshot.read(spark, path, SCHEMA).collect()}
    want = {}
    for track, _, at, note in log:
        want[track] = max(want.get(track, (-1, "")), (at, note))
    assert got == want and set(files[1:]) == {4}  # one file a part, however many batches


def test_only_touched_parts_are_written(spark, tmp_path):
    path = str(tmp_path / "s")
    snapshot.merge(spark.createDataFrame([(f"t{k}", "s", 1, "a") for k in range(50)], SCHEMA), path, ["track"], ["at"], parts=8)
    before = {p: children(spark, f"{path}/{p}") for p in children(spark, path) if p.startswith("_part")}
    snapshot.merge(spark.createDataFrame([("t7", "s", 2, "b")], SCHEMA), path, ["track"], ["at"], parts=8)
    after = {p: children(spark, f"{path}/{p}") for p in before}
    assert len(before) == 8 and sum(before[p] != after[p] for p in before) == 1
    snapshot.merge(spark.createDataFrame([], SCHEMA), path, ["track"], ["at"], parts=8)
    assert snapshot.read(spark, path, SCHEMA).count() == 50 and snapshot.read(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    assert snapshot.read(spark, path, SCHEMA).where("track = 't7'").collect() == [("t7", "s", 2, "b")]
