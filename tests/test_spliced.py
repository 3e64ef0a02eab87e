import random

import pytest
from pyspark.sql import functions as F

from touchgrid.operators import identity, spliced

BOXES = "match_id long, frame_idx long, det_idx long, class_id int, x1 double, y1 double, x2 double, y2 double, conf double"


def boxes(spark, seed, lives=False, every=1, n=600):
    """Boxes that come and go (or persons that never leave), with gaps longer than a track's memory."""
    rng = random.Random(seed)
    rows = []
    for m in (1, 2):
        for f in range(0, n, every):
            if not lives and 200 < f < 320:
                continue
            for d in range(4):
                x, y = (100.0 * d + f % 9, 50.0) if lives and d < 2 else (rng.uniform(0, 200), rng.uniform(0, 200))
                rows.append((m, f, d, 32 if d == 3 else 0, x, y, x + 40, y + 60, rng.choice([0.9, 0.6, 0.3])))
    return spark.createDataFrame(rows, BOXES).repartition(5)


def plain(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize(("lives", "every"), [(False, 1), (False, 3), (True, 1)])
def test_stretches_give_what_one_pass_gives(spark, lives, every):
    df = boxes(spark, 3, lives, every)
    assert plain(identity.tracked(df, stretch=130, warm=80)) == plain(identity.tracked(df, stretch=10**6, warm=0))
    assert plain(identity.associated(df, stretch=130, warm=80)) == plain(identity.associated(df, stretch=10**6, warm=0))
    cuts = df.where(F.col("frame_idx") % 90 == 0).select("match_id", "frame_idx")
    assert plain(identity.tracked(df, cuts, stretch=100, warm=95)) == plain(identity.tracked(df, cuts, stretch=10**6, warm=0))


def test_a_match_runs_in_more_than_one_task(spark, monkeypatch):
    """Where tracks die out no match goes through in one pass; before, each did."""
    monkeypatch.setattr(spliced, "one_pass", lambda *a: pytest.fail("a match in one pass"))
    df = boxes(spark, 5, every=2)
    cuts = df.where(F.col("frame_idx") % 100 == 50).select("match_id", "frame_idx")
    out = identity.tracked(df, cuts, stretch=100, warm=60)
    assert out.count() > 0 and out.where("track_id is null").count() == 0
