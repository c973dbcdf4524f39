"""Queries give the whole job: rows that earlier cuts left out. The SQL here is written for the test, without the cuts."""

import duckdb
import pytest

from keyframe.plans import sources
from keyframe.plans import surrogates as X

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.sql(f"create view {t} as from '{D}/{t}.parquet'")
    return con


def test_explode_every_episode(spark, duck):
    got = sources.explode_episodes(spark, D).collect()
    want = duck.sql(f"WITH {X.STEPS} SELECT ls, CAST(ep AS VARCHAR), CAST(row_number() OVER (PARTITION BY ls, ep ORDER BY step) - 1 AS INT), 'f' || step || '.png', label FROM steps").fetchall()
    assert any(int(w[1]) % 50 >= 25 for w in want)
    assert sorted(map(tuple, got)) == sorted(want)


def test_repeat_takes_late_frames(spark, duck):
    got = {r.video: r.picked for r in sources.repeat_to_count(spark, D).collect()}
    a = duck.sql(f"WITH {X.FRAMES} SELECT video, list(idx ORDER BY idx) FROM frames WHERE event_type = 'signup' GROUP BY video").fetchall()
    assert any(x[0] < 20 <= x[min(len(x), 7) - 1] for _, x in a)
    assert got == {v: ",".join(str(x[i % len(x)]) for i in range(7)) for v, x in a}
