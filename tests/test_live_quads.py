"""The live loop on outlines: the stream against the replay, late frames, and sessions that end."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gradelake.streaming import live, quads

DDL = "session bigint, frame bigint, t_ms bigint, confidence double, coverage double, " + ", ".join(f"{n} double" for n in quads.NAMES)


def frames(seed=1, sessions=3, n=40):
    rng, rows = random.Random(seed), []
    for s in range(sessions):
        t = 0
        for f in range(n):
            t += rng.choice([30, 100, 160, 400])
            rows.append((s, f, t, rng.choice([0.3, 0.7, 0.9, 0.9]), rng.choice([0.05, 0.2, 0.5, 0.95, 0.5]), *[rng.uniform(0, 100) for _ in quads.NAMES]))
    return rows


def by_hand(rows):
    """One coordinate at a time by the tracker of single numbers."""
    out = {}
    for s in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1]))
        each = [live.Tracker() for _ in quads.NAMES]
        for r in own:
            sampled = [t.step(r[2], r[3], r[4], v) for t, v in zip(each, r[5:], strict=True)][0]
            out[s, r[1]] = (sampled, each[0].state, *[t.smooth for t in each])
    return out


def rows_of(df):
    return {(r.session, r.frame): (r.sampled, r.state, *[r[n] for n in quads.NAMES]) for r in df.collect() if r.frame is not None}


def test_replay(spark):
    rows = frames()
    got = rows_of(quads.replay(spark.createDataFrame(rows, DDL)))
    want = by_hand(rows)
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and got[k][2:] == pytest.approx(want[k][2:], nan_ok=True) if want[k][2] is not None else got[k][2] is None for k in want)
    assert {v[1] for v in got.values()} == {"searching", "far", "close", "found"}
    # After a long pause the next sitting starts anew.
    later = [(0, 100, 10**6, 0.9, 0.5, *[7.0] * 8)]
    assert rows_of(quads.replay(spark.createDataFrame(rows + later, DDL)))[0, 100] == (True, "found", *[7.0] * 8)


def test_stream_equals_replay(spark, tmp_path):
    """Frames in several files, one of them late; the idle session ends and its state goes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = frames(2)
    last = max(r[2] for r in rows)
    source = tmp_path / "frames"
    source.mkdir()
    # The third file brings a frame that is older than the watermark, and one far ahead that moves it on.
    parts = [[r for r in rows if r[1] < 15], [r for r in rows if 15 <= r[1]], [(9, 0, last + 40_000, 0.9, 0.5, *[1.0] * 8)], [(0, 99, 5, 0.9, 0.5, *[1.0] * 8), (9, 1, last + 300_000, 0.9, 0.5, *[3.0] * 8)], [(9, 2, last + 300_100, 0.9, 0.5, *[3.0] * 8)]]
    names = DDL.replace(",", "").split()[::2]
    ddl = DDL

    def write(n):
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in parts[n]))

    for n in range(len(parts)):
        write(n)
        stream = quads.event_time(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(source)))
        query = quads.track(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    out = spark.read.schema(quads.OUTPUT).parquet(str(tmp_path / "out"))
    got, want = rows_of(out), by_hand(rows)
    assert {k: v for k, v in got.items() if k[0] != 9}.keys() == want.keys()  # the late frame is dropped
    for k, v in want.items():
        assert got[k][:2] == v[:2]
        assert (got[k][2] is None) == (v[2] is None) and (v[2] is None or got[k][2:] == pytest.approx(v[2:]))
    ended = {r.session for r in out.where(F.col("state") == "ended").collect()}
    assert ended >= {0, 1, 2}
    # After a pause a session starts anew: its outline isn't smoothed with the old one.
    assert got[9, 0][2] == 1.0 and got[9, 1][2] == got[9, 2][2] == 3.0
