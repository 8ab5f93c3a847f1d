"""The download state commits once, or not at all (SC15), and the gate of landed files (SC16)."""

import os

from airseries.sources import landing as L
from airseries.sources.state_log import STATE_SCHEMA, StateLog


def _rows(spark, pairs):
    return spark.createDataFrame(pairs, STATE_SCHEMA)


def _state(log):
    return sorted((r["resource_id"], r["last_modified"]) for r in log.read().collect())


def test_cycles_commit_once(spark, tmp_path):
    log = StateLog(spark, f"{tmp_path}/state", every=3)
    assert _state(log) == []
    assert log.commit("c1", lambda now: _rows(spark, [("a", "1"), ("b", "1")]))
    assert not log.commit("c1", lambda now: _rows(spark, [("a", "9")]))
    assert log.commit("c2", lambda now: _rows(spark, [("b", "2"), ("c", None)]))
    assert _state(log) == [("a", "1"), ("b", "2"), ("c", None)]


def test_a_run_cut_off_before_its_commit_leaves_the_state(spark, tmp_path):
    log = StateLog(spark, f"{tmp_path}/state")
    log.commit("c1", lambda now: _rows(spark, [("a", "1")]))
    log._write(_rows(spark, [("a", "lost")]))
    assert _state(log) == [("a", "1")]
    assert log.commit("c2", lambda now: _rows(spark, [("a", "2")])) and _state(log) == [("a", "2")]


def test_a_lost_race_is_tried_again_on_the_newer_state(spark, tmp_path):
    log, other = StateLog(spark, f"{tmp_path}/state"), StateLog(spark, f"{tmp_path}/state")
    seen = []

    def changed(now):
        seen.append(sorted(r["resource_id"] for r in now.collect()))
        if len(seen) == 1:  # another run commits between this one's read and its commit
            assert other.commit("other", lambda _: _rows(spark, [("x", "1")]))
        return _rows(spark, [("a", "1")])

    assert log.commit("mine", changed)
    assert seen == [[], ["x"]] and _state(log) == [("a", "1"), ("x", "1")]
    assert log._versions() == [0, 1]
    assert not log._create(1, {"kind": "delta", "cycles": [], "data": "none"})


def test_readers_open_a_snapshot_and_its_tail(spark, tmp_path):
    log = StateLog(spark, f"{tmp_path}/state", every=3)
    for i in range(11):
        assert log.commit(f"c{i}", lambda now, i=i: _rows(spark, [(f"r{i % 4}", str(i))]))
        assert len(log._tail()) <= 3
    assert _state(log) == [("r0", "8"), ("r1", "9"), ("r2", "10"), ("r3", "7")]
    assert not log.commit("c2", lambda now: _rows(spark, [("r0", "again")]))  # remembered through snapshots


def test_gate_reads_heads_only(spark, tmp_path):
    big = "x;y\n" * 100
    files = {"ok.csv": big, "short.csv": "a;b\n", "page.csv": "  <!DOCTYPE HTML><p>" + big,
             "tag.csv": "<HTML>" + big, "late.csv": big + "<html>", "edge.csv": "y" * 100}
    for name, text in (files | {"empty.csv": ""}).items():  # Spark does not list a file without bytes
        (tmp_path / name).write_text(text)
    got = {os.path.basename(r["path"]): (r["length"], r["valid"]) for r in L.landed_files(spark, str(tmp_path)).collect()}
    assert got == {n: (len(t), n in ("ok.csv", "late.csv", "edge.csv")) for n, t in files.items()}
