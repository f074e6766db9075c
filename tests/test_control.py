import os
import threading
import time

import numpy as np
import pytest
from pyspark import inheritable_thread_target

from sievework.sources import listing
from sievework.sources.listing import load_cache, scan
from sievework.streaming.control import Latest, Throttle, scan_in_parts
from tests.test_functions import pattern, png


def library(root, n):
    os.makedirs(root, exist_ok=True)
    body = png(np.kron(pattern(), np.ones((2, 2), np.uint8)))
    for i in range(n):
        with open(f"{root}/p{i}.png", "wb") as f:
            f.write(body)


def test_throttle():
    now = [0.0]
    t = Throttle(0.1, lambda: now[0])
    claims = []
    for at in (0.0, 0.05, 0.1, 0.19, 0.2):
        now[0] = at
        claims.append(t.claim())
    assert claims == [True, False, True, False, True]


def test_a_stopped_scan_keeps_its_parts(spark, tmp_path):
    root, table = str(tmp_path / "lib"), str(tmp_path / "cache")
    library(root, 12)
    turns = iter([False, False, True])
    assert scan_in_parts(spark, [root], table, lambda: next(turns), parts=4) == 2
    kept = load_cache(spark, table).count()
    assert 0 < kept < 12 and not os.path.exists(table + ".parts")
    assert sum(r.from_cache for r in scan(spark, [root], load_cache(spark, table)).collect()) == kept
    assert scan_in_parts(spark, [root], table, parts=2) == 2
    assert load_cache(spark, table).count() == 12


def test_a_failed_part_loses_none_before_it(spark, tmp_path, monkeypatch):
    from sievework.streaming import control

    root, table = str(tmp_path / "lib"), str(tmp_path / "cache")
    library(root, 6)
    calls = []

    def breaks(share):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("cancelled")
        return listing.analysed(share)

    monkeypatch.setattr(control, "analysed", breaks)
    with pytest.raises(RuntimeError):
        scan_in_parts(spark, [root], table, parts=2)
    assert 0 < load_cache(spark, table).count() < 6
    scan_in_parts(spark, [root], table, parts=2)
    assert load_cache(spark, table).count() == 6


def test_only_the_last_run_counts(spark):
    runs, got = Latest(spark), {}

    def slow():
        def wait(batches):
            time.sleep(60)
            yield from batches

        return spark.range(1).mapInArrow(wait, "id long").count()

    first = threading.Thread(target=inheritable_thread_target(spark)(lambda: got.update(first=runs.run(slow))))
    began = time.time()
    first.start()
    time.sleep(3)
    assert runs.run(lambda: spark.range(5).count()) == 5
    first.join(30)
    assert not first.is_alive() and got == {"first": None} and time.time() - began < 40
    with pytest.raises(ZeroDivisionError):
        runs.run(lambda: 1 // 0)


def test_availability(tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"x")
    assert listing.availability(str(tmp_path / "a")) == "Local"
    assert listing.availability(str(tmp_path / "b")) == "Unavailable" and listing.availability("a\0b") == "Unavailable"
    monkeypatch.setattr(listing, "_attributes", lambda s, n: 0x400000)
    assert listing.availability(str(tmp_path / "a")) == "OnlineOnly"
