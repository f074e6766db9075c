import os
import time
from datetime import datetime

import numpy as np

from sievework.operators import cleanup
from sievework.operators.grouping import group
from sievework.schema import CATALOG
from sievework.sources import ledger
from sievework.sources.listing import analysed, listing, load_cache, save_cache, scan
from sievework.streaming.incremental import arrivals, keep_cache
from tests.test_functions import pattern, png


def photos(at):
    big = np.kron(pattern(), np.ones((4, 4), np.uint8))
    files = {"a.png": png(big), "sub/a copy.png": png(big), "sub/_x.png": png(255 - big), "bad.jpg": b"junk", "notes.txt": b"no", "_Sievework Removed/z.png": png(big)}
    for name, body in files.items():
        os.makedirs(os.path.dirname(os.path.join(at, name)), exist_ok=True)
        with open(os.path.join(at, name), "wb") as f:
            f.write(body)


def test_listing_and_scan(spark, tmp_path):
    root = str(tmp_path / "lib")
    photos(root)
    files, missing = listing(spark, [root, root + "/sub", root + "/", str(tmp_path / "gone")])
    assert sorted(os.path.relpath(r.path, root) for r in files.collect()) == ["a.png", "bad.jpg", "sub/_x.png", "sub/a copy.png"]
    assert [r.status for r in missing.collect()] == ["Unreadable"]
    first = scan(spark, [root])
    by = {os.path.basename(r.path): r for r in first.collect()}
    assert by["bad.jpg"].status == "DecodeFailed" and by["bad.jpg"].sha256 and by["a.png"].p_hash is not None and by["a.png"].width == 128
    assert sorted(r.path for r in group(first, "Exact").collect()) == [root + "/a.png", root + "/sub/a copy.png"]
    table = str(tmp_path / "cache")
    assert load_cache(spark, table).count() == 0
    assert save_cache(first, table)
    os.utime(root + "/a.png", (time.time() + 5,) * 2)
    again = scan(spark, [root], load_cache(spark, table))
    assert sum(r.from_cache for r in again.collect()) == 3


def test_analysis_of_a_file_that_goes(spark, tmp_path):
    rows = spark.createDataFrame([(str(tmp_path / "no.png"), 1, datetime(2024, 1, 1))], "path string, size_bytes long, last_write timestamp_ntz")
    r = analysed(rows).first()
    assert r.status == "Unreadable" and r.sha256 is None and r.error == "FileNotFoundError"


def test_clean_up_and_undo(spark, tmp_path):
    root = str(tmp_path / "lib")
    photos(root)
    with open(root + "/sub/a copy.png.json", "w") as f:
        f.write("{}")
    m = group(scan(spark, [root]), "Exact")
    plan = cleanup.plan(m, m.filter("kind = 'Identical'").select("path"), spark.createDataFrame([(root,)], "root string"))
    rows = [r.asDict() for r in plan.collect()]
    out = ledger.execute(rows)
    assert [os.path.basename(a) for a, _ in out.moved] == ["a copy.png"] and out.sidecars == 1 and not out.failures
    assert not os.path.exists(root + "/sub/a copy.png") and len(ledger.batches([root])) == 1
    with open(root + "/sub/a copy.png", "w") as f:
        f.write("another")
    back = ledger.undo(out.manifests[0])
    assert [os.path.basename(b) for _, b in back.moved] == ["a copy (2).png"] and back.sidecars == 1
    assert os.path.exists(root + "/sub/a copy (2).png.json") and not ledger.batches([root])
    os.utime(root + "/a.png", (1, 1))
    assert [why for _, why in ledger.execute(rows).failures] == ["KeptCopyMissing"]


def test_stream(spark, tmp_path):
    root = str(tmp_path / "in")
    photos(root)
    keep_cache(arrivals(spark, root), str(tmp_path / "cache"), str(tmp_path / "cp")).awaitTermination(120)
    got = load_cache(spark, str(tmp_path / "cache"))
    assert got.columns == CATALOG.names and {os.path.basename(r.path) for r in got.collect()} >= {"a.png", "a copy.png"}
