"""Label files, reports, samples and the keeper split in one pass and in rounds."""

import importlib
import json
import pkgutil
import random

import pytest
from pyspark.sql import functions as F

import sievework
from sievework.operators import evaluate, grouping
from sievework.plans import views as V
from sievework.schema import CATALOG, SAME_PHOTO, Limits
from sievework.sources import labels


def test_every_module_imports():
    for m in pkgutil.walk_packages(sievework.__path__, "sievework."):
        if not m.name.startswith("sievework.llm"):
            importlib.import_module(m.name)


PAIRS = [
    {"id": 1, "bucket": "0–2", "keeperPath": "/a", "memberPath": "/b", "pHash": 1, "dHash": 2, "verdict": "same"},
    {"id": 2, "bucket": "0–2", "keeperPath": "/a", "memberPath": "/c", "pHash": 2, "dHash": 0, "verdict": None},
    {"id": 3, "bucket": "0–2", "keeperPath": "/é", "memberPath": "/d", "pHash": 3, "dHash": 0, "verdict": "different"},
    {"id": 4, "bucket": "0–2", "keeperPath": "/a", "memberPath": "/e", "pHash": 0, "dHash": 0, "verdict": "perhaps"},
    {"id": 5, "bucket": "9–9", "keeperPath": "/a", "memberPath": "/f", "pHash": 9, "dHash": 0, "verdict": "same"},
]
BUCKETS = [{"name": "0–2", "min": 0, "max": 2, "population": 161}, {"name": "3–4", "min": 3, "max": 4, "population": 189}]


def test_label_file(spark, tmp_path):
    path = str(tmp_path / "labels.json")
    labels.write(path, BUCKETS, PAIRS)
    buckets, pairs = labels.read(spark, path)
    assert [(r.id, r.keeper, r.p, r.d, r.verdict) for r in pairs.orderBy("id").collect()] == [(x["id"], x["keeperPath"], x["pHash"], x["dHash"], x["verdict"]) for x in PAIRS]
    assert {(r.id, r.problem) for r in labels.violations(buckets, pairs).collect()} == {(3, "distance"), (4, "verdict"), (5, "bucket")}
    whole = json.loads((tmp_path / "labels.json").read_text())
    (tmp_path / "old.json").write_text(json.dumps(whole | {"version": 7, "pairs": PAIRS[:2]}))
    assert {(r.id, r.problem) for r in labels.violations(*labels.read(spark, str(tmp_path / "old.json"))).collect()} == {(None, "version")}


def test_reports(spark):
    per = evaluate.bucket_precision(spark.createDataFrame([("0–2", "same")] * 18 + [("0–2", "different")] * 12, "bucket string, verdict string"), spark.createDataFrame([("0–2", 2, 161), ("3–4", 4, 189)], "bucket string, hi int, population long"))
    overall = evaluate.overall_precision(per, [2, 4])
    text = labels.precision_report(per, overall)
    assert "| 0–2 | 161 | 18 | 30 | 60.0% (42.3%–75.4%) |" in text and "| 3–4 | 189 | 0 | 0 | — |" in text
    effect = evaluate.rule_effect(spark.createDataFrame([("/a", "/b", "0–2", "same")], "keeper string, member string, bucket string, verdict string"), spark.createDataFrame([("/a", None)], "path string, date_taken timestamp_ntz"), spark.createDataFrame([("0–2", 161)], "bucket string, population long"))
    text = labels.rule_report(effect, overall, overall)
    assert "| 0–2 | 1 | 0 | 0 | 0 | 161 | 161 |" in text and "| All | 1 |" in text and "| 4 | — | — |" in text


def test_output_stays_outside(tmp_path):
    (tmp_path / "photos").mkdir()
    for bad in ("photos", "photos/x", "photos/../photos/y/z"):
        with pytest.raises(ValueError):
            labels.prepare_output(str(tmp_path / "photos"), str(tmp_path / bad))
    assert labels.prepare_output(str(tmp_path / "photos"), str(tmp_path / "photos2/out")).endswith("photos2/out") and (tmp_path / "photos2/out").is_dir()


def files(spark, rows):
    base = {f.name: None for f in CATALOG.fields}
    return spark.createDataFrame([tuple((base | {"status": "Ok", "frame_count": 1} | r).values()) for r in rows], CATALOG)


def test_drawn_and_times(spark):
    rows = [{"path": f"/p/{i}{e}", "status": s} for i in range(40) for e, s in ((".JPG", "Ok"), (".gif", "Ok"), (".png", "DecodeFailed"), (".tif", "OnlineOnlySkipped"))]
    cat = files(spark, rows)
    got = evaluate.drawn(cat, 5, 10).collect()
    assert [r.nth for r in got] == list(range(1, 11)) and all(r.path.endswith(".JPG") for r in got)
    assert evaluate.originals(cat, 5).count() == 80
    assert [r.path for r in evaluate.drawn(cat.repartition(7), 5, 10).collect()] == [r.path for r in got]
    pairs = spark.createDataFrame([("/p/0.JPG", "/p/1.png"), ("/p/0.JPG", "/nowhere")], "keeper string, member string")
    assert {(r.path, r.readable) for r in evaluate.times_read(pairs, cat).collect()} == {("/p/0.JPG", True), ("/p/1.png", False), ("/nowhere", False)}


def naive(sha, p, d, taken, limits):
    out = [None] * len(sha)
    for i in range(len(sha)):
        if out[i] is None:
            for j in range(i, len(sha)):
                near = limits and None not in (p[i], p[j], d[i], d[j]) and ((p[i] ^ p[j]) % 2**64).bit_count() <= limits.p and ((d[i] ^ d[j]) % 2**64).bit_count() <= limits.d and not (limits.same_time and taken[i] is not None and taken[j] is not None and taken[i] != taken[j])
                if out[j] is None and (i == j or sha[i] is not None and sha[i] == sha[j] or near):
                    out[j] = i
    return out


@pytest.mark.parametrize("limits", [None, SAME_PHOTO, Limits(14, 14)])
def test_homes(limits):
    r = random.Random(3)
    for _ in range(20):
        n = r.randrange(1, 60)
        p = [r.choice([None, r.getrandbits(63) & 0xFF, -1 - (r.getrandbits(63) & 0xF)]) for _ in range(n)]
        args = [r.choice([None, "x", "y", str(i)]) for i in range(n)], p, [r.choice([None, 0, 7, -1]) for _ in range(n)], [r.choice([None, 5, 6]) for _ in range(n)]
        assert grouping.homes(*args, limits).tolist() == naive(*args, limits)


def test_a_long_chain(spark):
    r = random.Random(1)
    h, chain = r.getrandbits(63), []
    for i in range(1000):
        chain.append(h - 2**63 if i % 2 else h)
        h ^= sum(1 << b for b in r.sample(range(62), 4))
    cat = files(spark, [{"path": f"/c/{i:05}", "sha256": f"s{i}", "p_hash": x, "d_hash": 0, "width": 10, "height": 10, "size_bytes": 5} for i, x in enumerate(chain)])
    sizes = {}
    for x in grouping.group(cat, Limits(5, 5)).select("group_id", "path").collect():
        sizes.setdefault(x.group_id, []).append(x.path)
    want = {}
    for i, k in enumerate(naive([None] * 1000, chain, [0] * 1000, [None] * 1000, Limits(5, 5))):
        want.setdefault(f"/c/{k:05}", []).append(f"/c/{i:05}")
    assert {k: sorted(v) for k, v in sizes.items()} == {k: v for k, v in want.items() if len(v) > 1}


def test_rounds_split_as_one_pass_does(spark):
    rows = grouping.rank_keys(grouping.with_look(grouping.sets(grouping.candidates(V.vec_files(spark, "/root/testdata/sf0.001").limit(240)), Limits(14, 14))), "component_id")
    one, many = (grouping.split(rows, Limits(14, 14), most=m).select("path", F.col("keeper_unit")) for m in (grouping.ONE_PASS, 1))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
