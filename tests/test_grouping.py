import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievework.operators import cleanup, kinds, match, ranking, results
from sievework.operators.components import connected_components
from sievework.operators.grouping import group, groups
from sievework.schema import CATALOG, LEVELS, Limits

T0 = datetime(2024, 6, 1, 12)
bits = lambda n: (1 << n) - 1


def row(name, p=0, d=0, sha=None, w=1000, h=750, size=100_000, at=T0, model=None, taken=None, frames=1, status="Ok", make=None):
    return (f"/photos/{name}", size, at, status, sha if sha != "" else None, p, d, w, h, make, model, taken, frames, None) if sha is not None else (f"/photos/{name}", size, at, status, f"SHA-{name}", p, d, w, h, make, model, taken, frames, None)


def catalog(spark, rows):
    return spark.createDataFrame(rows, CATALOG)


def grouped(spark, rows, level="SamePhoto", nested=None):
    out = {}
    for r in sorted(group(catalog(spark, rows), level, nested).collect(), key=lambda r: (r.group_id, r.rank)):
        out.setdefault(r.group_id.removeprefix("/photos/"), []).append(r.path.removeprefix("/photos/"))
    return sorted(out.values())


def test_limits(spark):
    two = lambda p, d: grouped(spark, [row("a"), row("b", bits(p), bits(d))])
    assert two(4, 5) and two(3, 3)
    assert not two(6, 0) and not two(0, 6) and not two(20, 20)


def test_chain_splits(spark):
    chain = [row("a", w=2000, h=1500), row("b", bits(3), bits(3)), row("c", bits(6), bits(6)), row("d", bits(9), bits(9))]
    assert grouped(spark, chain) == [["a", "b"], ["c", "d"]]
    assert grouped(spark, chain[:3]) == [["a", "b"]]
    assert grouped(spark, chain, nested=0) == [["a", "b"], ["c", "d"]]


def test_burst_of_ten(spark):
    rows = [row(f"{k:02}", bits(2 * k), bits(2 * k)) for k in range(10)]
    assert grouped(spark, rows) == [["00", "01", "02"], ["03", "04", "05"], ["06", "07", "08"]]


def test_twins_stay_together(spark):
    rows = [row("a"), row("b", bits(3), bits(3), sha="B"), row("b copy", None, None, sha="B", status="DecodeFailed"), row("c1", bits(6), bits(6), sha="C"), row("c2", bits(6), bits(6), sha="C")]
    assert grouped(spark, rows) == [["a", "b", "b copy"], ["c1", "c2"]]
    k = {r.path: (r.kind, r.p_distance) for r in group(catalog(spark, rows)).collect()}
    assert k["/photos/b copy"] == ("SamePhoto", 3) and k["/photos/c2"][0] == "Identical"


def test_capture_time(spark):
    a, b = row("a", taken=T0), row("b", bits(2), 0, taken=T0 + timedelta(seconds=1))
    assert grouped(spark, [a, b]) == [] and grouped(spark, [a, b], "Similar") == [["a", "b"]]
    assert grouped(spark, [a, row("c", bits(2), 0)]) == [["a", "c"]]
    assert grouped(spark, [a, b], Limits(4, 5)) == [["a", "b"]]
    with pytest.raises(ValueError):
        Limits(-1, 2)


def test_animated_by_bytes_only(spark):
    assert grouped(spark, [row("a"), row("g.gif", frames=12)]) == []
    assert grouped(spark, [row("g.gif", frames=12, sha="G"), row("h.gif", frames=12, sha="G")]) == [["g.gif", "h.gif"]]


def test_exact_and_no_data(spark):
    rows = [row("a", sha="S"), row("b", bits(30), sha="S"), row("n", None, None, sha=""), row("m", None, None, sha="")]
    assert grouped(spark, rows, "Exact") == [["a", "b"]]
    assert grouped(spark, [], "SamePhoto") == []


def brute(rows, limits):
    """Union of links, then the best file left over and over."""
    import re

    fmt = lambda p: re.search(r"(\.[^.]+)?$", p.rsplit("/", 1)[1])[0].lower()
    look = lambda r: None if r[12] > 1 or r[5] is None else (r[5], r[6])
    near = lambda f, g, a, b: bool(limits and f and g and bin((f[0] ^ g[0]) & (2**64 - 1)).count("1") <= limits.p and bin((f[1] ^ g[1]) & (2**64 - 1)).count("1") <= limits.d and not (limits.same_time and a[11] and b[11] and a[11] != b[11]))
    same = lambda a, b: a[4] is not None and a[4] == b[4]
    part = {r[0]: r[0] for r in rows}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if same(a, b) or near(look(a), look(b), a, b):
                part[find(a[0])] = find(b[0])
    out = []
    for root in {find(r[0]) for r in rows}:
        s = [r for r in rows if find(r[0]) == root]
        px = lambda r: (r[7] or 0) * (r[8] or 0)
        top = max(map(px, s))

        def key(r):
            most = max(x[1] for x in s if fmt(x[0]) == fmt(r[0]))
            share = r[1] / most if most else 1
            return (-(top if px(r) * 100 >= top * 99 else px(r)), -(r[9] is not None or r[10] is not None or r[11] is not None), " copy" in r[0], -(1 if share >= 0.99 else share), r[2].replace(microsecond=0), r[0])

        rest = sorted(s, key=key)
        fp = lambda r: look(r) or next((look(x) for x in s if same(x, r) and look(x)), None)
        while len(rest) > 1:
            k = rest[0]
            took = [r for r in rest if r is k or same(r, k) or near(fp(r), fp(k), r, k)]
            rest = [r for r in rest if r not in took]
            if len(took) > 1:
                out.append([r[0].removeprefix("/photos/") for r in took])
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(60):
        base = r.choice([0, bits(40), bits(20)])
        p = base ^ sum(1 << b for b in r.sample(range(12), r.randrange(5)))
        rows.append(row(f"f{i:02}{r.choice(['', ' copy'])}.{r.choice(['jpg', 'png'])}", p, base ^ bits(r.randrange(6)), w=r.choice([1000, 1001, 2000]), size=r.randrange(90_000, 110_000), at=T0 + timedelta(milliseconds=r.randrange(3000)), model=r.choice([None, "X"])))
    for level in ("SamePhoto", "Similar"):
        want = brute(rows, LEVELS[level])
        assert grouped(spark, rows, level) == want
        r.shuffle(rows)
        assert grouped(spark, rows, level, nested=0) == want


def test_blocks_find_what_all_pairs_find(spark):
    r = random.Random(4)
    base = [r.getrandbits(63) for _ in range(20)]
    rows = [(f"k{i:03}", (h := base[i % 20]) ^ sum(1 << b for b in r.sample(range(63), r.randrange(9))), h >> 3 ^ sum(1 << b for b in r.sample(range(60), r.randrange(9))), None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, look_p long, look_d long, date_taken timestamp_ntz")
    for limits in (Limits(4, 5), Limits(14, 14), Limits(0, 0)):
        a, b = (sorted(map(tuple, match.similar_pairs(df, "k", limits, nested=n).collect())) for n in (None, 0))
        assert a == b


def test_reasons(spark):
    def why(*rows):
        return groups(group(catalog(spark, list(rows)))).first().reason

    assert why(row("small.jpg", w=800, h=600, model="X"), row("big (1).jpg", w=4000, h=3000)) == "Highest resolution (4000×3000 vs 800×600)"
    assert why(row("a.jpg", w=4000, h=2990), row("b.jpg", w=4000, h=3000, model="Canon EOS R5")) == "Has camera data (Canon EOS R5)"
    assert why(row("a.jpg"), row("a copy.jpg", size=500_000)) == 'Original file name ("a copy.jpg" looks like a copy)'
    assert why(row("a.jpg", at=T0 + timedelta(milliseconds=900)), row("b.jpg", at=T0 + timedelta(milliseconds=100))) == "Equally good copies; first by path"
    assert why(row("a.jpg", sha="S"), row("b.jpg", sha="S")) == "Identical copies"
    assert why(row("a.jpg", at=T0), row("b.jpg", at=T0 + timedelta(days=1))).startswith("Older copy (modified 2024-06-01 vs 2024-06-02")


def test_kinds(spark):
    def kind(*rows):
        return kinds.group_kinds(group(catalog(spark, list(rows)), "Similar")).first().group_kind

    assert kind(row("a", sha="S"), row("b", sha="S")) == "Copies"
    assert kind(row("Screen Shot 1.png"), row("x.png")) == "Screenshots"
    assert kind(row("Screen Shot 1.png", model="X"), row("x.png")) == "LookAlikes"
    assert kind(row("a", taken=T0), row("b", taken=T0 + timedelta(seconds=10))) == "Burst"
    assert kind(row("a", taken=T0), row("b", taken=T0 + timedelta(seconds=11))) == "LookAlikes"
    assert kind(row("20160604_162017.jpg"), row("20160604_162017_001.jpg")) == "Burst"
    assert kind(row("a_0012.jpg"), row("b.jpg")) == "LookAlikes"


def test_remaining(spark):
    m = group(catalog(spark, [row("a"), row("b", bits(2)), row("c", bits(1)), row("x", bits(50), bits(50)), row("y", bits(51), bits(50))]))
    path = lambda *names: spark.createDataFrame([(f"/photos/{n}",) for n in names], "path string")
    none = spark.createDataFrame([], "path string, new_path string")
    left = {r.path: (r.rank, r.kind, r.p_distance, r.keeper_moved) for r in results.remaining(m, groups(m), path("a", "x"), none).collect()}
    assert left["/photos/b"] == (1, "Keeper", None, True) and left["/photos/c"][0] == 2 and len(left) == 2


def test_validation(spark):
    m = group(catalog(spark, [row("a", sha="S"), row("b", sha="S"), row("c", sha="S"), row("x", bits(50), bits(50), sha="T"), row("y", bits(50), bits(50), sha="T")]))
    roots = spark.createDataFrame([("/photos",), ("/photos/deep",)], "root string")
    sel = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    bad = {(r.problem, r.path) for r in cleanup.problems(m, sel("/photos/x", "/photos/y", "/photos/q", "/photos/_Sievework removed/z"), roots).collect()}
    assert bad == {("RemovesEveryCopy", "/photos/x"), ("NotInAnyGroup", "/photos/q"), ("InsideReviewFolder", "/photos/_Sievework removed/z")}
    plan = {r.path: (r.action, r.relative_path) for r in cleanup.plan(m, sel("/PHOTOS/b", "/photos/c"), roots).collect()}
    assert plan == {"/photos/a": ("keep", None), "/photos/b": ("remove", "b"), "/photos/c": ("remove", "c")}
    with pytest.raises(ValueError):
        cleanup.plan(m, sel("/photos/x", "/photos/y"), roots)


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(5, 5), (1, 2), (2, 1)], [(random.Random(3 + i).randrange(60), random.Random(99 + i).randrange(60)) for i in range(50)], []])
def test_components(spark, edges):
    part = {}

    def find(x):
        part.setdefault(x, x)
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        part[max(a, b)] = min(a, b)
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == {x: find(x) for x in part}


def test_compare_agrees_with_rank(spark):
    rows = [row("a.jpg"), row("b.jpg", model="X"), row("c copy.jpg", size=1), row("d.png", w=2000), row("e.jpg", at=T0 - timedelta(days=2))]
    r = ranking.ranked(catalog(spark, rows).withColumn("s", F.lit(1)), "s")
    a, b = (r.select(*[F.col(c).alias(f"{s}_{c}") for c in r.columns]) for s in "ab")
    for x in ranking.compare(a.crossJoin(b)).collect():
        assert x.winner == (x.a_rank > x.b_rank) - (x.a_rank < x.b_rank)
