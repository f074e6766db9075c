from datetime import datetime

from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import cleanup, evaluate, ranking, results
from sievework.schema import CATALOG


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_after_move_goes_by_path_whatever_the_case(spark):
    failures = spark.createDataFrame([("/A", "InUse"), ("/b", "NotFound"), ("/d", None)], "path string, reason string")
    left = cleanup.after_move(paths(spark, "/a", "/B", "/c", "/D", "/e"), paths(spark, "/C"), failures)
    assert {r.path for r in left.collect()} == {"/a", "/e"}
    assert cleanup.after_move(paths(spark), paths(spark), failures).count() == 0


def test_after_undo(spark):
    batch = paths(spark, "/back", "/retry", "/lost", "/there", "/gone")
    restored = spark.createDataFrame([("/BACK", "/back (2)")], "path string, restored_path string")
    failures = spark.createDataFrame([("/retry", "IoError"), ("/lost", "NotFound")], "path string, reason string")
    got = {r.path: (r.outcome, r.now_path) for r in cleanup.after_undo(batch, restored, failures, paths(spark, "/There", "/lost")).collect()}
    assert got == {"/back": ("Restored", "/back (2)"), "/retry": ("Retry", None), "/lost": ("Lost", None), "/there": ("Back", "/there"), "/gone": ("Gone", None)}


def test_compare_measures_keys_in_the_context(spark):
    row = lambda p, size, w: (p, size, datetime(2024, 1, 1), "Ok", None, None, None, w, 100, None, None, None, 1, None)
    files = spark.createDataFrame([row("/a.jpg", 990, 1000), row("/b.jpg", 100, 995), row("/c.jpg", 10, 2000)], CATALOG)
    asks = spark.createDataFrame([("x", "/a.jpg", "/b.jpg"), ("same", "/a.jpg", "/a.jpg"), ("away", "/a.jpg", "/z")], "ask string, a string, b string")
    alone = {r.ask: (r.winner, r.decided_by, r.reason) for r in ranking.compare_in(asks, files).collect()}
    assert alone["x"][:2] == (-1, "FileSize") and alone["same"] == (0, None, "Identical copies") and "away" not in alone
    context = spark.createDataFrame([("x", "/c.jpg"), ("x", "/a.jpg")], "ask string, path string")
    assert {r.ask: r.decided_by for r in ranking.compare_in(asks, files, context).collect()}["x"] == "Resolution"


def test_orders_and_counts(spark):
    assert [r.path for r in results.by_path(paths(spark, "/b", "/A", "/a", "/C")).collect()] == ["/A", "/a", "/b", "/C"]
    pairs = spark.range(103)
    assert evaluate.beyond(pairs).first().asDict() == {"more": 3, "line": "… and 3 more"}
    assert evaluate.beyond(pairs.limit(0)).first().asDict() == {"more": 0, "line": None}
    dates = spark.range(1).select(text.dates_text(F.expr("timestamp_ntz'2024-01-01 23:30:00'"), F.expr("timestamp_ntz'2024-01-02 00:10:00'"), "Europe/Berlin").alias("t"))
    assert dates.first().t == "2024-01-02 00:30:00 vs 2024-01-02 01:10:00"


def test_keepers_beside_the_others(spark):
    from pyspark.sql.types import IntegerType, StructField, StructType

    row = lambda p, size, w, s, make=None: (p, size, datetime(2024, 1, size % 9 + 1), "Ok", str(size % 3), None, None, w, 100, make, None, None, 1, None, s)
    names = ("a.jpg", "b.jpeg", "c copy.jpg", "d.png", "e.png", "f.tif")
    rows = [row(f"/{s}/{n}", (s * 37 + i * 11) % 50, (0, 990, 995, 1000, None)[(s + i) % 5], s, "Canon" if (s * i) % 4 == 1 else None) for s in range(40) for i, n in enumerate(names[: s % 7])]
    kinds = StructType([*CATALOG, StructField("s", IntegerType())])
    files = spark.createDataFrame(rows, kinds)
    r = ranking.ranked(files, "s")
    asks = r.filter("rank > 1").select("s", F.col("path").alias("b")).join(r.filter("rank = 1").select("s", F.col("path").alias("a")), "s").selectExpr("b AS ask", "a", "b")
    want = {(x.a, x.b, x.winner, x.decided_by, x.reason) for x in ranking.compare_in(asks, files.drop("s")).collect()}
    got = [(x.a_path, x.b_path, x.winner, x.decided_by, x.reason) for x in ranking.beside_keeper(files, "s").collect()]
    assert len(got) == len(rows) - len({x[-1] for x in rows}) and set(got) == want
    # a path twice, and files without a set or a path
    odd = [row("/a.jpg", 9, 1000, 1), row("/a.jpg", 8, 100, 1), row("/b.jpg", 1, 10, 1), row("/n", 1, 1, None), row("/m", 1, 1, None), row(None, 0, 1, 1)]
    found = [(x.a_path, x.b_path, x.winner) for x in ranking.beside_keeper(spark.createDataFrame(odd, kinds), "s").collect()]
    assert sorted(found) == [("/a.jpg", "/a.jpg", -1)] * 4 + [("/a.jpg", "/a.jpg", 0)] * 8 + [("/a.jpg", "/a.jpg", 1)] * 4 + [("/a.jpg", "/b.jpg", -1)] * 2


def test_compare_alone_shuffles_once(spark):
    import sievework.queries as q

    plan = q.compare_alone(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
