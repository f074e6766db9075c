"""The engine's queries over the catalogs of plans.views, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import oracles as O
from sievework.functions import hashing, text
from sievework.operators import cache, cleanup, evaluate, kinds, match, ranking, results
from sievework.operators.components import connected_components
from sievework.operators.grouping import group, groups, links
from sievework.plans import views as V
from sievework.schema import LEVELS, REVIEW_FOLDER
from sievework.sources import labels

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _vec(spark: SparkSession, d: str, level: str = "SamePhoto") -> DataFrame:
    return group(V.vec_files(spark, d), level)


# --- exact copies -------------------------------------------------------------------------------

@query("exact_groups", f"{O.doc_groups()} SELECT group_id, path, rank::INTEGER AS rank, kind FROM gm")
def exact_groups(spark, d):
    return group(V.doc_files(spark, d), "Exact").select("group_id", "path", "rank", "kind")


@query("exact_group_summary", f"{O.doc_groups()}, t AS (SELECT group_id, count(*) AS n, sum(CASE WHEN rank > 1 THEN size_bytes ELSE 0 END) AS b FROM gm GROUP BY 1) SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS extra_copies, coalesce(sum(b), 0)::BIGINT AS extra_bytes FROM t")
def exact_group_summary(spark, d):
    return results.overall(group(V.doc_files(spark, d), "Exact"))


# --- hashes and distances -----------------------------------------------------------------------

@query("phash_bits", f"WITH {O.VEC} SELECT vec_id, printf('%016x', p0) AS p_hex FROM h1")
def phash_bits(spark, d):
    return V.vec_hashes(spark, d).select("vec_id", hashing.hex64(F.col("p0")).alias("p_hex"))


@query("dhash_bits", f"WITH {O.VEC} SELECT vec_id, printf('%016x', d0) AS d_hex FROM h1")
def dhash_bits(spark, d):
    return V.vec_hashes(spark, d).select("vec_id", hashing.hex64(F.col("d0")).alias("d_hex"))


def _pairs(spark, d, level: str, nested: int | None = None) -> DataFrame:
    return match.similar_pairs(match.representatives(V.vec_files(spark, d)), "path", LEVELS[level], nested=nested).select("a", "b", F.col("p").cast("int").alias("p"), F.col("d").cast("int").alias("d"))


for _level, (_p, _d, _t) in {"same": (4, 5, True), "similar": (14, 14, False)}.items():
    _name = {"same": "SamePhoto", "similar": "Similar"}[_level]
    _sql = f"WITH {O.VEC}, {O.pairs('vec_files', _p, _d, _t)} SELECT a, b, p::INTEGER AS p, d::INTEGER AS d FROM pr"
    query(f"hamming_pairs_{_level}", _sql)(lambda s, d, n=_name: _pairs(s, d, n))
    query(f"hamming_pairs_{_level}_blocks", _sql)(lambda s, d, n=_name: _pairs(s, d, n, nested=0))
    query(f"components_{_level}", f"WITH RECURSIVE {O.VEC}, {O.pairs('vec_files', _p, _d, _t)}, {O.components('vec_files', True)} SELECT path, component_id FROM comp")(
        lambda s, d, n=_name: connected_components(links(V.vec_files(s, d), LEVELS[n])).select(F.col("node").alias("path"), F.col("component").alias("component_id"))
    )
    query(f"keeper_split_{_level}", f"{O.vec_groups(_name)} SELECT group_id, path, rank::INTEGER AS rank, kind, p_distance::INTEGER AS p_distance, d_distance::INTEGER AS d_distance FROM gm")(
        lambda s, d, n=_name: _vec(s, d, n).select("group_id", "path", "rank", "kind", F.col("p_distance").cast("int").alias("p_distance"), F.col("d_distance").cast("int").alias("d_distance"))
    )


@query("keeper_split_custom", (O.vec_groups("SamePhoto").replace("<= 4", "<= 2").replace("<= 5", "<= 2").replace("AND NOT coalesce(a.date_taken <> b.date_taken, false)", "").replace(" AND NOT coalesce(x.t <> rem[1].t, false)", "") + " SELECT group_id, path, rank::INTEGER AS rank FROM gm"))
def keeper_split_custom(spark, d):
    from sievework.schema import Limits

    return group(V.vec_files(spark, d), Limits(2, 2)).select("group_id", "path", "rank")


@query("time_rule_pairs", f"WITH {O.VEC}, {O.pairs('vec_files', 4, 5, False)} SELECT a, b, coalesce(x.date_taken <> y.date_taken, false) AS dropped FROM pr JOIN vec_files x ON x.path = a JOIN vec_files y ON y.path = b")
def time_rule_pairs(spark, d):
    from sievework.schema import Limits

    v = V.vec_files(spark, d)
    t = v.select("path", "date_taken")
    found = match.similar_pairs(match.representatives(v), "path", Limits(4, 5)).select("a", "b")
    return found.join(t.select(F.col("path").alias("a"), F.col("date_taken").alias("ta")), "a").join(t.select(F.col("path").alias("b"), F.col("date_taken").alias("tb")), "b").select("a", "b", (~match.same_time(F.col("ta"), F.col("tb"))).alias("dropped"))


# --- ranking ------------------------------------------------------------------------------------

@query("rank_keys", f"WITH {O.ITEM}, {O.ranking('item_files', 'set_id')} SELECT path, tier::BIGINT AS tier, has_camera, is_copy, round(size_key, 6) AS size_key, fmt FROM rk")
def rank_keys(spark, d):
    return ranking.rank_keys(V.item_files(spark, d), "set_id").select("path", "tier", "has_camera", "is_copy", F.round("size_key", 6).alias("size_key"), "fmt")


@query("keeper_rank", f"WITH {O.ITEM}, {O.ranking('item_files', 'set_id')} SELECT set_id, path, rnk::INTEGER AS rank FROM rk")
def keeper_rank(spark, d):
    return ranking.ranked(V.item_files(spark, d), "set_id").select("set_id", "path", "rank")


@query("keeper_reason", f"WITH {O.ITEM}, {O.ranking('item_files', 'set_id')}, k AS (SELECT * FROM rk WHERE rnk = 1), r AS (SELECT * FROM (SELECT rk.*, row_number() OVER (PARTITION BY rk.set_id ORDER BY rk.rnk) AS o FROM rk JOIN k ON k.set_id = rk.set_id WHERE rk.rnk > 1 AND NOT coalesce(rk.sha256 = k.sha256, false)) WHERE o = 1) SELECT k.set_id, k.path AS keeper, r.path AS rival, CASE WHEN r.path IS NULL THEN 'Identical copies' ELSE {O.reason('k', 'r')} END AS reason FROM k LEFT JOIN r ON r.set_id = k.set_id")
def keeper_reason(spark, d):
    return ranking.keeper_reasons(ranking.ranked(V.item_files(spark, d), "set_id"), "set_id")


_SIGN = {"Resolution": "sign(b.tier - a.tier)", "CameraData": "sign(b.has_camera - a.has_camera)", "OriginalName": "sign(a.is_copy - b.is_copy)", "FileSize": "sign(b.size_key - a.size_key)", "OlderCopy": "CASE WHEN a.modified < b.modified THEN -1 WHEN a.modified > b.modified THEN 1 ELSE 0 END", "Path": "CASE WHEN a.path < b.path THEN -1 WHEN a.path > b.path THEN 1 ELSE 0 END"}


@query("pair_compare", f"WITH {O.ITEM}, {O.ranking('item_files', 'set_id')}, p AS (SELECT a.path AS a_path, b.path AS b_path, " + ", ".join(f"({v})::INTEGER AS {k}" for k, v in _SIGN.items()) + f", coalesce(a.sha256 = b.sha256, false) AS same, {O.reason('a', 'b')} AS ra, {O.reason('b', 'a')} AS rb FROM rk a JOIN rk b ON a.set_id = b.set_id AND b.rnk = 3 - a.rnk WHERE a.rnk IN (1, 2)) SELECT a_path, b_path, Resolution AS by_resolution, OlderCopy AS by_older, CASE WHEN Resolution <> 0 THEN Resolution WHEN CameraData <> 0 THEN CameraData WHEN OriginalName <> 0 THEN OriginalName WHEN FileSize <> 0 THEN FileSize WHEN OlderCopy <> 0 THEN OlderCopy ELSE Path END AS winner, CASE WHEN Resolution <> 0 THEN 'Resolution' WHEN CameraData <> 0 THEN 'CameraData' WHEN OriginalName <> 0 THEN 'OriginalName' WHEN FileSize <> 0 THEN 'FileSize' WHEN OlderCopy <> 0 THEN 'OlderCopy' WHEN Path <> 0 THEN 'Path' END AS decided_by, CASE WHEN same THEN 'Identical copies' WHEN coalesce(nullif(Resolution, 0), nullif(CameraData, 0), nullif(OriginalName, 0), nullif(FileSize, 0), nullif(OlderCopy, 0), Path) < 0 THEN ra ELSE rb END AS reason FROM p")
def pair_compare(spark, d):
    r = ranking.ranked(V.item_files(spark, d), "set_id").filter("rank <= 2")
    a, b = (r.select(*[F.col(c).alias(f"{s}_{c}") for c in r.columns]) for s in "ab")
    got = ranking.compare(a.join(b, F.expr("a_set_id = b_set_id AND b_rank = 3 - a_rank")))
    return got.select("a_path", "b_path", F.col("by_criterion")["Resolution"].alias("by_resolution"), F.col("by_criterion")["OlderCopy"].alias("by_older"), "winner", "decided_by", "reason")


# --- groups and pages ---------------------------------------------------------------------------

@query("group_reasons", f"{O.vec_groups('SamePhoto')}, k AS (SELECT * FROM gm WHERE rank = 1), r AS (SELECT * FROM (SELECT gm.*, row_number() OVER (PARTITION BY gm.group_id ORDER BY gm.rank) AS o FROM gm JOIN k ON k.group_id = gm.group_id WHERE gm.rank > 1 AND NOT coalesce(gm.sha256 = k.sha256, false)) WHERE o = 1) SELECT k.group_id, k.path AS keeper, r.path AS rival, CASE WHEN r.path IS NULL THEN 'Identical copies' ELSE {O.reason('k', 'r')} END AS reason FROM k LEFT JOIN r ON r.group_id = k.group_id")
def group_reasons(spark, d):
    return groups(_vec(spark, d))


@query("group_kinds", f"{O.vec_groups('Similar')} {O.KINDS} SELECT group_id, group_kind FROM gk")
def group_kinds(spark, d):
    return kinds.group_kinds(_vec(spark, d, "Similar")).select("group_id", "group_kind")


@query("group_kind_counts", f"{O.vec_groups('SamePhoto')} {O.KINDS} SELECT group_kind, count(*) AS n FROM gk GROUP BY 1")
def group_kind_counts(spark, d):
    return kinds.group_kinds(_vec(spark, d)).groupBy("group_kind").agg(F.count("*").alias("n"))


@query("filter_counts", f"{O.vec_groups('SamePhoto')} {O.KINDS}, n(filter, kind) AS (VALUES ('All', NULL), ('Copies', 'Copies'), ('Bursts', 'Burst'), ('Screenshots', 'Screenshots'), ('Look-alikes', 'LookAlikes')), c AS (SELECT filter, (SELECT count(*) FROM gk WHERE kind IS NULL OR group_kind = kind) AS n FROM n) SELECT filter, n, filter || ' (' || n || ')' AS label FROM c")
def filter_counts(spark, d):
    return results.filter_counts(kinds.group_kinds(_vec(spark, d)))


@query("burst_sets", "SELECT user_id, date_trunc('hour', ts) AS hour, count(DISTINCT date_trunc('second', ts)) AS n_times, count(DISTINCT date_trunc('second', ts)) >= 2 AND max(date_trunc('second', ts)) - min(date_trunc('second', ts)) <= INTERVAL 10 SECOND AS is_burst FROM events GROUP BY ALL")
def burst_sets(spark, d):
    t = F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    h = F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:00:00"))
    return V.table(spark, d, "events").select("user_id", h.alias("hour"), t.alias("t")).groupBy("user_id", "hour").agg(F.countDistinct("t").alias("n_times"), ((F.countDistinct("t") >= 2) & (F.max("t") <= F.min("t") + F.expr("INTERVAL '10' SECOND"))).alias("is_burst"))


@query("preselected", f"{O.vec_groups('Similar')} SELECT path, kind = 'Identical' AS suggested FROM gm")
def preselected(spark, d):
    return results.preselected(_vec(spark, d, "Similar")).select("path", "suggested")


@query("keep_one", f"{O.vec_groups('SamePhoto')}, m AS (SELECT *, size_bytes % 3 > 0 AS w FROM gm) SELECT path, w AND NOT (bool_and(w) OVER (PARTITION BY group_id) AND rank = 1) AS selected FROM m")
def keep_one(spark, d):
    return results.toggled(_vec(spark, d).withColumn("selected", F.expr("size_bytes % 3 > 0"))).select("path", "selected")


@query("freeable_bytes", f"{O.vec_groups('SamePhoto')} SELECT group_id, count(*) AS n_members, sum(CASE WHEN rank > 1 THEN size_bytes ELSE 0 END)::BIGINT AS freeable_bytes, bool_or(kind IN ('SamePhoto', 'Similar')) AS has_look_alikes FROM gm GROUP BY 1")
def freeable_bytes(spark, d):
    return results.group_totals(_vec(spark, d))


@query("results_page_order", f"{O.vec_groups('SamePhoto')}, t AS (SELECT group_id, sum(CASE WHEN rank > 1 THEN size_bytes ELSE 0 END) AS b FROM gm GROUP BY 1) SELECT group_id, row_number() OVER (ORDER BY b DESC, upper(group_id), group_id)::INTEGER AS position FROM t")
def results_page_order(spark, d):
    return results.page_order(_vec(spark, d)).select("group_id", "position")


@query("selection_totals", f"{O.vec_groups('SamePhoto')} {O.KINDS} SELECT count(*) FILTER (kind = 'Identical') AS selected, coalesce(sum(size_bytes) FILTER (kind = 'Identical'), 0)::BIGINT AS selected_bytes, count(*) FILTER (kind = 'Identical' AND group_kind <> 'Burst') AS hidden_selected FROM gm JOIN gk ON gk.group_id = gm.group_id")
def selection_totals(spark, d):
    m = _vec(spark, d)
    return results.selection_totals(results.preselected(m).withColumnRenamed("suggested", "selected"), kinds.group_kinds(m), "Burst")


@query("photo_text", f"{O.vec_groups('SamePhoto')} SELECT path, {O.base_name('path')} AS file_name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, width || '×' || height AS resolution, {O.units('size_bytes', 1)} AS size, CASE WHEN date_taken IS NOT NULL THEN 'Taken ' || strftime(date_taken, '%Y-%m-%d %H:%M') ELSE 'Modified ' || strftime(last_write, '%Y-%m-%d %H:%M') END AS date, CASE kind WHEN 'Keeper' THEN '★ Suggested keeper' WHEN 'Identical' THEN 'Identical copy' WHEN 'SamePhoto' THEN 'Same photo' ELSE 'Similar shot' END AS match FROM gm")
def photo_text(spark, d):
    return results.photo_text(_vec(spark, d)).select("path", "file_name", "folder", "resolution", "size", "date", "match")


@query("remaining_groups", f"""{O.vec_groups('Similar')}, k AS (SELECT * FROM gm WHERE rank = 1), l AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY rank) AS r2, count(*) OVER (PARTITION BY group_id) AS n FROM gm WHERE size_bytes % 4 > 0)
SELECT l.group_id, CASE WHEN l.size_bytes % 7 = 0 THEN l.path || '.back' ELSE l.path END AS path, r2::INTEGER AS rank, CASE WHEN k.size_bytes % 4 = 0 AND r2 = 1 THEN 'Keeper' ELSE l.kind END AS kind, CASE WHEN NOT (k.size_bytes % 4 = 0 AND r2 = 1) THEN l.p_distance END::INTEGER AS p_distance, k.size_bytes % 4 = 0 AS keeper_moved FROM l JOIN k ON k.group_id = l.group_id WHERE n >= 2""")
def remaining_groups(spark, d):
    m = _vec(spark, d, "Similar")
    moved = m.filter("size_bytes % 4 = 0").select("path")
    renamed = m.filter("size_bytes % 7 = 0").select("path", F.concat("path", F.lit(".back")).alias("new_path"))
    return results.remaining(m, groups(m), moved, renamed).select("group_id", "path", "rank", "kind", F.col("p_distance").cast("int").alias("p_distance"), "keeper_moved")


# --- names and texts ----------------------------------------------------------------------------

@query("copy_name_flags", f"WITH {O.URL} SELECT page_id, {O.is_copy('path')} AS is_copy, {O.screenshot('path')} AS is_screenshot, regexp_matches({O.stem('path')}, '(?i)burst') AS is_burst FROM url_paths")
def copy_name_flags(spark, d):
    p = F.col("path")
    return V.url_paths(spark, d).select("page_id", text.looks_like_copy(p).alias("is_copy"), text.looks_like_screenshot(p).alias("is_screenshot"), text.is_burst_name(p).alias("is_burst"))


@query("path_parts", f"WITH {O.URL} SELECT page_id, {O.base_name('path')} AS name, {O.stem('path')} AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, {O.fmt('path')} AS fmt FROM url_paths")
def path_parts(spark, d):
    p = F.col("path")
    return V.url_paths(spark, d).select("page_id", text.base_name(p).alias("name"), text.stem(p).alias("stem"), text.folder(p).alias("folder"), text.format_key(p).alias("fmt"))


@query("sequence_stems", f"WITH {O.URL} SELECT page_id, {O.seq_stem('path')} AS stem, regexp_matches({O.stem('path')}, '^.+_\\d{{3}}$') AS numbered FROM url_paths")
def sequence_stems(spark, d):
    return V.url_paths(spark, d).select("page_id", text.sequence_stem(F.col("path")).alias("stem"), text.is_numbered(F.col("path")).alias("numbered"))


_F = O.fmt("path")


@query("format_alias", f"WITH {O.URL}, f AS (SELECT {_F} AS fmt FROM url_paths) SELECT fmt, CASE upper(replace(fmt, '.', '')) WHEN 'JPG' THEN 'JPEG' WHEN 'TIF' THEN 'TIFF' WHEN '' THEN 'Unknown' ELSE upper(replace(fmt, '.', '')) END AS name, count(*) AS n FROM f GROUP BY 1, 2")
def format_alias(spark, d):
    p = F.col("path")
    return V.url_paths(spark, d).groupBy(text.format_key(p).alias("fmt"), text.format_name(p).alias("name")).agg(F.count("*").alias("n"))


@query("screen_size_flags", f"WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ([1280, 1920, 1366, 750, 1080, 1170, 640])[l_partkey % 7 + 1] AS w, ([720, 1080, 768, 1334, 1920, 2532, 480])[l_suppkey % 7 + 1] AS h FROM lineitem) SELECT w AS width, h AS height, {O.is_screen('w', 'h')} AS is_screen, count(*) AS n FROM s GROUP BY ALL")
def screen_size_flags(spark, d):
    s = V.table(spark, d, "lineitem").select(F.expr("element_at(array(1280, 1920, 1366, 750, 1080, 1170, 640), cast(l_partkey % 7 as int) + 1)").alias("width"), F.expr("element_at(array(720, 1080, 768, 1334, 1920, 2532, 480), cast(l_suppkey % 7 as int) + 1)").alias("height"))
    return s.groupBy("width", "height", text.is_screen_size(F.col("width"), F.col("height")).alias("is_screen")).agg(F.count("*").alias("n"))


@query("camera_name", f"WITH {O.VEC} SELECT path, CASE WHEN camera_model IS NULL THEN camera_make WHEN camera_make IS NULL OR starts_with(upper(camera_model), upper(camera_make)) THEN camera_model ELSE camera_make || ' ' || camera_model END AS camera FROM vec_files")
def camera_name(spark, d):
    return V.vec_files(spark, d).select("path", text.camera_name(F.col("camera_make"), F.col("camera_model")).alias("camera"))


@query("size_text", f"WITH {O.URL} SELECT page_id, {O.units('size_bytes', 1)} AS size, {O.sizes('size_bytes', '(size_bytes + 1000)')} AS sizes FROM url_paths")
def size_text(spark, d):
    b = F.col("size_bytes")
    return V.url_paths(spark, d).select("page_id", text.size_text(b).alias("size"), text.sizes_text(b, b + 1000).alias("sizes"))


@query("display_text", "SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS duration, format('{:,}', n) || CASE WHEN n = 1 THEN ' photo' ELSE ' photos' END AS count FROM (SELECT o_orderkey, o_orderkey * 37 % 9000 AS s, o_orderkey % 3000 AS n FROM orders)")
def display_text(spark, d):
    o = V.table(spark, d, "orders")
    return o.select("o_orderkey", text.duration_text(F.expr("o_orderkey * 37 % 9000")).alias("duration"), text.count_text(F.expr("o_orderkey % 3000"), "photo", "photos").alias("count"))


@query("online_only", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (([0, 4096, 262144, 4194304, 1024, 4128, 524288])[l_partkey % 7 + 1] & 4460544) <> 0 AS online FROM lineitem")
def online_only(spark, d):
    a = F.expr("element_at(array(0, 4096, 262144, 4194304, 1024, 4128, 524288), cast(l_partkey % 7 as int) + 1)")
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.is_online_only(a).alias("online"))


# --- folders, cache, clean-up -------------------------------------------------------------------

def _roots(spark, d) -> DataFrame:
    return V.url_paths(spark, d).select(F.explode(F.array(text.folder(F.col("path")), text.folder(text.folder(F.col("path"))))).alias("root")).filter("root <> ''").distinct()


_ROOTS = f"{O.URL}, roots AS (SELECT DISTINCT root FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root FROM url_paths UNION ALL SELECT regexp_extract(regexp_extract(path, '^(.*)/[^/]*$', 1), '^(.*)/[^/]*$', 1) FROM url_paths) WHERE root <> '')"


@query("innermost_root", f"WITH {_ROOTS} SELECT path, (SELECT arg_max(rtrim(root, '/'), length(rtrim(root, '/'))) FROM roots WHERE starts_with(upper(path), upper(rtrim(root, '/')) || '/')) AS root FROM url_paths")
def innermost_root(spark, d):
    return cleanup.innermost_root(V.url_paths(spark, d).select("path"), _roots(spark, d)).select("path", "root")


@query("folder_cover", f"WITH {_ROOTS}, n AS (SELECT DISTINCT rtrim(root, '/') AS path FROM roots), u AS (SELECT upper(path) AS u, min(path) AS path FROM n GROUP BY 1) SELECT path FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE starts_with(u.u, o.u || '/'))")
def folder_cover(spark, d):
    return results.covering_folders(_roots(spark, d).withColumnRenamed("root", "path"))


_CACHE = f"{O.DOC}, c AS (SELECT CASE WHEN doc_id % 4 = 0 THEN upper(path) ELSE path END AS path, size_bytes + (doc_id % 5 = 0)::INTEGER AS size_bytes, last_write + to_seconds((doc_id % 7 = 0)::INTEGER) AS last_write, sha256, doc_id FROM doc_files WHERE doc_id % 3 > 0)"


def _cache(spark, d) -> DataFrame:
    f = V.doc_files(spark, d).withColumn("_i", F.expr("cast(regexp_extract(path, 'doc_([0-9]+)', 1) as bigint)")).filter("_i % 3 > 0")
    return f.withColumns({"path": F.expr("CASE WHEN _i % 4 = 0 THEN upper(path) ELSE path END"), "size_bytes": F.expr("size_bytes + CASE WHEN _i % 5 = 0 THEN 1 ELSE 0 END"), "last_write": F.expr("last_write + make_dt_interval(0, 0, 0, CASE WHEN _i % 7 = 0 THEN 1 ELSE 0 END)")}).drop("_i")


@query("cache_hits", f"WITH {_CACHE} SELECT f.path, c.sha256 FROM doc_files f JOIN c ON upper(f.path) = upper(c.path) AND f.size_bytes = c.size_bytes AND f.last_write = c.last_write")
def cache_hits(spark, d):
    return cache.hits(V.doc_files(spark, d), _cache(spark, d)).select("path", "sha256")


@query("cache_misses", f"WITH {_CACHE} SELECT path FROM doc_files f WHERE NOT EXISTS (SELECT 1 FROM c WHERE upper(f.path) = upper(c.path) AND f.size_bytes = c.size_bytes AND f.last_write = c.last_write)")
def cache_misses(spark, d):
    return cache.misses(V.doc_files(spark, d), _cache(spark, d)).select("path")


@query("cache_prune", f"WITH {O.DOC}, seen AS (SELECT path FROM doc_files WHERE doc_id % 2 = 0) SELECT path FROM doc_files WHERE NOT ((starts_with(upper(path), '/LIB/SRC1/') OR starts_with(upper(path), '/LIB/SRC2/')) AND upper(path) NOT IN (SELECT upper(path) FROM seen))")
def cache_prune(spark, d):
    f = V.doc_files(spark, d)
    return cache.pruned(f, f.filter("cast(regexp_extract(path, 'doc_([0-9]+)', 1) as bigint) % 2 = 0"), ["/lib/src1", "/lib/SRC2/"]).select("path")


@query("cache_migrate", f"WITH {O.DOC} SELECT path FROM doc_files WHERE NOT lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.gif', '.png', '.apng', '.webp')")
def cache_migrate(spark, d):
    return cache.migrated(V.doc_files(spark, d)).select("path")


@query("scan_summary", f"WITH {O.VEC} SELECT count(*) AS files, count(*) FILTER (status IN ('DecodeFailed', 'Unreadable', 'UnexpectedError')) AS errors, count(*) FILTER (status = 'OnlineOnlySkipped') AS online_only, 0::BIGINT AS online_only_bytes, count(*) FILTER (vec_id % 3 = 0) AS cache_hits FROM vec_files")
def scan_summary(spark, d):
    return results.scan_summary(V.vec_files(spark, d).withColumn("from_cache", F.expr("vec_id % 3 = 0")))


_SEL = "sel AS (SELECT path FROM gm WHERE size_bytes % 2 = 0 OR k >= 4 UNION ALL SELECT '/other/' || vec_id || '.jpg' FROM vec_files WHERE k = 0 AND vec_id % 50 = 0 UNION ALL SELECT '/vec/_Sievework Removed/' || vec_id || '.jpg' FROM vec_files WHERE k = 0 AND vec_id % 60 = 0)"


def _selected(spark, d, m: DataFrame) -> DataFrame:
    v = V.vec_files(spark, d).filter("k = 0")
    return m.filter("size_bytes % 2 = 0 OR k >= 4").select("path").unionByName(v.filter("vec_id % 50 = 0").selectExpr("concat('/other/', vec_id, '.jpg') AS path")).unionByName(v.filter("vec_id % 60 = 0").selectExpr(f"concat('/vec/{REVIEW_FOLDER}/', vec_id, '.jpg') AS path"))


@query("validate_problems", f"""{O.vec_groups('SamePhoto')}, {_SEL}, rt(root) AS (VALUES ('/vec/1'), ('/vec/2'), ('/vec/3'), ('/vec/4'), ('/vec/5'), ('/vec/6'), ('/vec/7'), ('/vec/8')),
s AS (SELECT path, EXISTS (SELECT 1 FROM rt WHERE starts_with(path, root || '/')) AS rooted, path IN (SELECT path FROM gm) AS known FROM sel),
g AS (SELECT group_id, count(*) AS n, count(*) FILTER (s.path IS NOT NULL AND rooted) AS o, count(*) FILTER (s.path IS NULL) AS kept FROM gm LEFT JOIN s ON s.path = gm.path GROUP BY 1)
SELECT CASE WHEN contains(path, '/_Sievework Removed/') THEN 'InsideReviewFolder' WHEN NOT known THEN 'NotInAnyGroup' ELSE 'OutsideScannedFolders' END AS problem, path FROM s WHERE contains(path, '/_Sievework Removed/') OR NOT known OR NOT rooted
UNION ALL SELECT 'RemovesEveryCopy', group_id FROM g WHERE o > 0 AND kept = 0""")
def validate_problems(spark, d):
    m = _vec(spark, d)
    roots = spark.createDataFrame([(f"/vec/{i}",) for i in range(1, 9)], "root string")
    return cleanup.problems(m, _selected(spark, d, m), roots).select("problem", "path")


@query("clean_up_plan", f"""{O.vec_groups('SamePhoto')}, c AS (SELECT *, kind = 'Identical' AS rm FROM gm) SELECT path, CASE WHEN rm THEN 'remove' ELSE 'keep' END AS action, CASE WHEN rm THEN substr(path, 6) END AS relative_path FROM c WHERE group_id IN (SELECT group_id FROM c WHERE rm)""")
def clean_up_plan(spark, d):
    m = _vec(spark, d)
    return cleanup.plan(m, m.filter("kind = 'Identical'").select("path"), spark.createDataFrame([("/vec",)], "root string")).select("path", "action", "relative_path")


@query("plan_failures", f"""{O.vec_groups('SamePhoto')}, c AS (SELECT *, kind = 'Identical' AS rm, CASE WHEN vec_id % 7 = 0 THEN 'NotFound' WHEN vec_id % 5 = 0 AND rank > 1 THEN 'ChangedSinceScan' ELSE 'Unchanged' END AS chk FROM gm), s AS (SELECT group_id, bool_or(NOT rm AND chk = 'Unchanged') AS safe FROM c GROUP BY 1)
SELECT path, CASE WHEN NOT rm THEN NULL WHEN NOT safe THEN 'KeptCopyMissing' WHEN chk <> 'Unchanged' THEN chk END AS failure FROM c JOIN s ON s.group_id = c.group_id WHERE c.group_id IN (SELECT group_id FROM c WHERE rm)""")
def plan_failures(spark, d):
    m = _vec(spark, d)
    planned = cleanup.plan(m, m.filter("kind = 'Identical'").select("path"), spark.createDataFrame([("/vec",)], "root string"))
    now = m.filter("vec_id % 7 <> 0").select("path", F.expr("size_bytes + CASE WHEN vec_id % 5 = 0 AND rank > 1 THEN 1 ELSE 0 END").alias("size_bytes"), "last_write")
    return cleanup.executable(planned, now).select("path", "failure")


@query("sidecar_lookup", f"WITH {O.DOC}, l AS (SELECT path || (['.json', '.supplemental-metadata.json', '.xmp'])[doc_id % 3 + 1] AS path FROM doc_files WHERE doc_id % 2 = 0) SELECT f.path, l.path AS sidecar FROM doc_files f JOIN l ON l.path IN (f.path || '.json', f.path || '.supplemental-metadata.json')")
def sidecar_lookup(spark, d):
    f = V.doc_files(spark, d)
    i = "cast(regexp_extract(path, 'doc_([0-9]+)', 1) as bigint)"
    listing = f.filter(f"{i} % 2 = 0").selectExpr(f"concat(path, element_at(array('.json', '.supplemental-metadata.json', '.xmp'), cast({i} % 3 as int) + 1)) AS path")
    return cleanup.sidecars(f, listing)


_LEDGER = "ledger AS (SELECT (doc_id % 9)::VARCHAR AS batch_id, TIMESTAMP '2024-02-01' + to_days((doc_id % 9)::INTEGER) AS created, source AS root, 'f' || doc_id AS relative_path, n_chars AS size_bytes, CASE WHEN doc_id % 4 = 1 THEN 'f' || (doc_id - CASE WHEN doc_id % 8 = 1 THEN 9 * 20 ELSE 1 END) END AS sidecar_of FROM documents)"


def _ledger(spark, d) -> DataFrame:
    return V.table(spark, d, "documents").selectExpr("cast(doc_id % 9 as string) AS batch_id", "timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(cast(doc_id % 9 as int)) AS created", "source AS root", "concat('f', doc_id) AS relative_path", "n_chars AS size_bytes", "CASE WHEN doc_id % 4 = 1 THEN concat('f', doc_id - CASE WHEN doc_id % 8 = 1 THEN 9 * 20 ELSE 1 END) END AS sidecar_of")


@query("batch_totals", f"WITH {_LEDGER} SELECT batch_id, min(created) AS created, count(DISTINCT root) AS roots, count(*) FILTER (sidecar_of IS NULL) AS photos, coalesce(sum(size_bytes) FILTER (sidecar_of IS NULL), 0)::BIGINT AS bytes FROM ledger GROUP BY 1")
def batch_totals(spark, d):
    return cleanup.batch_totals(_ledger(spark, d))


@query("orphan_sidecars", f"WITH {_LEDGER} SELECT batch_id, root, relative_path, sidecar_of FROM ledger l WHERE sidecar_of IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ledger p WHERE p.sidecar_of IS NULL AND p.batch_id = l.batch_id AND p.root = l.root AND p.relative_path = l.sidecar_of)")
def orphan_sidecars(spark, d):
    return cleanup.orphan_sidecars(_ledger(spark, d)).select("batch_id", "root", "relative_path", "sidecar_of")


# --- after a move and an undo -------------------------------------------------------------------

_DONE = f"{O.DOC}, b AS (SELECT * FROM doc_files WHERE doc_id % 2 = 0), mv AS (SELECT upper(path) AS path FROM b WHERE doc_id % 3 = 0), fl AS (SELECT path, (['InUse', 'IoError', 'NotFound', 'ChangedSinceScan'])[doc_id % 8 // 2 + 1] AS reason FROM b WHERE doc_id % 3 = 1), rs AS (SELECT path, path || '.back' AS restored_path FROM b WHERE doc_id % 3 = 0)"


def _done(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A batch of files; those moved, told in capitals; those that failed; those put back."""
    b = V.doc_files(spark, d).withColumn("doc_id", F.expr("cast(regexp_extract(path, 'doc_([0-9]+)', 1) as bigint)")).filter("doc_id % 2 = 0")
    third = b.filter("doc_id % 3 = 0")
    failed = b.filter("doc_id % 3 = 1").selectExpr("path", "element_at(array('InUse', 'IoError', 'NotFound', 'ChangedSinceScan'), cast(doc_id % 8 div 2 as int) + 1) AS reason")
    return b, third.select(F.upper("path").alias("path")), failed, third.selectExpr("path", "concat(path, '.back') AS restored_path")


@query("after_move", f"WITH {_DONE} SELECT path FROM b WHERE upper(path) NOT IN (SELECT path FROM mv) AND path NOT IN (SELECT path FROM fl WHERE reason <> 'InUse')")
def after_move(spark, d):
    b, moved, failed, _ = _done(spark, d)
    return cleanup.after_move(b.select("path"), moved, failed)


@query("moved_photos", f"WITH {_DONE} SELECT mv.path, CASE WHEN doc_id % 5 > 0 THEN size_bytes ELSE 0 END AS size_bytes FROM mv JOIN b ON upper(b.path) = mv.path")
def moved_photos(spark, d):
    b, moved, _, _ = _done(spark, d)
    return cleanup.moved_photos(b.withColumn("action", F.when(F.col("doc_id") % 5 > 0, "remove").otherwise("keep")), moved)


@query("moved_out", f"WITH {_DONE} SELECT path FROM b WHERE doc_id % 4 = 0 UNION SELECT restored_path[1:-6] FROM rs")
def moved_out(spark, d):
    b, _, _, back = _done(spark, d)
    return cleanup.moved_out(b.filter("doc_id % 4 = 0"), back)


@query("after_undo", f"WITH {_DONE} SELECT b.path, CASE WHEN restored_path IS NOT NULL THEN 'Restored' WHEN reason IN ('InUse', 'IoError') THEN 'Retry' WHEN reason IS NOT NULL THEN 'Lost' WHEN doc_id % 5 = 0 THEN 'Back' ELSE 'Gone' END AS outcome, CASE WHEN restored_path IS NOT NULL THEN restored_path WHEN reason IS NULL AND doc_id % 5 = 0 THEN b.path END AS now_path FROM b LEFT JOIN rs ON rs.path = b.path LEFT JOIN fl ON fl.path = b.path")
def after_undo(spark, d):
    b, _, failed, back = _done(spark, d)
    return cleanup.after_undo(b.select("path", "doc_id"), back, failed, b.filter("doc_id % 5 = 0")).select("path", "outcome", "now_path")


@query("plan_totals", f"{O.vec_groups('SamePhoto')} SELECT count(*) AS files, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM gm WHERE kind = 'Identical'")
def plan_totals(spark, d):
    m = _vec(spark, d)
    return cleanup.plan_totals(cleanup.plan(m, m.filter("kind = 'Identical'").select("path"), spark.createDataFrame([("/vec",)], "root string")))


@query("unreadable_folders", "SELECT * FROM (VALUES ('/Lib/a/'), ('/lib/c')) t(path)")
def unreadable_folders(spark, d):
    files = V.doc_files(spark, d).select("path", "status").unionByName(spark.createDataFrame([("/lib/A", "Unreadable"), ("/lib/b", "DecodeFailed"), ("/lib/C\\", "Unreadable")], "path string, status string"))
    return results.unreadable_folders(spark.createDataFrame([("/Lib/a/",), ("/lib/b",), ("/lib/c",), ("/lib",)], "path string"), files)


# --- orders, and two files side by side ---------------------------------------------------------

@query("files_by_path", f"WITH {O.DOC} SELECT path, size_bytes FROM doc_files ORDER BY upper(path), path")
def files_by_path(spark, d):
    return results.by_path(V.doc_files(spark, d)).select("path", "size_bytes")


@query("groups_by_keeper", f"{O.doc_groups()} SELECT group_id, count(*) AS n_members FROM gm GROUP BY 1 ORDER BY upper(group_id), group_id")
def groups_by_keeper(spark, d):
    return results.by_path(results.group_totals(group(V.doc_files(spark, d), "Exact")), "group_id").select("group_id", "n_members")


@query("problems_by_path", SQL["validate_problems"] + " ORDER BY path")
def problems_by_path(spark, d):
    return results.by_path(validate_problems(spark, d))


_ALONE = f"{O.ITEM}, {O.ranking('item_files', 'set_id')}, ak AS (SELECT r.path AS ask, k.path AS a, r.path AS b FROM rk k JOIN rk r ON r.set_id = k.set_id AND k.rnk = 1 AND r.rnk > 1), ax AS (SELECT ask, unnest([a, b]) AS path FROM ak), af AS (SELECT * FROM ax JOIN item_files USING (path)), {O.ranking('af', 'ask', 'rp')}, "


@query("compare_alone", f"WITH {_ALONE} p AS (SELECT ak.*, " + ", ".join(f"({v})::INTEGER AS {k}" for k, v in _SIGN.items()) + f", coalesce(a.sha256 = b.sha256, false) AS same, {O.reason('a', 'b')} AS ra, {O.reason('b', 'a')} AS rb FROM ak JOIN rp a ON a.ask = ak.ask AND a.path = ak.a JOIN rp b ON b.ask = ak.ask AND b.path = ak.b), w AS (SELECT *, CASE WHEN Resolution <> 0 THEN Resolution WHEN CameraData <> 0 THEN CameraData WHEN OriginalName <> 0 THEN OriginalName WHEN FileSize <> 0 THEN FileSize WHEN OlderCopy <> 0 THEN OlderCopy ELSE Path END AS winner FROM p) SELECT a, b, winner, CASE WHEN same OR winner = 0 THEN 'Identical copies' WHEN winner < 0 THEN ra ELSE rb END AS reason FROM w")
def compare_alone(spark, d):
    """Each set's keeper beside each other file, their keys measured between the two alone."""
    found = ranking.beside_keeper(V.item_files(spark, d, together=True), "set_id")
    return found.select(F.col("a_path").alias("a"), F.col("b_path").alias("b"), "winner", "reason")


_MOVED_TIME = "(last_write + INTERVAL 330 MINUTE)"


@query("local_dates", f"WITH {O.DOC} SELECT path, {O.dates(_MOVED_TIME, '(' + _MOVED_TIME + ' + to_hours((doc_id % 30)::INTEGER))')} AS dates FROM doc_files")
def local_dates(spark, d):
    i = "cast(regexp_extract(path, 'doc_([0-9]+)', 1) as int)"
    return V.doc_files(spark, d).select("path", text.dates_text(F.col("last_write"), F.expr(f"last_write + make_dt_interval(0, {i} % 30)"), "+05:30").alias("dates"))


# --- evaluation ---------------------------------------------------------------------------------

_VARIANTS = f"{O.VEC}, va AS (SELECT b.k, b.vec_id, b.path, bit_count(xor(a.p_hash, b.p_hash)::BIT) AS p, bit_count(xor(a.d_hash, b.d_hash)::BIT) AS d FROM vec_files a JOIN vec_files b ON a.vec_id = b.vec_id AND a.k = 0 AND b.k > 0 WHERE b.p_hash IS NOT NULL)"
_UNREL = f"{O.VEC}, un AS (SELECT a.path AS a, b.path AS b, bit_count(xor(a.p_hash, b.p_hash)::BIT) AS p, bit_count(xor(a.d_hash, b.d_hash)::BIT) AS d FROM vec_files a JOIN vec_files b ON a.k = 0 AND b.k = 0 AND a.path < b.path)"
_GRID = "g AS (SELECT p.x::INTEGER AS p_limit, d.x::INTEGER AS d_limit FROM range(2, 15) p(x), range(2, 15) d(x))"


def _variants(spark, d) -> DataFrame:
    v = V.vec_files(spark, d).filter("p_hash IS NOT NULL")
    a = v.filter("k = 0").select("vec_id", F.col("p_hash").alias("p0"), F.col("d_hash").alias("d0"))
    return v.filter("k > 0").join(a, "vec_id").select(F.col("k").cast("string").alias("kind"), "vec_id", "path", hashing.hamming(F.col("p_hash"), F.col("p0")).alias("p"), hashing.hamming(F.col("d_hash"), F.col("d0")).alias("d"))


def _unrelated(spark, d, most: int) -> DataFrame:
    """Distances of the pairs of originals, up to `most` bits in both."""
    from sievework.schema import Limits

    return match.similar_pairs(V.vec_files(spark, d).filter("k = 0"), "path", Limits(most, most), ("p_hash", "d_hash", "date_taken"), nested=None if most < 64 else 1 << 20)


@query("threshold_grid_recall", f"WITH {_VARIANTS}, {_GRID} SELECT p_limit, d_limit, round(count(*) FILTER (p <= p_limit AND d <= d_limit) / count(p)::DOUBLE, 9) AS recall FROM g, va GROUP BY ALL")
def threshold_grid_recall(spark, d):
    return evaluate.recall(_variants(spark, d)).select("p_limit", "d_limit", F.round("recall", 9).alias("recall"))


@query("threshold_grid_fp", f"WITH {_UNREL}, {_GRID} SELECT p_limit, d_limit, count(*) FILTER (p <= p_limit AND d <= d_limit) AS false_positives FROM g, un GROUP BY ALL")
def threshold_grid_fp(spark, d):
    return evaluate.false_positives(_unrelated(spark, d, evaluate.GRID[1]))  # farther pairs count nowhere on the grid


@query("distance_percentiles", f"WITH {_VARIANTS}, q AS (SELECT k::VARCHAR AS kind, list(greatest(p, d)::INTEGER ORDER BY greatest(p, d)) AS v FROM va GROUP BY 1) SELECT kind, x::INTEGER AS percent, v[greatest(1, ceil(x * len(v) / 100.0))::INTEGER] AS distance FROM q, (VALUES (0), (5), (50), (95), (100)) t(x)")
def distance_percentiles(spark, d):
    return evaluate.nearest_rank(_variants(spark, d).withColumn("distance", F.greatest("p", "d").cast("int")), "kind", "distance", (0, 5, 50, 95, 100))


@query("top_false_positives", f"WITH {_UNREL} SELECT a, b, p::INTEGER AS p, d::INTEGER AS d FROM un ORDER BY greatest(p, d), p + d, a, b LIMIT 100")
def top_false_positives(spark, d):
    return evaluate.top_false_positives(_unrelated(spark, d, 64)).select("a", "b", F.col("p").cast("int").alias("p"), F.col("d").cast("int").alias("d"))


_LOOK = f"{O.vec_groups('Similar')}, lp AS (SELECT group_id AS keeper, path AS member, p_distance AS p, d_distance AS d, CASE WHEN greatest(p_distance, d_distance) <= 2 THEN '0–2' WHEN greatest(p_distance, d_distance) <= 4 THEN '3–4' WHEN greatest(p_distance, d_distance) <= 6 THEN '5–6' WHEN greatest(p_distance, d_distance) <= 8 THEN '7–8' END AS bucket FROM gm WHERE rank > 1 AND kind <> 'Identical' AND p_distance IS NOT NULL), bk(bucket, hi) AS (VALUES ('0–2', 2), ('3–4', 4), ('5–6', 6), ('7–8', 8))"


@query("bucket_populations", _LOOK + ", b2 AS (SELECT bucket FROM bk UNION ALL SELECT '') SELECT b2.bucket, count(keeper) AS population FROM b2 LEFT JOIN lp ON coalesce(lp.bucket, '') = b2.bucket GROUP BY 1")
def bucket_populations(spark, d):
    return evaluate.populations(evaluate.look_alike_pairs(_vec(spark, d, "Similar")))


@query("stratified_sample", _LOOK + " SELECT bucket, keeper, member FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('7|' || keeper || '|' || member), keeper, member) AS n FROM lp WHERE bucket IS NOT NULL) WHERE n <= 30")
def stratified_sample(spark, d):
    return evaluate.stratified(evaluate.look_alike_pairs(_vec(spark, d, "Similar")), 30, 7).select("bucket", "keeper", "member")


_VERDICT = _LOOK + ", lb AS (SELECT *, CASE WHEN ascii(substr(md5(member), 1, 1)) < 51 THEN 'same' WHEN ascii(substr(md5(member), 1, 1)) < 98 THEN 'different' END AS verdict FROM lp WHERE bucket IS NOT NULL), bp AS (SELECT bk.bucket, bk.hi, count(keeper) AS population, count(verdict) AS labelled, count(*) FILTER (verdict = 'same') AS same, count(*) FILTER (keeper IS NOT NULL AND verdict IS NULL) AS unlabelled FROM bk LEFT JOIN lb ON lb.bucket = bk.bucket GROUP BY 1, 2)"


def _labelled(spark, d) -> tuple[DataFrame, DataFrame]:
    from sievework.functions.durable import cut

    pairs = cut(evaluate.look_alike_pairs(_vec(spark, d, "Similar")))
    c = F.ascii(F.substring(F.md5("member"), 1, 1))
    labels = pairs.withColumn("bucket", evaluate.bucket_of(F.col("p"), F.col("d"))).filter("bucket IS NOT NULL").withColumn("verdict", F.when(c < 51, "same").when(c < 98, "different"))
    buckets = evaluate.populations(pairs).filter("bucket <> ''").join(F.broadcast(spark.createDataFrame([(b[0], b[2]) for b in evaluate.BUCKETS], "bucket string, hi int")), "bucket")
    return labels, buckets


_W = "greatest(0.0, ({p} + 3.841443201936 / (2 * {n})) / (1 + 3.841443201936 / {n}) - 1.959964 / (1 + 3.841443201936 / {n}) * sqrt({p} * (1 - {p}) / {n} + 3.841443201936 / (4 * {n} * {n})))"


@query("bucket_precision", _VERDICT + f" SELECT bucket, population, labelled, same, unlabelled, round(CASE WHEN labelled > 0 THEN same / labelled::DOUBLE END, 6) AS precision, round(CASE WHEN labelled > 0 THEN {_W.format(p='(same / labelled::DOUBLE)', n='labelled::DOUBLE')} END, 6) AS low FROM bp")
def bucket_precision(spark, d):
    got = evaluate.bucket_precision(*_labelled(spark, d))
    return got.select("bucket", "population", "labelled", "same", "unlabelled", F.round("precision", 6).alias("precision"), F.round("interval.low", 6).alias("low"))


@query("overall_precision", _VERDICT + ", r AS (SELECT t.x AS up_to, bp.*, population / sum(population) OVER (PARTITION BY t.x) AS w FROM (VALUES (2), (4), (6), (8)) t(x) JOIN bp ON hi <= t.x AND population > 0) SELECT up_to, round(CASE WHEN min(labelled) > 0 THEN sum(w * same / labelled) END, 6) AS precision, round(CASE WHEN min(labelled) > 0 THEN 1 / sum(w * w / labelled) END, 6) AS n_eff FROM r GROUP BY 1")
def overall_precision(spark, d):
    return evaluate.overall_precision(evaluate.bucket_precision(*_labelled(spark, d)), [2, 4, 6, 8]).select("up_to", F.round("precision", 6).alias("precision"), F.round("n_eff", 6).alias("n_eff"))


@query("rule_effect", _VERDICT + ", e AS (SELECT lb.*, coalesce(x.date_taken <> y.date_taken, false) AS gone FROM lb JOIN vec_files x ON x.path = keeper JOIN vec_files y ON y.path = member), s AS (SELECT bp.bucket, population, count(e.keeper) AS sampled, count(*) FILTER (gone) AS removed, count(*) FILTER (gone AND verdict = 'same') AS removed_same, count(*) FILTER (gone AND verdict = 'different') AS removed_different FROM bp LEFT JOIN e ON e.bucket = bp.bucket GROUP BY 1, 2), fx AS (SELECT *, CASE WHEN sampled = 0 THEN population ELSE round(population * (sampled - removed) / sampled::DOUBLE) END::BIGINT AS kept_population FROM s) SELECT * FROM fx UNION ALL SELECT '', sum(population)::BIGINT, sum(sampled)::BIGINT, sum(removed)::BIGINT, sum(removed_same)::BIGINT, sum(removed_different)::BIGINT, sum(kept_population)::BIGINT FROM fx")
def rule_effect(spark, d):
    labels, buckets = _labelled(spark, d)
    return evaluate.rule_effect(labels, V.vec_files(spark, d), buckets)


# --- label files and samples --------------------------------------------------------------------

@query("originals_sample", f"WITH {O.DOC} SELECT path, row_number() OVER (ORDER BY md5('7|' || path), path)::INTEGER AS nth FROM doc_files WHERE regexp_matches(lower(path), '[.](jpg|jpeg|png|bmp|tif|tiff|webp)$') ORDER BY nth LIMIT 60")
def originals_sample(spark, d):
    return evaluate.drawn(V.doc_files(spark, d), 7, 60).select("path", "nth")


_LABELS = "SELECT (l_orderkey * 10 + l_linenumber)::INTEGER AS id, list_extract(['0–2', '3–4', '5–6', '7–8', 'none'], (l_suppkey % 5 + 1)::INTEGER) AS bucket, l_quantity::INTEGER % 10 AS p, l_linenumber::INTEGER AS d, CASE l_returnflag WHEN 'A' THEN 'same' WHEN 'R' THEN 'maybe' END AS verdict FROM lineitem"


@query("label_violations", f"WITH b(bucket, lo, hi) AS (VALUES ('0–2', 0, 2), ('3–4', 3, 4), ('5–6', 5, 6), ('7–8', 7, 8)), p AS ({_LABELS}), t AS (SELECT id, CASE WHEN coalesce(verdict NOT IN ('same', 'different'), false) THEN 'verdict' WHEN lo IS NULL THEN 'bucket' WHEN greatest(p, d) NOT BETWEEN lo AND hi THEN 'distance' END AS problem FROM p LEFT JOIN b USING (bucket)) SELECT * FROM t WHERE problem IS NOT NULL")
def label_violations(spark, d):
    pairs = V.table(spark, d, "lineitem").selectExpr("cast(l_orderkey * 10 + l_linenumber as int) AS id", "element_at(array('0–2', '3–4', '5–6', '7–8', 'none'), cast(l_suppkey % 5 as int) + 1) AS bucket", "cast(l_quantity as int) % 10 AS p", "cast(l_linenumber as int) AS d", "CASE l_returnflag WHEN 'A' THEN 'same' WHEN 'R' THEN 'maybe' END AS verdict")
    buckets = spark.createDataFrame([(labels.VERSION, *b, 0) for b in evaluate.BUCKETS], "version int, bucket string, lo int, hi int, population long")
    return labels.violations(buckets, pairs)


@query("variant_distances", f"WITH {_VARIANTS} SELECT path, k::INTEGER AS k, p::INTEGER AS p, d::INTEGER AS d FROM va")
def variant_distances(spark, d):
    v = V.vec_files(spark, d).filter("p_hash IS NOT NULL")
    return evaluate.variant_distances(v.filter("k > 0"), v.filter("k = 0"), "vec_id").select("path", F.col("k").cast("int").alias("k"), F.col("p").cast("int").alias("p"), F.col("d").cast("int").alias("d"))


@query("false_positives_beyond", f"WITH {_UNREL}, t AS (SELECT greatest(count(*) - 100, 0) AS more FROM un WHERE greatest(p, d) <= 14) SELECT more, CASE WHEN more > 0 THEN '… and ' || more || ' more' END AS line FROM t")
def false_positives_beyond(spark, d):
    return evaluate.beyond(_unrelated(spark, d, evaluate.GRID[1]))


@query("times_unreadable", f"WITH {O.VEC}, l AS (SELECT path FROM vec_files WHERE k IN (0, 5) UNION SELECT '/away/' || vec_id FROM vec_files WHERE k = 0 AND vec_id % 9 = 0) SELECT count(*) AS paths, count(*) FILTER (status IS NULL OR status <> 'Ok') AS unreadable FROM l LEFT JOIN vec_files USING (path)")
def times_unreadable(spark, d):
    v = V.vec_files(spark, d)
    labelled = v.filter("k = 0").selectExpr("vec_id", "path AS keeper").join(v.filter("k = 5").selectExpr("vec_id", "path AS member"), "vec_id").select("keeper", "member").unionByName(v.filter("k = 0 AND vec_id % 9 = 0").selectExpr("path AS keeper", "concat('/away/', vec_id) AS member"))
    return evaluate.unreadable(evaluate.times_read(labelled, v))
