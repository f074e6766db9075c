"""The same catalogs and steps in DuckDB's SQL, as common table expressions."""

VEC = """
h0 AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_sort(list_transform(embedding, lambda x: x::DOUBLE)) AS s FROM embeddings WHERE len(embedding) = 64),
h1 AS (SELECT vec_id, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN e[i + 1] > (s[32] + s[33]) / 2 THEN (1::HUGEINT << i::HUGEINT) ELSE 0::HUGEINT END))::UBIGINT AS p0,
  list_sum(list_transform(range(0, 63), lambda i: CASE WHEN e[i + 2] > e[i + 1] THEN (1::HUGEINT << i::HUGEINT) ELSE 0::HUGEINT END))::UBIGINT AS d0 FROM h0),
vk AS (SELECT vec_id, k, p0, d0, ((1::HUGEINT << (2 * k)::HUGEINT) - 1)::UBIGINT AS mask FROM h1, range(0, 6) t(k)),
vec_files AS (SELECT vec_id, k, '/vec/' || (vec_id % 10) || '/' || CASE vec_id % 6
    WHEN 0 THEN 'IMG_' || vec_id || CASE WHEN k > 0 THEN ' (' || k || ')' ELSE '' END WHEN 1 THEN 'Screenshot_' || vec_id || '_' || k
    WHEN 2 THEN 'V' || vec_id || '_' || lpad(k::VARCHAR, 3, '0') WHEN 3 THEN 'photo' || vec_id || CASE WHEN k % 2 = 1 THEN ' copy' ELSE '-' END || k
    WHEN 4 THEN 'B' || vec_id || '_BURST' || k ELSE 'P' || vec_id || '.' || k END || (['.jpg', '.jpeg', '.png', '.tif'])[(vec_id + k) % 4 + 1] AS path,
  50000 + (vec_id * 7919 + k * 331) % 900000 AS size_bytes, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(vec_id * 60 + k) AS last_write,
  CASE WHEN k = 5 AND vec_id % 8 = 0 THEN 'DecodeFailed' ELSE 'Ok' END AS status,
  upper(sha256('V' || vec_id || '-' || CASE WHEN k = 5 AND vec_id % 4 = 0 THEN 4 ELSE k END)) AS sha256,
  CASE WHEN k = 5 AND vec_id % 8 = 0 THEN NULL ELSE xor(p0, mask) END AS p_hash, CASE WHEN k = 5 AND vec_id % 8 = 0 THEN NULL ELSE xor(d0, mask) END AS d_hash,
  CASE WHEN vec_id % 6 = 1 THEN 1920 ELSE 400 + (vec_id % 7) * 300 - (k % 2) * 20 END AS width, CASE WHEN vec_id % 6 = 1 THEN 1080 ELSE 300 + (vec_id % 5) * 200 END AS height,
  CASE vec_id % 5 WHEN 0 THEN 'Canon' WHEN 2 THEN 'Apple' END AS camera_make, CASE vec_id % 5 WHEN 0 THEN 'Canon EOS R5' WHEN 2 THEN 'iPhone 15' WHEN 3 THEN 'X100' END AS camera_model,
  CASE WHEN vec_id % 3 = 1 OR (vec_id % 3 = 0 AND k = 3) THEN NULL ELSE TIMESTAMP '2023-06-01 12:00:00' + to_seconds(vec_id * 100 + CASE WHEN vec_id % 3 = 2 THEN k * (vec_id % 2) ELSE 0 END) END AS date_taken,
  CASE WHEN vec_id % 11 = 0 AND k = 2 THEN 12 ELSE 1 END AS frame_count FROM vk)"""

DOC = """
doc_files AS (SELECT doc_id, '/lib/' || source || '/doc_' || lpad(doc_id::VARCHAR, 7, '0') || (['', ' (1)', ' copy', '', '_edited', '.2', ''])[doc_id % 7 + 1] || (['.jpg', '.JPEG', '.png', '.heic', '.tiff'])[doc_id % 5 + 1] AS path,
  n_chars AS size_bytes, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS last_write, 'Ok' AS status, upper(sha256(text)) AS sha256, NULL::INTEGER AS width, NULL::INTEGER AS height,
  NULL::VARCHAR AS camera_make, NULL::VARCHAR AS camera_model, NULL::TIMESTAMP AS date_taken, NULL::UBIGINT AS p_hash, NULL::UBIGINT AS d_hash, 1 AS frame_count FROM documents)"""

ITEM = """
item_files AS (SELECT l_orderkey AS set_id, '/items/' || l_orderkey || '/' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || CASE WHEN l_suppkey % 3 = 0 THEN ' copy' ELSE '' END || CASE WHEN l_linenumber % 2 = 0 THEN '.jpg' ELSE '.png' END AS path,
  trunc(l_extendedprice)::BIGINT AS size_bytes, l_shipdate AS last_write, upper(sha256((l_partkey % 50) || '-' || (l_suppkey % 3))) AS sha256, trunc(l_quantity * 40)::INTEGER AS width, trunc(l_quantity * 30)::INTEGER AS height,
  CASE WHEN l_returnflag = 'R' THEN 'Canon' END AS camera_make, CASE WHEN l_returnflag = 'R' THEN 'EOS' END AS camera_model, NULL::TIMESTAMP AS date_taken FROM lineitem)"""

URL = """
url_paths AS (SELECT page_id, regexp_replace(url, '^https?:/', '') || '/' || (['IMG_1 (2)', 'photo copy', 'photocopy', 'a_copy_b', 'Screen Shot 3', 'x_thumb', 'IMG_1234.0', '2016-03-09 21.03.33', 'v1.2.3', 'MVIMG_BURST12', 'pic_001', 'pic_0012', 'exported-7', 'copyright', 'Scaled'])[page_id % 15 + 1]
  || (['.jpg', '.JPEG', '.tiff', '.heif', '.jpe', '.png', ''])[page_id % 7 + 1] AS path, page_id * page_id * 997 % 7000000000 AS size_bytes FROM pages)"""


def base_name(p: str) -> str:
    return f"regexp_extract({p}, '([^/\\\\]*)$', 1)"


def stem(p: str) -> str:
    return f"regexp_replace({base_name(p)}, '\\.[^.]*$', '')"


def fmt(p: str) -> str:
    e = f"lower(regexp_extract({base_name(p)}, '(\\.[^.]+)$', 1))"
    return f"CASE {e} WHEN '.jpeg' THEN '.jpg' WHEN '.jpe' THEN '.jpg' WHEN '.tiff' THEN '.tif' WHEN '.heif' THEN '.heic' ELSE {e} END"


WORDS = "copy|edited|resized|compressed|scaled|thumb|thumbnail|export|exported"


def is_copy(p: str) -> str:
    return f"(regexp_matches({stem(p)}, '(?i)\\(\\d+\\)|(^|[^a-z])({WORDS})($|[^a-z])') OR regexp_matches({stem(p)}, '^[^.]*[^\\d.][^.]*\\.\\d$'))"


def pairs(src: str, p: int, d: int, same_time: bool, name: str = "pr") -> str:
    """Representatives of src and their pairs within limits."""
    time = "AND NOT coalesce(a.date_taken <> b.date_taken, false)" if same_time else ""
    return f"""
reps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(sha256, 'path:' || path) ORDER BY upper(path), path) AS nth FROM {src} WHERE frame_count <= 1 AND p_hash IS NOT NULL AND d_hash IS NOT NULL) WHERE nth = 1),
{name} AS (SELECT a.path AS a, b.path AS b, bit_count(xor(a.p_hash, b.p_hash)::BIT) AS p, bit_count(xor(a.d_hash, b.d_hash)::BIT) AS d FROM reps a JOIN reps b ON a.path < b.path
  AND bit_count(xor(a.p_hash, b.p_hash)::BIT) <= {p} AND bit_count(xor(a.d_hash, b.d_hash)::BIT) <= {d} {time})"""


def components(src: str, look: bool) -> str:
    """comp (path, component_id): sets of two or more."""
    return f"""
first_sha AS (SELECT sha256, min(path) AS b FROM {src} WHERE sha256 IS NOT NULL GROUP BY sha256),
lk AS (SELECT f.path AS a, s.b FROM {src} f JOIN first_sha s ON f.sha256 = s.sha256 WHERE f.path <> s.b{" UNION SELECT a, b FROM pr" if look else ""}),
both_ AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
reach AS (SELECT a AS path, a AS r FROM both_ UNION SELECT x.path, y.b FROM reach x JOIN both_ y ON x.r = y.a),
comp AS (SELECT path, min(r) AS component_id FROM reach GROUP BY path)"""


def ranking(src: str, set_col: str, name: str = "rk") -> str:
    """src with rank keys and rnk within set_col."""
    px = "coalesce(width::BIGINT * height, 0)"
    f = fmt("path")
    return f"""
{name}0 AS (SELECT *, {px} AS px, max({px}) OVER (PARTITION BY {set_col}) AS mp, {f} AS fmt, max(size_bytes) OVER (PARTITION BY {set_col}, {f}) AS ms FROM {src}),
{name}1 AS (SELECT *, CASE WHEN px * 100 >= mp * 99 THEN mp ELSE px END AS tier, (camera_make IS NOT NULL OR camera_model IS NOT NULL OR date_taken IS NOT NULL)::INTEGER AS has_camera, {is_copy("path")}::INTEGER AS is_copy,
  CASE WHEN ms = 0 THEN 1.0 WHEN size_bytes::DOUBLE / ms >= 0.99 THEN 1.0 ELSE size_bytes::DOUBLE / ms END AS size_key, date_trunc('second', last_write) AS modified FROM {name}0),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {set_col} ORDER BY tier DESC, has_camera DESC, is_copy, size_key DESC, modified, path) AS rnk FROM {name}1)"""


def split(p: int | None, d: int | None, same_time: bool) -> str:
    """members (component_id, group_id, path, rank) of rk ranked by component, by taking the best file left over and over; f holds each file's own or its twin's hashes."""
    within = "false" if p is None else f"(x.fp IS NOT NULL AND k.fp IS NOT NULL AND bit_count(xor(x.fp, k.fp)::BIT) <= {p} AND bit_count(xor(x.fd, k.fd)::BIT) <= {d}{' AND NOT coalesce(x.t <> k.t, false)' if same_time else ''})"
    test = f"(x.path = k.path OR coalesce(x.sha = k.sha, false) OR {within})"
    return f"""
look AS (SELECT *, CASE WHEN frame_count <= 1 AND d_hash IS NOT NULL THEN p_hash END AS lp, CASE WHEN frame_count <= 1 AND p_hash IS NOT NULL THEN d_hash END AS ld FROM rk),
twin AS (SELECT component_id AS tc, sha256 AS ts, arg_min(lp, (upper(path), path)) AS tp, arg_min(ld, (upper(path), path)) AS td FROM look WHERE sha256 IS NOT NULL AND lp IS NOT NULL GROUP BY ALL),
f AS (SELECT l.*, coalesce(lp, tp) AS fp, coalesce(ld, td) AS fd FROM look l LEFT JOIN twin ON tc = component_id AND ts = sha256),
sp AS (SELECT component_id, list({{'path': path, 'sha': sha256, 'fp': fp, 'fd': fd, 't': date_taken}} ORDER BY rnk) AS rem, NULL::VARCHAR AS keeper, NULL::VARCHAR[] AS took FROM f GROUP BY component_id
  UNION ALL SELECT component_id, list_filter(rem, lambda x: NOT {test.replace('k.', 'rem[1].')}), rem[1].path, list_transform(list_filter(rem, lambda x: {test.replace('k.', 'rem[1].')}), lambda x: x.path) FROM sp WHERE len(rem) > 1),
members AS (SELECT component_id, keeper AS group_id, unnest(took) AS path, generate_subscripts(took, 1) AS rank FROM sp WHERE len(took) > 1),
gm AS (SELECT m.component_id, m.group_id, m.rank, r.*, bit_count(xor(r.fp, k.fp)::BIT) AS p_distance, bit_count(xor(r.fd, k.fd)::BIT) AS d_distance,
  CASE WHEN r.path = k.path THEN 'Keeper' WHEN r.sha256 = k.sha256 THEN 'Identical' WHEN bit_count(xor(r.fp, k.fp)::BIT) <= 4 AND bit_count(xor(r.fd, k.fd)::BIT) <= 5 AND NOT coalesce(r.date_taken <> k.date_taken, false) THEN 'SamePhoto' ELSE 'Similar' END AS kind
  FROM members m JOIN (SELECT * EXCLUDE (component_id) FROM f) r ON r.path = m.path JOIN (SELECT path, sha256, fp, fd, date_taken FROM f) k ON k.path = m.group_id)"""


def vec_groups(level: str) -> str:
    p, d, t = {"SamePhoto": (4, 5, True), "Similar": (14, 14, False)}[level]
    return f"WITH RECURSIVE {VEC}, {pairs('vec_files', p, d, t)}, {components('vec_files', True)}, src AS (SELECT v.*, component_id FROM vec_files v JOIN comp USING (path)), {ranking('src', 'component_id')}, {split(p, d, t)}"


def doc_groups() -> str:
    return f"WITH RECURSIVE {DOC}, {components('doc_files', False)}, src AS (SELECT v.*, component_id FROM doc_files v JOIN comp USING (path)), {ranking('src', 'component_id')}, {split(None, None, False)}"


SCREENS = ((1280, 720), (1280, 800), (1280, 1024), (1366, 768), (1440, 900), (1536, 864), (1600, 900), (1680, 1050), (1920, 1080), (1920, 1200), (2560, 1080), (2560, 1440), (2560, 1600), (2880, 1800), (3440, 1440), (3840, 2160))
PHONES = (720, 750, 828, 1080, 1125, 1170, 1179, 1242, 1284, 1290, 1440)


def is_screen(w: str, h: str) -> str:
    desktop = ", ".join(f"'{a}x{b}'" for a, b in SCREENS)
    return f"coalesce({w} > 0 AND {h} > 0 AND (greatest({w}, {h}) || 'x' || least({w}, {h}) IN ({desktop}) OR (least({w}, {h}) IN {PHONES} AND greatest({w}, {h}) * 9 >= least({w}, {h}) * 16)), false)"


def screenshot(p: str) -> str:
    return f"regexp_matches({stem(p)}, '(?i)screen[\\s_-]?shot|screen[\\s_-]?recording|screencap|capture d.écran|bildschirmfoto')"


def seq_stem(p: str) -> str:
    return f"CASE WHEN regexp_matches({stem(p)}, '^.+_\\d{{3}}$') THEN left({stem(p)}, length({stem(p)}) - 4) ELSE {stem(p)} END"


KINDS = f""",
sq AS (SELECT group_id, bool_or(n >= 2 AND numbered) AS has_sequence FROM (SELECT group_id, upper({seq_stem('path')}) AS s, count(*) AS n, bool_or(regexp_matches({stem('path')}, '^.+_\\d{{3}}$')) AS numbered FROM gm GROUP BY 1, 2) GROUP BY 1),
gk AS (SELECT gm.group_id, CASE WHEN count(*) = count(sha256) AND min(sha256) = max(sha256) THEN 'Copies'
  WHEN NOT bool_or(camera_make IS NOT NULL OR camera_model IS NOT NULL) AND bool_or(rank = 1 AND ({screenshot('path')} OR {is_screen('width', 'height')})) THEN 'Screenshots'
  WHEN coalesce(min(date_taken) < max(date_taken) AND max(date_taken) <= min(date_taken) + INTERVAL 10 SECOND, false) OR bool_or(regexp_matches({stem('path')}, '(?i)burst')) OR bool_or(has_sequence) THEN 'Burst' ELSE 'LookAlikes' END AS group_kind
  FROM gm JOIN sq ON sq.group_id = gm.group_id GROUP BY gm.group_id)"""


def units(n: str, decimals: int, names: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB")) -> str:
    out = f"({n})::VARCHAR || ' B'"
    whole = "".join(f" WHEN ({n}) >= {1024**i} THEN " + (f"regexp_replace(printf('%.{decimals}f', round(({n}) / {float(1024**i)}, {decimals})), '\\.0$', '')" if decimals == 1 else f"printf('%.{decimals}f', round(({n}) / {float(1024**i)}, {decimals}))") + f" || ' {u}'" for i, u in reversed(list(enumerate(names[1:], 1))))
    return f"(CASE{whole} ELSE {out} END)"


def sizes(a: str, b: str) -> str:
    names = ("B", "KB", "MB", "GB")
    cases = "".join(f" WHEN {units(a, i, names)} <> {units(b, i, names)} THEN {units(a, i, names)} || ' vs ' || {units(b, i, names)}" for i in (1, 2, 3))
    return f"(CASE{cases} ELSE format('{{:,}}', {a}) || ' B vs ' || format('{{:,}}', {b}) || ' B' END)"


def dates(a: str, b: str) -> str:
    return f"(CASE WHEN {a}::DATE = {b}::DATE THEN strftime({a}, '%Y-%m-%d %H:%M:%S') || ' vs ' || strftime({b}, '%Y-%m-%d %H:%M:%S') ELSE strftime({a}, '%Y-%m-%d') || ' vs ' || strftime({b}, '%Y-%m-%d') END)"


def reason(a: str, b: str) -> str:
    """Why a, the better, is better than b."""
    cam = f"(CASE WHEN {a}.camera_model IS NULL THEN {a}.camera_make WHEN {a}.camera_make IS NULL OR starts_with(upper({a}.camera_model), upper({a}.camera_make)) THEN {a}.camera_model ELSE {a}.camera_make || ' ' || {a}.camera_model END)"
    dim = lambda s: f"coalesce({s}.width || '×' || {s}.height, 'unknown')"
    return f"""CASE WHEN {a}.tier <> {b}.tier THEN 'Highest resolution (' || {dim(a)} || ' vs ' || {dim(b)} || ')' WHEN {a}.has_camera <> {b}.has_camera THEN coalesce('Has camera data (' || {cam} || ')', 'Has camera data')
 WHEN {a}.is_copy <> {b}.is_copy THEN 'Original file name ("' || {base_name(b + '.path')} || '" looks like a copy)' WHEN {a}.size_key <> {b}.size_key THEN 'Larger file, less compressed (' || {sizes(a + '.size_bytes', b + '.size_bytes')} || ')'
 WHEN {a}.modified <> {b}.modified THEN 'Older copy (modified ' || {dates(a + '.last_write', b + '.last_write')} || ')' ELSE 'Equally good copies; first by path' END"""
