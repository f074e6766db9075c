"""Operators over tables with nulls, ties, repeated rows, empty and long texts, extra columns and no rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.llm import language, licenses, media, minhash, mixing, sentencepiece_scan, sharding, suffixes, warc, winnowing

LOW = {i: i + 32 for i in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n int, key string, d double, id string, shard int, node int, b string"
OWN = 5


def rows_of_all_kinds():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 120))) for _ in range(40)]
    base = texts[0] + " " + " ".join(r.choice(vocabulary) for _ in range(100))
    near = []
    for _ in range(12):
        w = base.split(" ")
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        near.append(" ".join(w))
    passage = " ".join(r.choice(vocabulary) for _ in range(130))
    shared = [texts[i] + " " + passage + " " + texts[i + 1] for i in range(4)]
    special = [None, "", "  ", "one", "ONE", "é漢" * 300, "a" * 1000, " ".join(vocabulary) * 20, "12 34 !?"]
    out = [(i, t) for i, t in enumerate(texts + near + shared + special + texts[:6] + [base] * 9)]
    out += [out[3], out[3], (None, texts[5]), (None, None), (None, "lonely words here")]
    return [(i, t, r.choice(["x", "y", None]), r.choice(["s1", "s2", "s3", None]), None if t is None else len(t), "z", 1, "k", 0.5, "id", 3, 2, "b") for i, t in out]


ROWS = rows_of_all_kinds()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(spark, docs, none):
    assert sharding.shard_by_bytes(none).count() == 0
    got = sharding.shard_by_bytes(docs, 5).collect()
    key = lambda i, t: (hashlib.md5((t or "").encode()).hexdigest(), (i is None, i))
    order = sorted(((key(r[0], r[1]), r[0], len((r[1] or "").encode()) + 16) for r in ROWS), key=lambda x: x[0])
    total, upto, want, slots = sum(s for _, _, s in order), 0, Counter(), Counter()
    for _, i, s in order:
        upto += s
        shard = min(4, (2 * upto - s) * 5 // (2 * total))
        want[i, s, shard, slots[shard]] += 1
        slots[shard] += 1
    assert Counter((r.doc_id, r.size, r.shard, r.slot) for r in got) == want
    # few ranges or many, the shards are the same
    assert Counter((r.doc_id, r.size, r.shard, r.slot) for r in sharding.shard_by_bytes(docs, 5, ranges=2).collect()) == want


def test_warc(spark):
    big = "p" * 1500
    rows = [(1, "u", big), (2, None, big), (3, "u", "é" * 700), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", big), (8, "u", big), (None, "u", big), (9, "u", "\x00퟿" * 900)]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, kind string, digest int").repartition(3)
    to, manifest = warc.write_warc(pages, roll=600, range_bytes=2000)
    got = warc.read_warc(spark, to, manifest).collect()
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        owner = max((x[0] for x in rows if x[2] == h and x[0] is not None), default=None) if len(b) >= 1000 else None
        back = owner is not None and i is not None and i < owner
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if back else "response", owner if back else None] += 1
    assert Counter(map(tuple, got)) == want
    names = lambda m: sorted((r.file, r.sha256) for r in m.collect())
    assert names(manifest) == names(warc.write_warc(pages.repartition(5), roll=600, range_bytes=2000)[1])
    to, manifest = warc.write_warc(pages.limit(0))
    assert warc.read_warc(spark, to, manifest).count() == 0


def test_media(docs, none):
    assert media.document_media(none).count() == 0
    got = media.document_media(docs).collect()
    pad = lambda b: b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in got) == Counter((x[0], len((x[1] or "").encode()), hashlib.sha256(pad((x[1] or "").encode())).hexdigest()) for x in ROWS)


def test_payloads_in_their_place(spark):
    a, b = "a" * 64, "b" * 64
    img = lambda d: f'<img src="sha256:{d}" alt="c">'
    htmls = [(1, f"<p>x</p>{img(a)}<p>y</p>{img(b)}{img(a)}"), (1, "<p>again</p>"), (2, ""), (3, None), (None, img(b)), (None, "<p>z</p>"), (4, img("c" * 64) + '<img src="http://x">')]
    htmls += [(i, img(a)) for i in range(100, 300)]
    seqs = media.sequences(spark.createDataFrame(htmls, "page_id long, html string").repartition(3), "page_id")
    stored = spark.createDataFrame([(a, b"A"), (a, b"A"), (b, b"B")], "digest string, content binary")
    got = media.with_payloads(seqs, "page_id", stored)
    have = Counter((r.page_id, tuple((m.pos, m.kind, m.text, m.ref, m.caption, m.content and bytes(m.content)) for m in r["items"])) for r in got.collect())
    held = {f"sha256:{a}": b"A", f"sha256:{b}": b"B"}
    assert have == Counter((i, tuple((m["pos"], m["kind"], m["text"], m["ref"], m["caption"], held.get(m["ref"])) for m in media.sequence(h))) for i, h in htmls)
    assert media.with_payloads(seqs.limit(0), "page_id", stored).count() == 0


def test_mixing(docs, none):
    assert mixing.mix(none).count() == 0
    got = mixing.mix(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((x[0], size(x[1])) for x in ROWS)
    per = Counter()
    for x in ROWS:
        per[x[3]] += size(x[1])
    weight = dict(zip(sorted(per, key=lambda s: (s is None, s)), [5, 2, 1, 5], strict=False))
    full = set()
    while True:
        rest, w = sum(per.values()) - sum(3 * per[s] for s in full), sum(weight[s] for s in per if s not in full)
        target = {s: 3 * per[s] if s in full else rest * weight[s] / w for s in per}
        more = {s for s in per if s not in full and target[s] > 3 * per[s]}
        if not more:
            break
        full |= more
    by_size = {per[s]: s for s in per}
    taken = Counter()
    for r in got:
        s = by_size[r.source_size]
        assert abs(r.target - target[s]) < 1e-6 and r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[s] += r.taken
    largest = max(size(x[1]) for x in ROWS)
    assert all(abs(taken[s] - target[s]) <= largest for s in per)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))


def test_rates_meet_their_targets(docs):
    c = docs.select("source", mixing.n_words(F.col("text")).alias("n"))
    counts = c.groupBy("source", "n").agg(F.count("*").alias("c"))
    goal = mixing.targets(c)
    lam = {r.source: (r.lam, r.mean) for r in mixing.rates(counts, goal).collect()}
    for g in goal.collect():
        if g.source in lam:
            at, mean = lam[g.source]
            import math

            words = sum(r.n * r.c * min(3.0, math.exp(at * (r.n / mean) ** mixing.TILT)) for r in counts.filter(F.col("source").eqNullSafe(g.source)).collect())
            assert abs(words - g.target) < 1e-6 * g.target


def test_licenses(docs, none):
    assert licenses.scan_licenses(none).count() == 0
    assert Counter(r.doc_id for r in licenses.scan_licenses(docs).collect()) == Counter(x[0] for x in ROWS)


def brute_removal(rows, least):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[p : p + least] for p in range(len(b) - least + 1))
    out = Counter()
    for i, b in texts:
        spans = []
        for p in range(len(b) - least + 1):
            if seen[b[p : p + least]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + least
                else:
                    spans.append([p, p + least])
        kept, at = b"", 0
        for s, e in spans:
            kept, at = kept + b[at:s], e
        kept += b[at:]
        out[i, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("least", [64, 400])
def test_suffixes(docs, none, least):
    if least == 64:
        assert suffixes.removal(none, least).count() == 0
    assert Counter(map(tuple, suffixes.removal(docs, least).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == brute_removal([x[:2] for x in ROWS], least)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, none, k):
    if k == 2:
        assert minhash.near_duplicates(none, k).count() == 0
    sets = []
    for i, t, *_ in ROWS:
        w = WORD.findall((t or "").translate(LOW))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    part = list(range(len(sets)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                part[find(a)] = find(b)
    want = Counter()
    for x, (i, s) in enumerate(sets):
        least = min((sets[y][0] for y in range(len(sets)) if find(y) == find(x) and sets[y][0] is not None), default=None) if s else i
        want[i, len(s), least, i == least] += 1
    assert Counter(map(tuple, minhash.near_duplicates(docs, k).collect())) == want


def test_winnowing(spark, docs, none):
    assert winnowing.edits(none).count() == 0
    got = winnowing.edits(docs).collect()
    distinct = sorted({(x[0], x[1] or "") for x in ROWS}, key=lambda p: (p[0] is None, -(p[0] or 0), hashlib.md5(p[1].encode()).hexdigest()))
    after = {p: distinct[(i + 1) % len(distinct)] for i, p in enumerate(distinct)}
    want = Counter()
    for x in ROWS:
        t = x[1] or ""
        q = len(t) // 3
        want[x[0], len(t), hashlib.sha256((t[: len(t) - q] + after[x[0], t][1][:q]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    k, window = winnowing.K, winnowing.WINDOW
    rows = docs.select("text", winnowing.selections(F.col("text")).alias("f"), winnowing.words(F.col("text")).alias("w")).withColumn("h", F.transform(winnowing.grams(F.col("w"), k), lambda v: F.shiftright(v, winnowing.BITS))).collect()
    of: dict = {}
    for r in rows:
        for i in range(len(r.w) - k + 1):
            assert of.setdefault(tuple(r.w[i : i + k]), r.h[i]) == r.h[i]
    assert len(of) > 1000 and len(set(of.values())) == len(of)
    for r in rows:
        assert r.w == WORD.findall((r.text or "").translate(LOW))
        picks = []
        for i in range(max(1, len(r.h) - window + 1) if r.w else 0):
            part = r.h[i : i + window]
            at = i + max(j for j, v in enumerate(part) if v == min(part))
            if (r.h[at], at) not in picks:
                picks.append((r.h[at], at))
        assert picks == [(v >> winnowing.BITS, winnowing.PLACES - (v & winnowing.PLACES)) for v in r.f]


def test_winnowing_of_what_is_kept(spark):
    r = random.Random(5)
    word = lambda n: "".join(chr(r.randrange(97, 123)) for _ in range(n))
    texts = [word(n) for n in (*range(1, 50), 90, 639, 640, 641, 642, 3000)]
    texts += [" ".join(word(r.randrange(1, 8)) for _ in range(n)) for n in (2, 3, 4, 5, 8, 12, 16, 20, 23, 24, 100, 110, 150)]
    texts += [" ".join(word(24) for _ in range(n)) for n in (20, 25, 26, 27, 30)] + [" ".join(word(25) for _ in range(26))]
    texts += ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(n)) for n in (4, 20, 500, 2000)] + ["x" * 30 + " a b " + word(500)]
    rows = spark.createDataFrame([(i, t) for j in (0, 1) for i, t in enumerate(texts if j else texts[::-1], j * len(texts))] + [(-1, None)], "doc_id long, text string")
    got = winnowing.edits(rows).collect()
    assert [r for r in got if r.n_chars and not r.near_edited] == []
    # against every text that takes the place of the last third, or none
    short = [t for t in texts if len(t) < 700]
    pairs = spark.createDataFrame([(t, t[: len(t) - len(t) // 3] + b[: len(t) // 3]) for t in short for b in ("", r.choice(short), " " * 999, r.choice(short), "1 " * 500)], "a string, b string")
    assert pairs.select("*", winnowing.likeness(winnowing.fingerprint(F.col("a")), winnowing.fingerprint(F.col("b"))).alias("s")).filter("s = 0").collect() == []
    # other texts stay unlike, and what shares its words across the limit stays alike
    mean = sum(r.near_next for r in got) / len(got)
    assert mean < 0.1
    t = (" ".join(word(5) for _ in range(200)))[: winnowing.SHORT]
    one = spark.createDataFrame([(t, t + " and so on")], "a string, b string").select(winnowing.likeness(winnowing.fingerprint(F.col("a")), winnowing.fingerprint(F.col("b"))).alias("s")).first()
    assert one.s > 0.8


def test_sentencepiece(docs, none):
    assert sentencepiece_scan.encode(none).count() == 0
    whole = {(r.doc_id, r.n_chars, r.decoded_sha256) for r in sentencepiece_scan.encode(docs).collect()}
    got = sentencepiece_scan.encode(docs, chunk=100).collect()
    assert all(r.round_trip for r in got) and max(r.n_chunks for r in got) > sentencepiece_scan.BLOCK
    assert Counter(r.doc_id for r in got) == Counter(x[0] for x in ROWS) and {(r.doc_id, r.n_chars, r.decoded_sha256) for r in got} == whole


def test_language(docs, none):
    assert language.language_id(none).count() == 0
    got = language.language_id(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(x[0] for x in ROWS)
    assert all(r.lang_pred in ("x", "y", "und") and 0 <= r.score <= 1 for r in got)
    blank = {x[0] for x in ROWS if not re.search(r"[^\W\d_]", x[1] or "")}
    assert {r.doc_id for r in got if r.lang_pred == "und" and r.doc_id is not None} == blank - {None}


def test_many_languages(spark):
    r = random.Random(9)
    n = language.LANGUAGES + 40
    own = {f"l{i:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(5)] for i in range(n)}
    texts = [(lang, " ".join(r.choice(words) for _ in range(60))) for lang, words in own.items() for _ in range(3)]
    drawn = language.sample(spark.createDataFrame(texts, "lang string, text string"))
    assert sorted(map(tuple, drawn.collect())) == sorted(texts)
    judge = language.Judge(language.fit(drawn))
    assert [lang for lang, words in own.items() if judge.judge(" ".join(words))[0] != lang] == []
    assert language.share(300, 4) == 300 and language.share(300, 200) == 300 and language.share(300, 400) == 150 and language.share(300, 10**6) == 1


def brute_model(texts, words_kept, grams_kept):
    """Log frequencies counted text by text, whole."""
    languages = sorted({lang for lang, _ in texts})
    words = {lang: Counter() for lang in languages}
    for lang, t in texts:
        words[lang].update(re.findall(r"[a-z\u00e9\u6f22]+", t.lower()))
    grams = {lang: [Counter() for _ in range(language.N)] for lang in languages}
    for lang, c in words.items():
        for w, n in c.items():
            for k in range(1, language.N + 1):
                for i in range(len(w) - k + 1):
                    grams[lang][k - 1][w[i : i + k]] += n

    def top(c, most):
        order = sorted(c.values(), reverse=True)
        line = min((n for n in set(order) if sum(x >= n for x in order) <= most), default=max(order, default=0))
        return {x for x, n in c.items() if n >= line}

    known = {w for c in words.values() for w in top(c, words_kept) if c[w] >= language.SEEN}
    parts = {g for by in grams.values() for c in by for g in top(c, grams_kept) if c[g] >= language.SEEN or len(g) == 1}

    def row(c, whole, size):
        import math

        return [math.log((c[lang] + 0.5) / (whole[lang] + 0.5 * (size + 1))) for lang in languages]

    total = {lang: sum(c.values()) for lang, c in words.items()}
    w = {x: row({lang: words[lang][x] for lang in languages}, total, len(known)) for x in known}
    g = {x: row({lang: grams[lang][len(x) - 1][x] for lang in languages}, {lang: sum(grams[lang][len(x) - 1].values()) for lang in languages}, len(parts)) for x in parts}
    return languages, w, g


def brute_judge(found, text):
    import math

    languages, w, g = found
    words = re.findall(r"[a-z\u00e9\u6f22]+", (text or "").lower())
    if not words:
        return "und", 0.0
    total = [0.0] * len(languages)
    for x in words:
        row = w.get(x)
        if row is None:
            row = [0.0] * len(languages)
            for k in range(min(language.N, len(x)), 0, -1):
                own = [g[x[i : i + k]] for i in range(len(x) - k + 1) if x[i : i + k] in g]
                if own:
                    row = [sum(c) / len(own) for c in zip(*own, strict=True)]
                    break
        total = [a + b for a, b in zip(total, row, strict=True)]
    best = max(range(len(languages)), key=lambda i: (total[i], -i))
    p = [math.exp((t - max(total)) / math.sqrt(len(words))) for t in total]
    return languages[best], p[best] / sum(p)


@pytest.mark.parametrize("kept", [10**6, 25])
def test_language_against_brute_force(docs, kept, monkeypatch):
    monkeypatch.setattr(language, "WORDS", kept)
    monkeypatch.setattr(language, "GRAMS", kept)
    free = [(i, t, lang) for i, t, lang, *_ in ROWS if zlib.crc32(("" if i is None else str(i)).encode()) % 3 != 1]
    texts = sorted({(lang, t) for _, t, lang in free if lang and t and re.search(r"[^\W\d_]", t)})
    found = brute_model(texts, kept, kept)
    m = language.fit(language.sample(language.training(docs)))
    assert m.languages == found[0] and set(m.words) == set(found[1]) and set(m.grams) == set(found[2])
    for held, rows, want in ((m.words, m.rows, found[1]), (m.grams, m.gram_rows, found[2])):
        assert all(abs(a - b) < 1e-9 for x, i in held.items() for a, b in zip(rows[i], want[x], strict=True))
    judge = language.Judge(m)
    for _, t, *_ in ROWS:
        lang, score = judge.judge(t)
        want = brute_judge(found, t)
        assert abs(score - want[1]) < 1e-9 and (lang == want[0] or abs(score - 0.5) < 1e-9)


def test_sample_is_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(language, "PER_LANGUAGE", 20)
    texts = [("a", f"text number {i} " + "z" * 9000) for i in range(400)] + [("b", "only one text")] * 50 + [("c", "1 2 3"), ("c", None), (None, "none")]
    got = [tuple(r) for r in language.sample(spark.createDataFrame(texts, "lang string, text string")).collect()]
    assert 5 <= sum(x[0] == "a" for x in got) <= 45 and set(got) <= set(texts)
    assert [x for x in got if x[0] != "a"] == [("b", "only one text")]


def test_splitters_leave_only_single_keys_overfull(spark):
    rows = spark.createDataFrame([("m" if i % 3 == 0 else f"{i * 7919 % 3001:05d}", 100_000 if i < 6 else 50) for i in range(3000)], "key string, size long")
    for parts in (1, 5, 60):
        marks, held = sharding.splitters(rows, "key", "size", parts)
        share = max(1, sum(r.b for r in held) // parts)
        assert sum(r.n for r in held) == 3000 and len(held) <= len(marks) + 1
        assert all(r.b <= 2 * share or r.lo == r.hi for r in held)
    assert sharding.splitters(rows.limit(0), "key", "size", 5)[0] == []
