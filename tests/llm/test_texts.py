"""Operators that work on one text at a time, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sievework.llm import language, licenses, media, minhash, sentencepiece_scan, shingling, warc

LOW = {i: i + 32 for i in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0D]+")
TEXTS = ["", " ", "a", "One two, three\tfour\x0bfive", "é É 漢字 x", "x" * 5000, "A b a b a b", "the end \n\n of it", "▁ ▁▁a", "\x00\x01 null", "w " * 3000]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_shingles(k):
    r = random.Random(k)
    texts = TEXTS + [" ".join(r.choice("ab cd ef gh".split()) for _ in range(r.randrange(40))) for _ in range(100)]
    got = shingling.shingles([t.encode() for t in texts], k)
    seen = {}
    for t, g in zip(texts, got, strict=True):
        w = WORD.findall(t.translate(LOW))
        want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        assert len(g) == len(want)
        seen[frozenset(want)] = seen.get(frozenset(want), g.tobytes())
        assert seen[frozenset(want)] == g.tobytes()


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(3000)).encode()
    whole = shingling.shingles([text, b"a b"], 2)
    monkeypatch.setattr(shingling, "PIECE", 500)
    for a, b in zip(whole, shingling.shingles([text, b"a b"], 2), strict=True):
        assert (a == b).all()


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(3)
    x = np.unique(r.integers(1, 1 << 63, 4000, dtype=np.uint64))
    a, b = x[:3000], x[500:]
    ra, rb, ru = minhash.registers([a, b, np.unique(np.concatenate([a, b]))])
    assert (minhash.merge(ra, rb) == ru).all()
    j = minhash.estimate(ra[None], rb[None], np.array([3000.0]), np.array([3500.0]))[0]
    assert abs(j - 2500 / 4000) < 0.12
    assert minhash.estimate(ra[None], ra[None], np.array([3000.0]), np.array([3000.0]))[0] > 0.999


def brute_license(t):
    w, places, labels = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW)), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split(" ")
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses():
    texts = [*TEXTS, None, "Cc by cc BY", "MIT license mit-license", "gnu\ngeneral--public LICENSE apache license", "K cc by İ", "cc cc by by"]
    for t in texts:
        assert licenses.scan(t)[:5] == brute_license(t)
    got = licenses.scan("// SPDX-License-Identifier: MIT OR (Apache-2.0 AND BSD-3-Clause WITH X)\n")
    assert got[5] == "bsd-3-clause,spdx:apache-2.0,spdx:bsd-3-clause with x,spdx:mit"
    assert got[6] == 1.0


@pytest.mark.parametrize("text,want", [("MIT", "mit"), ("a or b and c", ["or", "a", ["and", "b", "c"]]), ("(a or b) and c", ["and", ["or", "a", "b"], "c"]), ("a with e or b", ["or", ["with", "a", "e"], "b"]), ("(a", "a"), ("a and", "a"), ("or a", None), ("", None)])
def test_expressions(text, want):
    assert licenses.parse(text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("SPDX-License-Identifier: MIT x SPDX-License-Identifier: GPL-2.0", ["gpl-2.0", "mit"]),
        ("license expression below; SPDX-License-Identifier: MIT", ["below", "mit"]),
        ("SPDX-License-Identifier: MIT OR spdx license identifier=(Zlib and\tISC)", ["(zlib and isc)", "mit"]),
        ("é SPDX-License-Identifier:MIT é 漢 SPDX-License-Identifier: ISC\r\nor BSD", ["isc", "mit"]),
        ("SPDX-License-Identifier: MIT, SPDX-License-Identifiers: A SPDX-License-Identifieré: B", ["mit"]),
        ("SPDX-License-Identifier:\nMIT", []),
    ],
)
def test_every_tag_of_a_line(text, want):
    assert licenses.scan(text)[7] == want


@pytest.mark.parametrize("op,shape", [("OR", "{}"), ("AND", "{}"), ("OR", "({}")])
def test_long_expressions(op, shape):
    all_names = [f"licence-{i}" for i in range(5000)]
    got = licenses.scan("SPDX-License-Identifier: " + f" {op} ".join(shape.format(x) for x in all_names) + " end here")
    assert got[5].split(",") == sorted(f"spdx:{x}" for x in all_names)
    assert len(got[7]) == 1 and re.findall(r"licence-\d+", got[7][0]) == all_names


def test_names():
    assert licenses.names(licenses.parse("(a or b) with e and c")) == {"a with e", "b with e", "c"}
    assert licenses.names(licenses.parse("(a or b) with (c or d)"), 3) == {"a", "b", "c", "d"}


def test_media():
    for t in TEXTS:
        b = t.encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        stored = b"P5\n192 %d\n255\n" % (len(p) // 192) + p
        assert media.look(stored)[:5] == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
    items = media.sequence('<p>a<b>b</b> &lt;c<figure><img src="x" alt=q><figcaption>cap <i>tion</i></figcaption></figure>tail<script>no</script><br>z')
    assert [(i["pos"], i["kind"], i["text"], i["ref"], i["caption"]) for i in items] == [(0, "text", "ab <c", None, None), (1, "media", None, "x", "cap tion"), (2, "text", "tail", None, None), (3, "text", "z", None, None)]
    assert media.sequence(None) == [] and media.sequence("<p> </p>") == []


def test_warc_record():
    whole = warc.record(7, "http://x/ y", b"\xff\x00", None)
    head, _, rest = whole.partition(b"\r\n\r\n")
    assert rest == b"\xff\x00\r\n\r\n" and b"Page-ID: 7" in head and b"WARC-Type: response" in head
    assert warc.record(7, "http://x/ y", b"\xff\x00", None) == whole
    assert b"Content-Length: 0" in warc.record(7, None, b"z", 9)


def small_model(texts):
    words = language.words_of(texts)
    grams = language.grams_of((lang, w, n) for (lang, w), n in words.items())
    counts = [(lang, 0, w, n) for (lang, w), n in words.items() if n >= language.SEEN] + [(lang, k, g, n) for (lang, k, g), n in grams.items()]
    totals = {}
    for lang, k, n in [(lang, 0, n) for (lang, _), n in words.items()] + [(lang, k, n) for (lang, k, _), n in grams.items()]:
        totals[lang, k] = (totals.get((lang, k), (0, 0))[0] + n, 0)
    return language.model(sorted({lang for lang, _ in texts}), totals, counts)


def test_language():
    j = language.Judge(small_model([("en", "the cat and the dog and the bird " * 5), ("de", "der hund und die katze und der vogel " * 5)]))
    assert j.judge("The dog and a bird")[0] == "en" and j.judge("Der Vogel und die Hunde")[0] == "de"
    assert j.judge("vogels")[0] == "de"  # unseen as a word
    for t in (None, "", " 12 !", "\u00b2 \u00bd", "\u2167"):
        assert j.judge(t) == ("und", 0.0)
    long = "the dog " * 40_000
    assert j.judge(long)[0] == "en" and 0 < j.judge(long)[1] <= 1
    assert language.Judge(language.model([], {}, [])).judge("x") == ("und", 0.0)


def test_one_run_of_letters_is_one_word():
    text = "a" * 300_000 + " b " + "c" * 70_000 + "1"
    assert language.words_of([("x", text)]) == {("x", "a" * 300_000): 1, ("x", "b"): 1, ("x", "c" * 70_000): 1}


def test_what_is_learned_of_unseen_words_is_forgotten(monkeypatch):
    monkeypatch.setattr(language, "REMEMBERED", 5)
    texts = [("en", "the cat and the dog " * 5), ("de", "der hund und die katze " * 5)]
    one = language.Judge(small_model(texts))
    for i in range(30):
        t = f"cats dogs hunde katzen word{'abcdefghij'[i % 10]} {'xyz'[i % 3] * (i + 1)}"
        assert one.judge(t) == language.Judge(small_model(texts)).judge(t)


@pytest.fixture(scope="module")
def codec():
    with open(sentencepiece_scan.default_model(), "rb") as f:
        return sentencepiece_scan.Codec(f.read())


def viterbi(codec, text):
    """Best score of a text, place by place; unknown characters count once each."""
    s = sentencepiece_scan.escaped(text)
    best = [-1e18] * (len(s) + 1)
    best[0] = 0.0
    for i in range(len(s)):
        single = False
        for j in range(i + 1, min(len(s), i + codec.longest) + 1):
            if (q := codec.scores.get(s[i:j])) is not None:
                best[j] = max(best[j], best[i] + q)
                single |= j == i + 1
        if not single:
            best[i + 1] = max(best[i + 1], best[i] + codec.unknown)
    return best[-1]


def score(codec, ids):
    total, run = 0.0, b""
    for i in ids:
        if codec.library.is_byte(i):
            run += codec.bytes_of[i]
        else:
            total += codec.unknown * len(run.decode()) + codec.library.get_score(i)
            run = b""
    return total + codec.unknown * len(run.decode())


def test_encoding_is_the_best_and_decodes(codec):
    for t in TEXTS:
        ids = codec.encode_all([t])[0]
        assert codec.decode(ids) == t
        if len(t) < 8000:
            assert abs(score(codec, ids) - viterbi(codec, t)) < 1e-6


def test_chunks_meet(codec):
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("abcdetionhsé") for _ in range(r.randrange(1, 12))) for _ in range(60)), "x" * 300, "a  b   c" * 30, "".join(r.choice("theindrs漢") for _ in range(400))]
    for t in texts:
        for size in (20, 41, 150):
            parts = [t[i : i + size] for i in range(0, len(t), size)]
            ahead = [t[i + size : i + size + codec.longest - 1] for i in range(0, len(t), size)]
            ms = [codec.transfer(p, a) for p, a in zip(parts, ahead, strict=True)]
            a, b, c = ms[0], ms[1], ms[-1]
            left = sentencepiece_scan.product(sentencepiece_scan.product(a, b), c)
            right = sentencepiece_scan.product(a, sentencepiece_scan.product(b, c))
            assert np.allclose(np.nan_to_num(left, neginf=-1e9), np.nan_to_num(right, neginf=-1e9))
            states = sentencepiece_scan.walk(ms, 0, 0)
            ids = [i for p, a, e, x in zip(parts, ahead, states, states[1:], strict=False) for i in codec.encode_all([p[e:] + a[:x]])[0]]
            assert codec.decode(ids) == t
            assert abs(score(codec, ids) - viterbi(codec, t)) < 1e-6
