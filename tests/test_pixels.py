import os
import struct

import numpy as np

from sievework.functions import hashing
from sievework.operators.grouping import group
from sievework.sources.listing import scan
from sievework.sources.pixels import hashes


def scene(n):
    """n x n pixels with power in every frequency that the hashes look at; a plain wave has next to none in most, so that a JPEG's rounding sets those bits."""
    grid = np.random.default_rng(5).integers(20, 236, (12, 12)).astype(float)
    at = np.linspace(0, 11, n)
    rows = np.array([np.interp(at, range(12), g) for g in grid])
    return np.array([np.interp(at, range(12), c) for c in rows.T]).T.astype(np.uint8)


def draw(spark, grey, path, fmt, kind=5):
    """Write a grey array as a colour image (kind 5) or a grey one (10) with the JVM's writer."""
    j = spark._jvm
    im = j.java.awt.image.BufferedImage(grey.shape[1], grey.shape[0], kind)
    for y in range(grey.shape[0]):
        for x in range(grey.shape[1]):
            im.setRGB(x, y, int(grey[y, x]) * 0x010101)
    assert j.javax.imageio.ImageIO.write(im, fmt, j.java.io.File(path))


def turned(jpeg, orientation):
    """The same JPEG with an EXIF orientation."""
    tiff = b"II*\0" + struct.pack("<IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0)
    body = b"Exif\0\0" + tiff
    return jpeg[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + jpeg[2:]


def test_formats_of_the_jvm(spark, tmp_path):
    root = str(tmp_path / "lib [1] +%é,{b}")
    os.makedirs(root)
    big = scene(128)
    draw(spark, big, f"{root}/a.jpg", "jpg")
    draw(spark, scene(64), f"{root}/small+.JPG", "jpg")
    draw(spark, big, f"{root}/b.gif", "gif")
    draw(spark, big, f"{root}/c.tif", "tiff")
    draw(spark, np.rot90(big, 1), f"{root}/lying", "jpg")
    with open(f"{root}/lying", "rb") as f:
        lying = f.read()
    os.remove(f"{root}/lying")
    for name, body in (("turned.jpg", turned(lying, 6)), ("lying.jpg", lying), ("bad.jpg", b"junk"), ("empty.jpg", b""), ("_hidden.jpg", lying)):
        with open(f"{root}/{name}", "wb") as f:
            f.write(body)
    got = scan(spark, [root])
    by = {os.path.basename(r.path): r for r in got.collect()}
    assert len(by) == 9
    assert {n for n, r in by.items() if r.status != "Ok"} == {"bad.jpg", "empty.jpg", "_hidden.jpg"}
    p, d = hashing.fingerprint(big)
    away = {n: (bin((r.p_hash ^ p) & (2**64 - 1)).count("1"), bin((r.d_hash ^ d) & (2**64 - 1)).count("1")) for n, r in by.items() if r.status == "Ok"}
    alike = {n for n, (x, y) in away.items() if x <= 4 and y <= 5}
    assert alike == {"a.jpg", "small+.JPG", "b.gif", "c.tif", "turned.jpg"}, away
    sets = {}
    for r in group(got, "SamePhoto").collect():
        sets.setdefault(r.group_id, set()).add(os.path.basename(r.path))
    assert sorted(map(sorted, sets.values())) == [["_hidden.jpg", "lying.jpg"], sorted(alike)]  # the first two by equal bytes


def test_grey_and_wide_samples(spark, tmp_path):
    big = scene(128)
    for name, kind in (("grey.tif", 10), ("wide.tif", 11)):
        draw(spark, big, str(tmp_path / name), "tiff", kind)
    got = {os.path.basename(r.path): r.p_hash for r in hashes(spark, [str(tmp_path / "grey.tif"), str(tmp_path / "wide.tif")]).collect()}
    assert got["grey.tif"] is not None and got["wide.tif"] is None
