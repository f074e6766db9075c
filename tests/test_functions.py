import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import hashing, imaging, text

COPY = {"IMG_1 (2).jpg": True, "photo copy.jpg": True, "photocopy.jpg": False, "copyright.jpg": False, "a_copy_b.jpg": True, "x_thumb.png": True, "Exported-7.jpg": True, "IMG_1234.0.jpg": True, "2016-03-09 21.03.33.jpg": False, "v1.2.3.jpg": False, "3.5.jpg": False, "14.07.2019.jpg": False, "/copy/IMG_1.jpg": False, "Scaled.jpg": True}


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_copy_names(spark):
    got = {r.p: r.x for r in spark.createDataFrame([(p,) for p in COPY], "p string").select("p", text.looks_like_copy(F.col("p")).alias("x")).collect()}
    assert got == COPY


def test_paths(spark):
    row = spark.createDataFrame([("C:\\Photos\\2024\\a.b.JPEG",)], "p string").select(text.base_name(F.col("p")).alias("n"), text.stem(F.col("p")).alias("s"), text.folder(F.col("p")).alias("f"), text.format_key(F.col("p")).alias("k"), text.is_inside(F.col("p"), F.lit("c:\\photos")).alias("i"), text.is_inside(F.col("p"), F.lit("C:\\Pho")).alias("o")).first()
    assert tuple(row) == ("a.b.JPEG", "a.b", "C:\\Photos\\2024", ".jpg", True, False)


@pytest.mark.parametrize("a,b,want", [(1536 * 1024, 200 * 1024, "1.5 MB vs 200 KB"), (25598, 25553, "25.00 KB vs 24.95 KB"), (1000, 1001, "1000 B vs 1001 B"), (2**40 + 1, 2**40, "1,099,511,627,777 B vs 1,099,511,627,776 B")])
def test_sizes(spark, a, b, want):
    assert one(spark, text.sizes_text(F.lit(a), F.lit(b))) == want


def test_screens(spark):
    rows = [(1920, 1080, True), (1080, 1920, True), (750, 1334, True), (1170, 2532, True), (750, 1000, False), (1000, 750, False), (None, 5, False), (0, 0, False)]
    got = spark.createDataFrame(rows, "w int, h int, want boolean").select("want", text.is_screen_size(F.col("w"), F.col("h")).alias("x")).collect()
    assert all(r.want == r.x for r in got)


def test_exif_texts(spark):
    assert one(spark, text.exif_text(F.lit(" Canon \x00"))) == "Canon"
    assert one(spark, text.exif_text(F.lit(" \x00"))) is None
    assert str(one(spark, text.exif_date(F.lit("2024:05:06 07:08:09")))) == "2024-05-06 07:08:09"
    assert one(spark, text.exif_date(F.lit("2024-05-06"))) is None


def test_camera_names(spark):
    rows = [("Canon", "Canon EOS", "Canon EOS"), ("Apple", "iPhone", "Apple iPhone"), (None, "X", "X"), ("M", None, "M"), (None, None, None)]
    assert [r.x for r in spark.createDataFrame(rows, "a string, b string, c string").select(text.camera_name(F.col("a"), F.col("b")).alias("x")).collect()] == [r[2] for r in rows]


def pattern():
    y, x = np.mgrid[0:32, 0:32]
    return (100 + 50 * np.sin(0.3 * x) + 40 * np.cos(0.5 * y + 0.1 * x)).astype(np.uint8)


def test_hashes():
    a = pattern()
    assert hashing.p_hash(a) == hashing.p_hash(a.astype(int) + 10 - 0)  # brighter by a constant moves one coefficient that stays the largest
    assert bin((hashing.p_hash(a) ^ hashing.p_hash(255 - a)) & (2**64 - 1)).count("1") >= 40
    ramp = np.tile(np.arange(9), (8, 1))
    assert hashing.d_hash(ramp) == -1 and hashing.d_hash(ramp[:, ::-1]) == 0


def test_packed_hash_is_numpys(spark):
    v = np.random.default_rng(1).normal(size=64)
    got = one(spark, hashing.median_hash(F.array(*[F.lit(float(x)) for x in v])))
    want = sum(1 << i for i in range(64) if v[i] > np.sort(v)[31:33].sum() / 2)
    assert got & (2**64 - 1) == want


def png(a, exif=b""):
    import struct
    import zlib

    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    h, w = a.shape
    rows = b"".join(b"\x00" + bytes(r) for r in a.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark):
    import struct

    a = np.kron(pattern(), np.ones((4, 4), np.uint8))
    assert (imaging.grey_image(png(a)) == a).all()
    exif = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHII", imaging.ORIENTATION, 3, 1, 6) + struct.pack("<I", 0)
    assert imaging.header(png(a[:64], exif))[:2] == (64, 128)
    assert imaging.grey_image(png(a[:64], exif)).shape == (128, 64)
    got = spark.createDataFrame([(bytearray(png(a)),), (bytearray(b"no image"),), (None,)], "c binary").select(hashing.fingerprint_udf("c").alias("f"), imaging.details_udf("c").alias("d")).collect()
    assert got[0].f.p_hash == hashing.fingerprint(a)[0] and got[0].d.width == 128
    assert got[1].f.p_hash is None and got[2].f.p_hash is None
    half = a[::2, ::2]
    assert bin((hashing.fingerprint(a)[0] ^ hashing.fingerprint(half)[0]) & (2**64 - 1)).count("1") <= 10
