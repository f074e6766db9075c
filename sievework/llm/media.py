"""Operator 3: media columns. HTML is parsed into an ordered sequence of text and media-reference structs; payloads are kept once more by digest in a stored media column, read back, and joined to the references by digest, so that positions and captions stay with the text around them.

Payloads are never shuffled: they are written where they are made and reduced to a few values where they are read; only digests, positions and those values meet.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lookup, salted, scratch, table, utf8

UNIT = 192
"""Payloads are padded with blanks to a positive multiple of so many bytes: the width of the stored image."""
ITEM = "struct<pos:int,kind:string,text:string,ref:string,caption:string>"
BLOCKS = {"p", "div", "article", "section", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "th", "blockquote", "pre", "ul", "ol", "table", "body", "title", "nav", "main"}
HIDDEN = {"script", "style", "template", "noscript"}
VALUES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.figure: list[int] = []

    def flush(self) -> None:
        text = "".join(self.text)
        self.text = []
        if text.strip():
            self.items.append({"pos": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in ("img", "video", "audio", "source"):
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                self.figure.append(len(self.items))
                self.items.append({"pos": len(self.items), "kind": "media", "text": None, "ref": a["src"], "caption": a.get("alt")})
        elif tag == "figure":
            self.flush()
            self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BLOCKS:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            for at in self.figure:
                self.items[at]["caption"] = "".join(self.caption).strip() or self.items[at]["caption"]
            self.caption = None
        elif tag == "figure":
            self.flush()
            self.figure = []
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """The text and media items of a page in their order; positions count from 0. Text blocks of white space only are left out; script and style are no text. A figcaption goes to the media of its figure, in place of their alt text. Null: none."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    if p.caption:
        p.text, p.caption = p.caption, None
    p.flush()
    return p.items


def sequences(pages: DataFrame, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """pages (id, html, keep...) -> id, keep..., items: array of ordered structs (pos, kind text or media, text, ref, caption). Narrow, no shuffle. Null or empty html: no items."""
    kinds = pages.select(id_col, *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.schema.fields) + f", items array<{ITEM}>"
    item = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(batch.num_rows, (16 << 20) * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                items = pa.array([sequence(x.as_py()) for x in part.column("html")], item)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in (id_col, *keep)), items], [id_col, *keep, "items"])

    return pages.select(id_col, *keep, "html").mapInArrow(run, schema)


def references(seqs: DataFrame, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A light row for each media item: id, keep..., pos, digest (of a reference sha256:...), caption."""
    media = F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("m")
    return seqs.select(id_col, *keep, media).select(id_col, *keep, F.col("m.pos").alias("pos"), F.regexp_extract("m.ref", "^sha256:([0-9a-f]{64})$", 1).alias("digest"), F.col("m.caption").alias("caption"))


def payload(text: Column) -> Column:
    """The text's bytes, with blanks up to a positive multiple of UNIT."""
    body = utf8(text)
    n = F.octet_length(body)
    return F.concat(body, F.repeat(F.lit(" "), F.greatest(F.lit(1), F.ceil(n / UNIT)).cast("int") * UNIT - n).cast("binary"))


def greymap(samples: Column) -> Column:
    """A binary grey map (P5) of width UNIT, one byte a sample."""
    return F.concat(F.concat(F.lit(f"P5\n{UNIT} "), (F.octet_length(samples) / UNIT).cast("int").cast("string"), F.lit("\n255\n")).cast("binary"), samples)


def store(media: DataFrame, to: str) -> DataFrame:
    """Write media (digest, content) to the shared folder, each task where it stands, and return the stored column. A digest may be stored more than once; its bytes are the same."""
    media.select("digest", "content").write.option("compression", "zstd").parquet(to)
    return media.sparkSession.read.parquet(to)


def look(content: bytes) -> tuple:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of a stored grey map.

    feature: mean, deviation and byte entropy of the samples, and 64 bits that tell which of 8 x 8 areas of the image are brighter than the middle one."""
    magic, shape, depth, samples = content.split(b"\n", 3)
    width, height = map(int, shape.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a whole grey map of 8-bit samples")
    a = np.frombuffer(samples, np.uint8)
    counts = np.bincount(a, minlength=256)
    level = np.arange(256)
    mean = float(counts @ level) / len(a)
    deviation = float(np.sqrt(max(0.0, float(counts @ (level * level)) / len(a) - mean * mean)))
    share = counts[counts > 0] / len(a)
    columns = np.add.reduceat(a.reshape(height, width), np.arange(0, width, width // 8), axis=1, dtype=np.int64)
    edges = np.arange(8) * height // 8
    ends = np.maximum(edges + 1, (np.arange(8) + 1) * height // 8)
    cum = np.vstack([np.zeros((1, 8), np.int64), np.cumsum(columns, axis=0)])
    areas = (cum[ends] - cum[edges]) / ((ends - edges)[:, None] * (width // 8))
    bits = int("".join("1" if x else "0" for x in (areas > np.median(areas)).ravel()), 2)
    feature = f"{mean:.4f} {deviation:.4f} {float(-(share * np.log2(share)).sum()):.4f} {bits:016x}"
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(content), hashlib.sha256(content).hexdigest(), feature


def inspect(stored: DataFrame) -> DataFrame:
    """VALUES for each stored row, from the bytes that were read back; a payload whose digest isn't the one it is stored under raises."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in VALUES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, content in zip(batch.column("digest"), batch.column("content"), strict=True):
                rows.append((digest.as_py(), *look(content.as_py())))
                if rows[-1][2] != rows[-1][0]:
                    raise ValueError(f"{rows[-1][0]}: other bytes were read back")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return stored.select("digest", "content").mapInArrow(run, VALUES)


def resolve(refs: DataFrame, values: DataFrame) -> DataFrame:
    """refs (.., digest) with the values of the payload stored under that digest; null where there is none. Values are reduced to a row for each digest before they move, and a digest that many references share is no hot key of the join."""
    refs = cut(refs)
    n = refs.groupBy("digest").agg(F.count("*").alias("n"))
    cols = [c for c in values.columns if c != "digest"]
    one = values.groupBy("digest").agg(*(F.max(c).alias(c) for c in cols))
    return lookup(refs, cut(one.join(n, "digest")), "digest", refs.count(), "left").drop("n")


def with_payloads(seqs: DataFrame, id_col: str, stored: DataFrame) -> DataFrame:
    """Whole sequences with the stored bytes in their place: a row for each row, of id and items of (pos, kind, text, ref, caption, content). content: null for text and where nothing is stored under the reference's digest. Rows that share an id, or have none, stay apart; a row without items keeps none.

    For callers that want the interleaved document itself. Only media references meet the payloads, a digest that many of them share is no hot key, and the texts are shuffled once, whole, by row."""
    rows = cut(seqs.select(id_col, "items").withColumn("_row", F.monotonically_increasing_id()))
    refs = cut(references(rows, "_row").filter("digest <> ''").select("_row", "pos", "digest", F.xxhash64("_row", "pos").alias("_deal")))
    counts = refs.groupBy("digest").agg(F.count("*").alias("n"))
    one = stored.select("digest", "content").join(counts.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    found = salted(refs, one, "digest", counts, refs.count(), "_deal").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "content"))).alias("_found"))
    fields = ("pos", "kind", "text", "ref", "caption")
    filled = F.transform("items", lambda m: F.struct(*(m[f].alias(f) for f in fields), F.try_element_at("_found", m["pos"]).alias("content")))
    return rows.join(found.hint("shuffle_merge"), "_row", "left").select(id_col, filled.alias("items"))


def as_page(text: Column, digest: Column, caption: Column) -> Column:
    """A text as HTML: its lines as paragraphs, its payload as a captioned figure after them."""
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<article><p>"), F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit('</p><figure><img src="sha256:'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure></article>"))


def document_media(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> a row for each: its payload stored as a grey map, read back, and resolved through the page that refers to it.

    Null or empty text: 192 blanks. Equal texts: equal values. Null doc_id, repeated rows: each row gets its result. Empty table: empty result. Other columns are ignored."""
    spark = docs.sparkSession
    body = payload(F.col("text"))
    made = docs.select("doc_id", "text", F.octet_length(utf8(F.col("text"))).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("digest"), greymap(body).alias("content"))
    stored = store(made, scratch(spark, "media"))
    caption = F.concat(F.lit("text of "), F.col("n_bytes").cast("string"), F.lit(" bytes"))
    pages = made.select("doc_id", "n_bytes", as_page(F.col("text"), F.col("digest"), caption).alias("html"))
    refs = references(sequences(pages, "doc_id", ("n_bytes",)), "doc_id", ("n_bytes",))
    return resolve(refs, inspect(stored))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
