"""Operator 9: SentencePiece encoding and decoding, giant documents by a max-plus scan.

The pieces and byte fallback are those of a public SentencePiece model, whose path is a parameter; they are used as a unigram model, so that the encoding of a text is the segmentation of greatest total score. A piece's score follows from its rank by Zipf's rule, in steps of 1 / GRID so that sums are exact.

A text of up to CHUNK characters is encoded where it is. A longer one is dealt out in chunks. For each chunk a transfer matrix holds the best score from every entry state (how many of its first characters a piece from the chunk before has taken) to every exit state (how many characters of the next chunk its last piece takes). Matrices combine associatively under (max, +): they are multiplied in blocks, the blocks are scanned for each document, which gives the states at all boundaries, and then every chunk finds its own pieces between its two states, independently of the others.

No piece runs over the start of a blank after another character, so all paths meet there: between a chunk's first and last such place the score is the same for all states and is left out, and the matrix is made of what lies before and after. A chunk without such a place is worked through whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keep, slices, table

CHUNK = 32_768
SEGMENT = 2_000
"""Characters that the library is given at a time, cut where all paths meet."""
BLOCK = 64
"""Matrices multiplied in one group."""
GRID = 256
BLANK = "\u2581"
STAND_IN = "\ue000"
"""Stands for a BLANK that is in the text itself, which is encoded as bytes like any unknown character; so decoding gives it back."""
UNKNOWN_PENALTY = 10.0
MEET = re.compile(f"(?<=[^{BLANK}]){BLANK}")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(2)
def unigram(model: bytes) -> bytes:
    """The model's vocabulary as a unigram model without changes to the text: no prefix, no lost blanks."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    m.trainer_spec.byte_fallback = True
    m.normalizer_spec.add_dummy_prefix = False
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.escape_whitespaces = True
    normal = [p for p in m.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL]
    whole = math.log(sum(1 / r for r in range(1, len(normal) + 1)))
    for rank, p in enumerate(normal, 1):
        p.score = -round((math.log(rank) + whole) * GRID) / GRID
        if MEET.search(p.piece):
            raise ValueError("a piece runs over the start of a blank")
    return m.SerializeToString()


class Codec:
    """Encoder and decoder of one process."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(proto := unigram(model))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        kinds = pb.ModelProto.SentencePiece
        self.scores = {p.piece: p.score for p in m.pieces if p.type == kinds.NORMAL}
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(BLANK, " ").encode() if p.type == kinds.NORMAL else b"" for p in m.pieces]
        byte_ids = {self.bytes_of[i][0]: i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        self.blank_ids = [byte_ids[b] for b in BLANK.encode()]
        self.prefixes = {s[:i] for s in self.scores for i in range(1, len(s) + 1)}
        self.longest = max(map(len, self.scores))
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        parts: list[str | None] = []
        counts = []
        for t in texts:
            before = len(parts)
            for k, piece in enumerate(t.split(BLANK)):
                if k:
                    parts.append(None)
                at = 0
                while len(piece) - at > SEGMENT:
                    # the last place up to SEGMENT, or else the next, where a blank follows another character
                    end = self._meet(piece, at)
                    parts.append(piece[at:end])
                    at = end
                if at < len(piece):
                    parts.append(piece[at:])
            counts.append(len(parts) - before)
        found = iter(self.library.encode([p for p in parts if p is not None], num_threads=1))
        ids = [self.blank_ids if p is None else next(found) for p in parts]
        out, at = [], 0
        for n in counts:
            out.append([x for part in ids[at : at + n] for x in part])
            at += n
        return out

    @staticmethod
    def _meet(text: str, at: int) -> int:
        i = text.rfind(" ", at + 1, at + SEGMENT)
        while i > at and text[i - 1] == " ":
            i -= 1
        if i > at:
            return i
        i = text.find(" ", at + SEGMENT)
        while i > 0 and text[i - 1] == " ":
            j = i
            while j < len(text) and text[j] == " ":
                j += 1
            i = text.find(" ", j)
        return i if i > 0 else len(text)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def score(self, ids: list[int]) -> float:
        return sum(self.library.get_score(i) for i in ids)

    def paths(self, text: str, start: np.ndarray, upto: int) -> np.ndarray:
        """Best scores (entry states x 0..len(text)) of reaching each place of an escaped text, the states' scores at their own places being given in start (states x states); no piece begins at `upto` or later."""
        best = np.full((start.shape[0], len(text) + 1), -np.inf)
        w = min(start.shape[1], len(text) + 1)
        best[:, :w] = start[:, :w]
        for at in range(min(upto, len(text))):
            here = best[:, at]
            single = False
            for end in range(at + 1, min(len(text), at + self.longest) + 1):
                piece = text[at:end]
                if piece not in self.prefixes:
                    break
                if (s := self.scores.get(piece)) is not None:
                    np.maximum(best[:, end], here + s, out=best[:, end])
                    single |= end == at + 1
            if not single:
                np.maximum(best[:, at + 1], here + self.unknown, out=best[:, at + 1])
        return best

    def transfer(self, chunk: str, ahead: str) -> np.ndarray:
        """The chunk's matrix (entry x exit states, each 0..longest-1); ahead: the characters after it, longest - 1 at most."""
        n, L = len(chunk), self.longest
        text = escaped(chunk + ahead)
        start = np.full((L, L), -np.inf)
        np.fill_diagonal(start, 0.0)
        first = next((m.start() for m in MEET.finditer(text, 0, n) if m.start() >= L - 1), None)
        if first is None:
            ends = self.paths(text, start, n)[:, n:]
        else:
            last = n - 1
            while last > first and not (text[last] == BLANK and text[last - 1] != BLANK):
                last -= 1
            pre = self.paths(text[:first], start, first)[:, first]
            tail = self.paths(text[last:], np.zeros((1, 1)), n - last)[:, n - last :]
            ends = pre[:, None] + tail
        out = np.full((L, L), -np.inf)
        out[:, : ends.shape[1]] = ends[:, :L]
        if n < L:  # a last chunk that the piece before may have taken whole, or more than it has
            out[n + 1 :] = -np.inf
        return out


def escaped(text: str) -> str:
    return text.replace(BLANK, STAND_IN).replace(" ", BLANK)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def walk(matrices: list[np.ndarray], entry: int, exit_: int) -> list[int]:
    """The states at the boundaries before each matrix and after the last on the best way from entry to exit_."""
    v = np.full(matrices[0].shape[0], -np.inf)
    v[entry] = 0.0
    ahead = [v]
    for m in matrices:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    states = [exit_]
    for m, v in zip(reversed(matrices), reversed(ahead[:-1]), strict=True):
        states.append(int(np.argmax(v + m[:, states[-1]])))
    return states[::-1]


ENCODED = "doc_id long, n_chars long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean, n_chunks int"


def _result(codec: Codec, doc_ids, texts: list[str | None], ids: list[list[int]], chunks: list[int]) -> pa.RecordBatch:
    back = [codec.decode(x) for x in ids]
    cols = [doc_ids, pa.array([len(t or "") for t in texts], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([hashlib.sha256(b.encode("utf-8", "replace")).hexdigest() for b in back], pa.string()), pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)], pa.bool_()), pa.array(chunks, pa.int32())]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in ENCODED.split(", ")])


def encode(docs: DataFrame, model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, n_tokens, ids, decoded_sha256, round_trip (whether decoding gives the text back), n_chunks.

    Null or empty text: no ids. Null doc_id, repeated rows: each row gets its result. Empty table: empty result. Other columns are ignored. model: path of a SentencePiece model, read by the driver and sent to the tasks (half a megabyte); chunk: at least the longest piece."""
    spark = docs.sparkSession
    with open(model or default_model(), "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    short = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= chunk).select("doc_id", "text")

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            for part in slices(batch, 2 << 20):
                texts = part.column("text").to_pylist()
                yield _result(codec, part.column("doc_id"), texts, codec.encode_all([t or "" for t in texts]), [1] * len(texts))

    giants = keep(docs.filter(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("g"), "doc_id", "text"), "giants")
    ahead = 64

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, t in zip(batch.column("g").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n = -(-len(t) // chunk)
                for lo in range(0, n, 64):
                    at = range(lo, min(n, lo + 64))
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.int64()), pa.array(list(at), pa.int32()), pa.array([n] * len(at), pa.int32()), pa.array([t[i * chunk : (i + 1) * chunk] for i in at]), pa.array([t[(i + 1) * chunk : (i + 1) * chunk + ahead] for i in at])], ["g", "i", "n", "chunk", "ahead"])

    chunks = keep(giants.select("g", "text").mapInArrow(dealt, "g long, i int, n int, chunk string, ahead string").repartition("g", "i"), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            out = [codec.transfer(c, a[: codec.longest - 1]).tobytes() for c, a in zip(batch.column("chunk").to_pylist(), batch.column("ahead").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("i"), pa.array(out, pa.binary())], ["g", "i", "m"])

    def whole(m: bytes) -> np.ndarray:
        a = np.frombuffer(m, np.float64)
        return a.reshape(int(len(a) ** 0.5), -1)

    made = cut(chunks.select("g", "i", "chunk", "ahead").mapInArrow(matrices, "g long, i int, m binary").withColumn("b", F.expr(f"i div {BLOCK}").cast("int")))

    def multiply(key, frame: pd.DataFrame) -> pd.DataFrame:
        ms = [whole(m) for m in frame.sort_values("i").m]
        total = ms[0]
        for m in ms[1:]:
            total = product(total, m)
        return pd.DataFrame({"g": [key[0]], "b": [key[1]], "m": [total.tobytes()]})

    def scan(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("b")
        states = walk([whole(m) for m in frame.m], 0, 0)
        return pd.DataFrame({"g": key[0], "b": frame.b.to_numpy(), "entry": states[:-1], "exit": states[1:]})

    def inside(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("i")
        if not len(left) or not len(right):
            return pd.DataFrame({"g": [], "i": [], "entry": [], "exit": []})
        states = walk([whole(m) for m in left.m], int(right.entry.iloc[0]), int(right.exit.iloc[0]))
        return pd.DataFrame({"g": key[0], "i": left.i.to_numpy(), "entry": states[:-1], "exit": states[1:]})

    blocks = made.groupBy("g", "b").applyInPandas(multiply, "g long, b int, m binary").groupBy("g").applyInPandas(scan, "g long, b int, entry int, exit int")
    states = made.groupBy("g", "b").cogroup(blocks.groupBy("g", "b")).applyInPandas(inside, "g long, i int, entry int, exit int")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            ids = codec.encode_all([t[e:] + a[:x] for t, a, e, x in zip(c["chunk"], c["ahead"], c["entry"], c["exit"], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("i"), pa.array(ids, pa.list_(pa.int32()))], ["g", "i", "ids"])

    traced = chunks.join(states.hint("shuffle_merge"), ["g", "i"]).select("g", "i", "chunk", "ahead", "entry", "exit").mapInArrow(trace, "g long, i int, ids array<int>")
    joined = traced.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("p")).select("g", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.size("p").alias("n"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            for part in slices(batch, 16 << 20):
                yield _result(codec, part.column("doc_id"), part.column("text").to_pylist(), part.column("ids").to_pylist(), part.column("n").to_pylist())

    long_ = giants.join(joined.hint("shuffle_merge"), "g").select("doc_id", "text", "ids", "n").mapInArrow(checked, ENCODED)
    return short.mapInArrow(direct, ENCODED).unionByName(long_)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
