"""Token ids as binary files with Elias-Fano coded document boundaries.

Documents are range-partitioned by id, encoded, and packed into segments. A segment is one self-contained blob: a
header, the boundaries of its documents in the concatenated id array as an Elias-Fano sequence with a sampled select
directory, and the ids, 16 or 32 bits each. Segments are rows of a Parquet folder, so Spark's commit protocol makes a
lost task harmless and any file system that Spark can write to will do. A document never spans segments; a segment
closes once it has SEGMENT ids.

Blob: 8-byte magic; little-endian u32 x 8: documents, ids, bytes an id, low bits, words of the low part, words of the
high part, select samples, 0; then u64 words of the low bits, u64 words of the high bits, u32 select samples (the place of every
SELECT-th one bit), ids.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import released, scratch_path, text_bytes

MAGIC, HEAD = b"VLTOKEN1", struct.Struct("<8s8I")
#: Ids after which a segment closes, and one bits between select samples.
SEGMENT, SELECT = 1 << 20, 256
#: Bytes of a text that part rows of equal ids.
PREFIX = 64
#: Words whose ids a worker remembers; a cache only, results don't depend on it.
CACHE = 200_000
#: crc32 of the normalizer and pre-tokenizer of vocabularies whose cuts WordEncoder knows.
_LATIN_RULES = 0xc78c5cde
#: Letters whose lower case is one letter and which no normal form changes; digits; marks but ' and those of special tokens.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0137\u0139-\u0148\u014c-\u017e"
_MARKS = r"!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~"
_LATIN = re.compile(f"[{_LETTERS}0-9{_MARKS}]+")
_CUT = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")


def _byte_chars() -> dict[int, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 for itself, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(largest / length) bits each."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(-(-n * bits // 64) + 1, np.uint64)
        if bits:
            flags = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
            packed = np.packbits(flags, bitorder="little")
            low.view(np.uint8)[: len(packed)] = packed
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(places[-1]) // 64 + 1) if n else 0, np.uint64)
        np.bitwise_or.at(high, places // 64, np.uint64(1) << (places % 64).astype(np.uint64))
        return cls(n, bits, low, high, places[::SELECT].astype(np.uint32))

    def _low(self, i: int) -> int:
        word, shift = divmod(i * self.bits, 64)
        two = int(self.low[word]) >> shift
        if shift + self.bits > 64:
            two |= int(self.low[word + 1]) << (64 - shift)
        return two & ((1 << self.bits) - 1)

    def select(self, i: int) -> int:
        """Value i: from the nearest sample on, words of the high part are skipped by their bit counts."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, left = int(self.samples[i // SELECT]), i % SELECT
        word = start // 64
        w = int(self.high[word]) >> (start % 64) << (start % 64)
        while (c := w.bit_count()) <= left:
            left -= c
            word += 1
            w = int(self.high[word])
        for _ in range(left):
            w &= w - 1
        return ((word * 64 + (w & -w).bit_length() - 1 - i) << self.bits) | (self._low(i) if self.bits else 0)


def write_segment(pieces: list[bytes], ends: list[int]) -> bytes:
    """A segment of documents given as little-endian uint32 ids, and where each ends in the joined ids."""
    ids = np.frombuffer(b"".join(pieces), "<u4")
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    ef = EliasFano.of(np.array([0, *ends]))
    head = HEAD.pack(MAGIC, len(ends), len(ids), width, ef.bits, len(ef.low), len(ef.high), len(ef.samples), 0)
    return b"".join((head, ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), ids.astype(f"<u{width}").tobytes()))


class Segment:
    """A segment read from its blob: document i is ids[boundaries.select(i) : boundaries.select(i + 1)]."""

    def __init__(self, blob: bytes):
        magic, self.n, n_ids, width, bits, low, high, samples, _ = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD.size
        parts = []
        for n, kind in ((low, "<u8"), (high, "<u8"), (samples, "<u4"), (n_ids, f"<u{width}")):
            parts.append(np.frombuffer(blob, kind, n, at))
            at += parts[-1].nbytes
        self.boundaries = EliasFano(self.n + 1, bits, *parts[:3])
        self.ids = parts[3]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.boundaries.select(i) : self.boundaries.select(i + 1)]


class _Known(dict):
    """Ids of words; asks the encoder for those it doesn't have."""

    def __init__(self, ask):
        self.ask = ask

    def __missing__(self, word: bytes) -> bytes:
        return self.ask(word)


class WordEncoder:
    """Ids of texts by the tokenizers library.

    For a vocabulary with the rules that this class knows, texts are encoded word by word: those rules drop white space and
    never join what stands on both its sides, so the ids of a text are those of its words in a row, and words seen before
    need not be encoded again. A word of plain Latin letters, digits and punctuation is cut where the rules cut it (runs
    of letters, single digits, runs of marks) and its pieces go to the library's model; any other word goes through the
    library's whole pipeline. For any other vocabulary the library encodes the whole text at once.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        with open(path, encoding="utf-8") as f:
            rules = {k: v for k, v in json.load(f).items() if k in ("normalizer", "pre_tokenizer")}
        self.plain = zlib.crc32(json.dumps(rules, sort_keys=True).encode()) == _LATIN_RULES
        self.model = self.tokenizer.model
        # words seen at least twice, words seen lately, pieces of words
        self.known = _Known(self.word)
        self.young: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, p: str) -> bytes:
        ids = self.pieces.get(p)
        if ids is None:
            text = p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_CHARS)
            ids = array("I", [t.id for t in self.model.tokenize(text)])
            if sys.byteorder == "big":
                ids.byteswap()
            ids = ids.tobytes()
            if len(self.pieces) >= self.cache // 2:
                self.pieces.clear()
            self.pieces[p] = ids
        return ids

    def word(self, w: bytes) -> bytes:
        ids = self.young.get(w)
        if ids is not None:
            if len(self.known) < self.cache:
                self.known[w] = ids
            return ids
        s = w.decode("utf-8", "replace")
        ids = b"".join(map(self._piece, _CUT.findall(s.lower()))) if _LATIN.fullmatch(s) else self.whole(s)
        if len(self.young) >= self.cache // 2:
            self.young.clear()
        self.young[w] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Little-endian uint32 ids."""
        return b"".join(map(self.known.__getitem__, text.split())) if self.plain else self.whole(text.decode("utf-8", "replace"))

    def whole(self, s: str) -> bytes:
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_token_ids(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int | None = 2, segment: int = SEGMENT, partitions: int | None = None) -> None:
    """Encodes every row of docs and writes the segments, in ascending doc_id order, to the folder `path`.

    tokenizer: a file name of public_tokenizers, looked up where it is used. end_id is put after each document; None
    puts none. Null texts are empty. Null ids come first; rows with equal ids follow each other in order of their text.
    An empty table writes an empty folder. Extra columns aren't read. A document may have up to about 500 million ids. Rows
    are parted by id and the first characters of the text, so equal or null ids don't all meet in one task unless their
    texts begin alike.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path(tokenizer)).encode
        part, seq, names = TaskContext.get().partitionId(), 0, []
        pieces, ends, size = [], [], 0

        def close():
            nonlocal seq, pieces, ends, size, names
            keys = pa.concat_arrays(names)
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([size], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([write_segment(pieces, ends)], pa.binary())]
            seq, pieces, ends, size, names = seq + 1, [], [], 0, []
            return pa.RecordBatch.from_arrays(row, names=["part", "seq", "n_ids", "doc_ids", "segment"])

        for b in batches:
            first = 0
            for n, t in enumerate(b.column(1)):
                ids = encode(t.as_py()) + end
                pieces.append(ids)
                size += len(ids) // 4
                ends.append(size)
                if size >= segment:
                    names.append(b.column(0).slice(first, n + 1 - first))
                    first = n + 1
                    yield close()
            if first < b.num_rows:
                names.append(b.column(0).slice(first))
        if ends:
            yield close()

    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select("doc_id", text_bytes().alias("_x")).repartitionByRange(count, F.col("doc_id").asc_nulls_first(), F.substring("_x", 1, PREFIX))
    d = d.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_x")
    d.mapInArrow(released(run), f"part int, seq long, n_ids long, doc_ids array<{kind}>, segment binary").write.parquet(path)


def read_token_ids(spark, path: str, kind: str = "bigint") -> DataFrame:
    """One row a document from the segments at `path`: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian uint32)."""
    schema = f"part int, seq long, n_ids long, doc_ids array<{kind}>, segment binary"
    segments = spark.read.schema(schema).parquet(path)

    def run(batches):
        for b in batches:
            for n in range(b.num_rows):
                s = Segment(b.column(3)[n].as_py())
                at = np.fromiter(map(s.boundaries.select, range(s.n + 1)), np.int64, s.n + 1)
                crc = [zlib.crc32(s.ids[x:y].astype("<u4")) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                row = [b.column(0).slice(n, 1).take(pa.array(np.zeros(s.n, np.int64))), b.column(1).slice(n, 1).take(pa.array(np.zeros(s.n, np.int64))), b.column(2)[n].values, pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(row, names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    found = segments.select("part", "seq", "doc_ids", "segment").mapInArrow(run, f"part int, seq long, doc_id {kind}, local long, n_tokens long, ids_crc32 long")
    # starts of segments: sums within a part, and over the parts, whose number is fixed
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = segments.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_before"))
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("_within")).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("_within") + F.col("_before")).alias("_start"))
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes docs' token ids to `path` (default: a folder in the cluster's shared one) and reads them back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_token_ids(docs, path, **options)
    return read_token_ids(docs.sparkSession, path, docs.schema["doc_id"].dataType.simpleString())
