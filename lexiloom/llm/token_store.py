"""Token-ID output: sorted-string-table shards of token ids, written and read by Spark's own file sources.

A shard file holds documents in ascending key order:

    block*   entry = shared-prefix length (1 byte), suffix length (1), suffix, value length (4), value
    index    entry = key length (1), first key of the block, block offset (4), block length (4)
    Bloom    bit array over the shard's keys
    meta     JSON: dealt part, shard number, documents, tokens, id width, Bloom probes
    footer   lengths of index, Bloom filter and meta (3 x 4 bytes), magic number

The magic number ends with a line feed: Spark's text writer puts one after each row, and with one row a file that is
the last byte of the format. So shards go through Spark's commit protocol to any store it can write, and come back
through its binaryFile source; no task opens a path itself.

A catalogue beside the shards (parquet: file, part, shard, documents, tokens, first_id, last_id) is read off their footers
and indexes. A lookup reads the catalogue, then only the shards whose id range holds an asked id.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import shared_dir, slices

MAGIC = b"LXSSTAB1\n"
CATALOGUE = "_catalogue"
BLOCK_BYTES = 32 << 10
SHARD_BYTES = 8 << 20
BLOOM_BITS, BLOOM_PROBES = 10, 7
#: Entries of a worker's caches of encoded words and pre-tokens; a cache starts anew when it is full.
CACHED_WORDS, CACHED_TOKENS = 200_000, 700_000


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort like the ids, null first."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _probes(key: bytes, bits: int, probes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(probes)]


class ShardWriter:
    def __init__(self) -> None:
        self.body, self.block, self.index, self.keys, self.last, self.tokens = bytearray(), bytearray(), bytearray(), [], b"", 0

    def add(self, key: bytes, value: bytes, tokens: int) -> None:
        if not self.block:
            self.first, self.last = key, b""
        shared = next((i for i, (x, y) in enumerate(zip(key, self.last)) if x != y), min(len(key), len(self.last)))
        self.block += bytes((shared, len(key) - shared)) + key[shared:] + struct.pack("<I", len(value)) + value
        self.last = key
        self.keys.append(key)
        self.tokens += tokens
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.index += bytes((len(self.first),)) + self.first + struct.pack("<II", len(self.body), len(self.block))
            self.body += self.block
            self.block = bytearray()

    def size(self) -> int:
        return len(self.body) + len(self.block)

    def close(self, part: int, shard: int, width: int) -> bytes:
        """The whole file but for the last byte."""
        self.flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        for k in set(self.keys):
            bloom[_probes(k, bits, BLOOM_PROBES)] = True
        packed = np.packbits(bloom).tobytes()
        meta = json.dumps({"part": part, "shard": shard, "documents": len(self.keys), "tokens": self.tokens, "width": width, "bits": bits, "probes": BLOOM_PROBES}).encode()
        return bytes(self.body) + bytes(self.index) + packed + meta + struct.pack("<III", len(self.index), len(packed), len(meta)) + MAGIC[:-1]


class Shard:
    """Reads one file: iteration in order, or get() by Bloom filter, then binary search of the block index."""

    def __init__(self, data: bytes) -> None:
        if data[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard: wrong magic number")
        end = len(data) - len(MAGIC) - 12
        n_index, n_bloom, n_meta = struct.unpack_from("<III", data, end)
        self.meta = json.loads(data[end - n_meta : end])
        self.bloom = data[end - n_meta - n_bloom : end - n_meta]
        at = stop = end - n_meta - n_bloom
        at -= n_index
        self.data, self.blocks = memoryview(data), []
        while at < stop:
            n = data[at]
            self.blocks.append((bytes(data[at + 1 : at + 1 + n]), *struct.unpack_from("<II", data, at + 1 + n)))
            at += 9 + n

    def _entries(self, block: int) -> Iterator[tuple[bytes, memoryview]]:
        _, at, length = self.blocks[block]
        end, key = at + length, b""
        while at < end:
            shared, n = self.data[at], self.data[at + 1]
            key = key[:shared] + bytes(self.data[at + 2 : at + 2 + n])
            at += 2 + n
            (size,) = struct.unpack_from("<I", self.data, at)
            yield key, self.data[at + 4 : at + 4 + size]
            at += 4 + size

    def last_key(self) -> bytes:
        key = b""
        for key, _ in self._entries(len(self.blocks) - 1):  # noqa: B007
            pass
        return key

    def __iter__(self) -> Iterator[tuple[bytes, memoryview]]:
        for i in range(len(self.blocks)):
            yield from self._entries(i)

    def ids(self, value: memoryview) -> np.ndarray:
        return np.frombuffer(_codec()[1].decompress(bytes(value)), f"<u{self.meta['width']}")

    def get(self, key: bytes) -> list[np.ndarray]:
        """The token ids of every document under key (ids may be repeated)."""
        bits = self.meta["bits"]
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, bits, self.meta["probes"])):
            return []
        out: list[np.ndarray] = []
        for i in range(max(0, bisect.bisect_left(self.blocks, (key,)) - 1), len(self.blocks)):
            if self.blocks[i][0] > key:
                break
            out += [self.ids(v) for k, v in self._entries(i) if k == key]
        return out


@lru_cache(1)
def _codec() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


#: Code points outside these ranges are not all of one class to the pattern's engine and to the library (letters that later
#: versions of Unicode brought); inside them, each was compared in words, behind digits and before 's.
UNCHECKED = re.compile("[^\0-\u0557\u1e00-\u208e\u20a0-\ua7cd\uac00-\uffff\U0001f000-\U0001faff]")


class WordEncoder:
    """Byte-level BPE by the tokenizers library's model, a pre-token at a time and cached as little-endian 32-bit ids.

    A space between two non-blank characters always starts a pre-token, so texts are cut there and each word is encoded
    once; texts with other runs of blanks are cut by the full pattern. Words of letters with punctuation behind them
    need no pattern either. A text that holds the string of an added token goes to the library whole, which matches those
    tokens before it cuts, and so does one with an UNCHECKED code point.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.find = self.library.model, regex.compile(pattern).findall
        self.added = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        bytes_as = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        tokenize, find = self.model.tokenize, self.find
        blank = chr(bytes_as[32])

        class Tokens(dict):
            def __missing__(self, word: str) -> bytes:
                mapped = blank + word[1:] if word[:1] == " " and word[1:].isalpha() and word.isascii() else word.encode().decode("latin-1").translate(bytes_as)
                out = self[word] = array("I", [t.id for t in tokenize(mapped)]).tobytes()
                return out

        tokens = self.tokens = Tokens()

        class Words(dict):
            def __missing__(self, word: str) -> bytes | None:
                core = word.rstrip(".,;:!?#$%&*)")
                if core.isalpha():
                    out = tokens[" " + core] + (tokens[word[len(core) :]] if len(core) < len(word) else b"")
                elif not word or word[0].isspace() or word[-1].isspace():
                    out = None
                else:
                    out = b"".join([tokens[t] for t in find(" " + word)])
                self[word] = out
                return out

        self.words = Words()

    def of(self, text: str) -> bytes:
        return b"".join([self.tokens[t] for t in self.find(text)])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers."""
        if any(t in text for t in self.added) or not text.isascii() and UNCHECKED.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        if len(self.tokens) > CACHED_TOKENS:
            self.tokens.clear()
        first, _, rest = text.partition(" ")
        if not first or first[-1].isspace() or not rest:
            return self.of(text)
        try:
            return self.of(first) + b"".join(map(self.words.__getitem__, rest.split(" ")))
        except TypeError:  # a word that is empty or has blanks at its ends
            return self.of(text)


@lru_cache(2)
def encoder(path: str, pattern: str) -> WordEncoder:
    return WordEncoder(path, pattern)


def write_shards(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every text, append end_id and write shards under path in ascending id order.

    Null and empty texts are the end id alone. Null ids come first. Repeated ids stay, dealt by a hash where one id fills
    several parts, else in order of their ids' bytes. Other columns are not read. An empty table writes no shard and an
    empty catalogue.

    Part bounds are quantiles of the id column alone, as longs: ids of any size keep their order. Texts are encoded where
    they are read; what moves is ids (16 bits where the vocabulary allows, compressed), once. A part makes as many shards
    as its bytes need.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else None
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, squeeze, bounds, end = encoder(tokenizer, pattern), _codec()[0], np.array(cuts or [], np.int64), np.array([end_id], "<u4").tobytes()
        for b in slices(batches, "_text"):
            values, sizes = [], []
            for text in b.column(1).to_pylist():
                ids = np.frombuffer((enc.encode(text) if text else b"") + end, "<u4")
                wide = int(ids.max()) > 0xFFFF
                values.append(squeeze.compress(ids.tobytes() if wide else ids.astype("<u2").tobytes()))
                sizes.append(len(ids) << 1 | wide)
            at = b.column(0).fill_null(0).to_numpy()
            lo, hi = np.searchsorted(bounds, at, "left"), np.searchsorted(bounds, at, "right")
            part = lo + np.array([zlib.crc32(v) for v in values], np.int64) % (hi - lo + 1)
            part[b.column(0).is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.record_batch([b.column(0), pa.array(part.astype(np.int32)), pa.array(sizes, pa.int64()), pa.array(values, pa.binary())], ["_id", "_part", "_size", "_ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part, shard, width = ShardWriter(), None, 0, 2
        out = lambda: pa.record_batch([pa.array([writer.close(part, shard, width)], pa.binary())], ["shard"])
        for b in batches:
            for doc_id, p, size, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = 4 if size & 1 else 2
                if writer.keys and (p != part or w != width or writer.size() >= shard_bytes):
                    yield out()
                    shard = shard + 1 if p == part else 0
                    writer = ShardWriter()
                part, width = p, w
                writer.add(key_of(doc_id), ids, size >> 1)
        if writer.keys:
            yield out()

    ids = d.mapInArrow(encode, "_id long, _part int, _size long, _ids binary")
    dealt = ids.repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", F.col("_id").asc_nulls_first(), "_ids")
    shards = dealt.mapInArrow(pack, "shard binary")
    shards.select(F.col("shard").cast("string")).write.option("maxRecordsPerFile", 1).mode("append").text(path)
    _catalogue(spark, path).write.mode("overwrite").parquet(f"{path}/{CATALOGUE}")


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, content) of shard files. A writer without rows may leave a file without bytes, which is no shard."""
    return spark.read.format("binaryFile").load(list(paths)).where(F.col("length") > 0).select("path", "content")


def _catalogue(spark: SparkSession, path: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, x in zip(b.column(0), b.column(1), strict=True):
                s = Shard(x.as_py())
                row = [s.meta["part"], s.meta["shard"], s.meta["documents"], s.meta["tokens"], id_of(s.blocks[0][0]), id_of(s.last_key())]
                yield pa.record_batch([pa.array([file.as_py()]), *(pa.array([v], pa.int64()) for v in row)], ["file", "part", "shard", "documents", "tokens", "first_id", "last_id"])

    return _files(spark, path).mapInArrow(read, "file string, part long, shard long, documents long, tokens long, first_id long, last_id long")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, shard, documents, tokens, first_id, last_id): a row a shard; null ids come before all others."""
    return spark.read.schema("file string, part long, shard long, documents long, tokens long, first_id long, last_id long").parquet(f"{path}/{CATALOGUE}")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, pos, doc_id, n_tokens, ids_crc32): a row per stored document; none of an empty store. crc32 of the ids as little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                s, rows = Shard(x.as_py()), []
                for i, (key, value) in enumerate(s):
                    ids = s.ids(value)
                    rows.append((s.meta["part"], s.meta["shard"], i, id_of(key), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["part", "shard", "pos", "doc_id", "n_tokens", "ids_crc32"])

    return _files(spark, path).select("content").mapInArrow(read, "part long, shard long, pos long, doc_id long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the asked documents, a row for each stored document under such an id; unknown ids have none.

    The catalogue tells which shards may hold an asked id; only those files are read, each through its Bloom filter and block
    index. What comes to the driver is a file name for each shard in question, at most as many as ids asked unless ids are
    repeated over shards. The list of ids travels with the task.
    """
    kind = "doc_id long, ids array<int>"
    asked = sorted(set(doc_ids))
    keys = [(i, key_of(i)) for i in asked]
    ids = spark.createDataFrame([(i,) for i in asked], "_id long")
    ranges = catalogue(spark, path).withColumn("_from", F.coalesce("first_id", F.lit(-(1 << 63))))
    files = [r["file"] for r in ranges.join(F.broadcast(ids), F.col("_id").between(F.col("_from"), F.col("last_id")), "left_semi").select("file").collect()]
    if not files:
        return spark.createDataFrame([], kind)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                s = Shard(x.as_py())
                hits = [(i, ids.astype(np.int32)) for i, k in keys for ids in s.get(k)]
                yield pa.record_batch([pa.array([i for i, _ in hits], pa.int64()), pa.array([v for _, v in hits], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _files(spark, *files).select("content").mapInArrow(find, kind)


def index_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; start: ids of all documents before, over all shards.

    Tokens before each part come from the catalogue (a sum per part, as many rows as parts, in the driver); within a part a
    window adds up. An empty store gives an empty result.
    """
    from pyspark.sql import Window

    rows = read_shards(spark, path)
    base, at = {}, 0
    for r in sorted(catalogue(spark, path).groupBy("part").agg(F.sum("tokens").alias("n")).collect(), key=lambda r: r["part"]):
        base[r["part"]], at = at, at + r["n"]
    bases = spark.createDataFrame(list(base.items()), "part long, base long")
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard", "pos").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.coalesce(before, F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def new_path(spark: SparkSession, label: str = "shards") -> str:
    return f"{shared_dir(spark)}/lexiloom/{label}-{uuid.uuid4().hex}"
