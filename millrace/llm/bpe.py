"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Every task splits its texts into pre-tokens and numbers them: a block of texts becomes the list of
   its distinct words and, in order of position, the number of each word. The numbers are ranks by
   frequency, which pack small; both parts are written once to the shared folder.
2. The distinct words of all blocks are shuffled by a hash of the word, in packs, so that all mentions
   of a word meet in one task, which encodes it once and sends its ids back to the blocks.
3. Each block joins the ids to its positions again and puts the texts' ids together.

Only words and numbers are shuffled: a word as often as there are blocks that hold it, however often
it occurs, so neither a frequent word nor a large source makes a hot key. A block holds `BLOCK_BYTES`
of text or one longer text. Decoding joins each position's id to the token-byte table, which the vocabulary
bounds: ids are places in it, so the join is a positional one in every task, without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from .common import Splitter, in_arrow, prepare, release, spare, stored, texts

BLOCK_BYTES = 32 << 20
#: Ways to deal the distinct words at most: a block makes a pack for each, so more partitions must not make ever smaller packs.
MOST_BUCKETS = 4096
#: A block's packed positions travel in slices of this many bytes, as rows with buckets -1, -2, ...
SLICE = 128 << 10
_loaded: dict = {}


def ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a rank file: lines of base64 bytes and a rank."""
    if ("ranks", path) not in _loaded:
        with open(path, "rb") as f:
            _loaded["ranks", path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return _loaded["ranks", path]


def _coder(path: str, pattern: str):
    import tiktoken

    if ("coder", path) not in _loaded:
        _loaded["coder", path] = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
    return _loaded["coder", path]


def pack(parts: list[bytes]) -> bytes:
    """Byte strings as one compressed string; takes them out of the list."""
    size = np.fromiter(map(len, parts), np.uint32, len(parts))
    raw = b"".join([np.uint32(len(parts)).tobytes(), size.tobytes(), *parts])
    parts.clear()
    return zstandard.ZstdCompressor(9).compress(raw)


def unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)
    ends = ends.tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


def pack_words(words: list[bytes], shared: np.ndarray) -> bytes:
    """Sorted words without the bytes, given by their number, that each shares with the one before."""
    rest = [w[k:] for w, k in zip(words, shared.tolist(), strict=True)]
    return pack([shared.astype(np.uint8).tobytes(), *_planes(np.fromiter(map(len, rest), np.uint32, len(rest))), b"".join(rest)])


def unpack_words(blob: bytes) -> list[bytes]:
    shared, *size, rest = unpack(blob)
    ends = np.cumsum(_from_planes(size), dtype=np.int64)
    out, last, at = [], b"", 0
    for k, end in zip(shared, ends.tolist(), strict=True):
        last = last[:k] + rest[at:end]
        out.append(last)
        at = end
    return out


def _shared(words: list[bytes]) -> np.ndarray:
    """How many of its first 16 bytes each word shares with the one before."""
    if not words:
        return np.zeros(0, np.int64)
    head = np.array(words, "S16").view(np.uint8).reshape(len(words), 16)
    same = np.cumprod(head[1:] == head[:-1], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.concatenate([[0], np.minimum(same, np.minimum(size[1:], size[:-1]))])


#: Byte strings that _planes() makes of numbers.
PLANES = 5


def _planes(x: np.ndarray) -> list[bytes]:
    """The bytes of numbers by significance, highest first; the lowest bytes of numbers under 256 apart from the others."""
    raw = np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4)
    small = ~raw[:, 1:].any(1)
    return [*(raw[:, k].tobytes() for k in (3, 2, 1)), raw[small, 0].tobytes(), raw[~small, 0].tobytes()]


def _from_planes(parts: list[bytes]) -> np.ndarray:
    high = [np.frombuffer(p, np.uint8) for p in parts]
    raw = np.zeros((len(high[0]), 4), np.uint8)
    raw[:, 3], raw[:, 2], raw[:, 1] = high[:3]
    small = ~raw.any(1)
    raw[small, 0], raw[~small, 0] = high[3], high[4]
    return raw.reshape(-1).view("<u4")


class _Numbers(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Block:
    def __init__(self, split, buckets: int):
        self.split, self.buckets, self.number, self.rows, self.counts, self.size = split, buckets, _Numbers(), [], [], 0

    def add(self, key, text: str) -> None:
        words = self.split.findall(text)
        self.rows.append(key)
        self.counts.append(np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words)))
        self.size += len(text)

    def parts(self) -> tuple[int, list, bytes, dict[int, bytes]]:
        """(block id from the content, row keys, packed positions, packed words of each bucket)."""
        import xxhash

        words = [w.encode() for w in self.number]
        self.number.clear()
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % self.buckets
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]  # by bucket, then by word
        sizes, flat = np.fromiter(map(len, self.counts), np.uint32, len(self.counts)), np.concatenate([np.zeros(0, np.uint32), *self.counts])
        self.counts.clear()
        often = np.bincount(flat, minlength=len(words))[order]
        rank = np.empty(len(words), np.uint32)
        rank[order[np.argsort(-often, kind="stable")]] = np.arange(len(words), dtype=np.uint32)
        flat = rank[flat]
        blob = pack([*_planes(sizes), *_planes(often), *_planes(flat)])
        del flat, rank, often
        packs, edges = {}, np.searchsorted(bucket[order], np.arange(self.buckets + 1)).tolist()
        words = [words[i] for i in order]
        shared = _shared(words)
        for k in range(self.buckets):
            if edges[k] < edges[k + 1]:
                shared[edges[k]] = 0
                packs[k] = pack_words(words[edges[k] : edges[k + 1]], shared[edges[k] : edges[k + 1]])
        own = xxhash.xxh64(blob + repr(self.rows).encode())
        for k, pack_ in packs.items():  # equal ids and structure with other words are another block
            own.update(k.to_bytes(4, "little") + pack_)
        return int(np.uint64(own.intdigest()).view(np.int64)), self.rows, blob, packs


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id, ids array<int>) for every row: each match of pattern is encoded separately, without special tokens.

    A null or empty text has no ids; rows with a null or repeated id, of any type that Arrow holds, come back
    as they are; an empty table gives no rows; other columns are ignored, so their names don't matter. A very
    long text is a block of its own and is encoded whole. Of pairs with equal rank the first is merged.
    buckets: how many ways the distinct words are dealt, `MOST_BUCKETS` at most.
    """
    spark = prepare(df.sparkSession)
    buckets = buckets or min(MOST_BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = texts(df, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    kind = docs.schema[0].dataType.simpleString()
    arrow_id = to_arrow_type(docs.schema[0].dataType)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(pattern)
        names = ["block", "bucket", "body", "ids"]

        def give(b: _Block) -> Iterator[pa.RecordBatch]:
            block, rows, blob, packs = b.parts()
            parts = {-1 - k: blob[at : at + SLICE] for k, at in enumerate(range(0, len(blob), SLICE))} | packs
            for at in range(0, len(parts), 64):
                some = list(parts)[at : at + 64]
                keys = pa.array([rows if k == -1 else None for k in some], pa.list_(arrow_id))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some)), pa.array(some, pa.int32()), pa.array([parts[k] for k in some]), keys], names=names)

        now = _Block(split, buckets)
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                now.add(key, t.as_py().decode("utf-8", "replace") if t.is_valid else "")
                if now.size >= BLOCK_BYTES:
                    yield from give(now)
                    now = _Block(split, buckets)
        if now.rows:
            yield from give(now)
        del now
        release()

    parts = stored(docs.mapInArrow(blocks, f"block long, bucket int, body binary, ids array<{kind}>"), "bpe-blocks")

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, known = _coder(path, pattern), {}
        for b in batches:
            out = []
            for body in b.column("body"):
                got = []
                for w in unpack_words(body.as_py()):
                    if (ids := known.get(w)) is None:
                        if len(known) >= 500_000:  # bounds memory only
                            known.clear()
                        known[w] = ids = np.array(coder._encode_single_piece(w), "<u4")
                    got.append(ids)
                flat = np.concatenate(got)
                out.append(pack([*_planes(np.fromiter(map(len, got), np.uint32, len(got))), *_planes(flat)]))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "ids"])
        known.clear()
        release()

    words = parts.where("bucket >= 0").select("block", "bucket", "body").repartition(buckets, "bucket")
    coded = words.mapInArrow(encode_words, "block long, bucket int, ids binary")

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        packs = dict(zip(right.column("bucket").to_pylist(), right.column("ids"), strict=True))
        size, flat = [np.zeros(0, "<u4")], [np.zeros(0, "<u4")]
        for k in sorted(packs):
            p = unpack(packs[k].as_py())
            size.append(_from_planes(p[:PLANES]))
            flat.append(_from_planes(p[PLANES:]))
        del packs
        size, flat = np.concatenate(size).astype(np.int64), np.concatenate(flat).astype(np.int32)
        start = np.cumsum(size) - size
        out, keys, lists, waiting = [], [], [], 0
        schema = pa.schema([("id", arrow_id), ("ids", pa.list_(pa.int32()))])

        def give() -> None:
            ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
            out.append(pa.RecordBatch.from_arrays([pa.array(keys, arrow_id), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))], schema=schema))
            keys.clear()
            lists.clear()

        # equal blocks of equal rows have one id: their slices are the same, and each has a list of ids
        slices = dict(zip(left.column("bucket").to_pylist(), left.column("body"), strict=True))
        p = unpack(b"".join(slices[k].as_py() for k in sorted(slices, reverse=True)))
        del slices
        for rows in filter(None, left.column("ids").to_pylist()):
            lens, often, rank = (_from_planes(p[a : a + PLANES]) for a in (0, PLANES, 2 * PLANES))
            if len(often) != len(size):
                raise RuntimeError(f"a block of {len(often)} words got the ids of {len(size)}")
            at = np.argsort(-often.astype(np.int64), kind="stable").astype(np.int32)  # rank -> place in the packs
            ends = np.cumsum(lens, dtype=np.int64)
            for k, a, b in zip(rows, (ends - lens).tolist(), ends.tolist(), strict=True):
                w = at[rank[a:b]]
                n, total = size[w], int(size[w].sum())
                lists.append(flat[np.repeat(start[w] - (np.cumsum(n) - n), n) + np.arange(total)])
                keys.append(k)
                waiting += total
                if waiting >= 1 << 20:
                    give()
                    waiting = 0
        give()
        release()
        return pa.Table.from_batches(out, schema)

    bodies = parts.where("bucket < 0").select("block", "bucket", "ids", "body")
    return bodies.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(reassemble, f"id {kind}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary): the tokens' bytes in order; null or no ids give no bytes, an unknown id is an error."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = _bytes_of(path)
        out = [b"".join(map(table.__getitem__, x.values.to_pylist())) if x.is_valid else b"" for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    it = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return in_arrow(it, run, f"id {it.schema[0].dataType.simpleString()}, bytes binary")


def _bytes_of(path: str) -> list[bytes]:
    if ("bytes", path) not in _loaded:
        table = [b""] * (max(ranks(path).values()) + 1)
        for k, v in ranks(path).items():
            table[v] = k
        _loaded["bytes", path] = table
    return _loaded["bytes", path]


def digests(coded: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of the rows of encode(), with `ids` too if keep_ids: the ids are decoded by the token-byte table.

    No ids, or null: the digests of no bytes. Repeated rows come back as often."""
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if keep_ids else [])

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = _bytes_of(path)
        if ("decimal", path) not in _loaded:
            _loaded["decimal", path] = [str(k).encode() for k in range(len(table))]
        decimal, n, ids_sha, text_sha = _loaded["decimal", path], [], [], []
        for x in b.column(1):
            ids = x.values.to_numpy().tolist() if x.is_valid else []
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
            text_sha.append(hashlib.sha256(b"".join(map(table.__getitem__, ids))).hexdigest())
        columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        yield pa.RecordBatch.from_arrays(columns + ([b.column(1)] if keep_ids else []), names=names)

    it = coded.select("id", "ids")
    kinds = f"id {it.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return in_arrow(it, run, kinds)


def with_counts(df: DataFrame, path: str, pattern: str, count_col: str, text_col: str = "text") -> DataFrame:
    """df with count_col, the number of each whole text's tokens (0 for a null text): pre-tokens are encoded once a worker."""
    bytes_col = spare(df, "text_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, split, known = _coder(path, pattern), Splitter(pattern), {}
        for b in batches:
            n = []
            for t in b.column(b.num_columns - 1):
                total = 0
                for w in split.findall(t.as_buffer().to_pybytes().decode("utf-8", "replace")) if t.is_valid else ():
                    if (k := known.get(w)) is None:
                        if len(known) >= 500_000:  # bounds memory only
                            known.clear()
                        known[w] = k = len(coder._encode_single_piece(w.encode()))
                    total += k
                n.append(total)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], count_col])
        known.clear()
        release()

    prepare(df.sparkSession)
    kinds = StructType([*df.schema.fields, StructField(count_col, LongType())])
    return df.withColumn(bytes_col, F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, kinds)
