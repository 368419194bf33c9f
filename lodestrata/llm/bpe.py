"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Documents are read in blocks of some megabytes. A block explodes its texts into pre-tokens with
positions and numbers its distinct ones; the positions stay with the block as those numbers, and the
distinct pre-tokens go out by hash. Each hash bucket merges each of its distinct pre-tokens once, for
all blocks, all words of the bucket abreast (Merges), and the ids go back to the blocks, which put
them together by position. So the shuffle holds a word once per block, not once per occurrence.
Decoding joins ids with the table of token bytes: an Arrow column whose size the vocabulary bounds,
taken from by id, whose bytes then lie end to end in the order of positions. (Tokens as rows of a Spark
join would be shuffled back to their documents one by one, some hundred million at 0.5 GB.)

Blocks and words leave their first stage through one exchange that both later stages read: words are
grouped from it, blocks meet their ids in it. A block checks that all its words came back.

Defined results: a null text counts as empty and has no ids. Ids of documents may be null or repeat:
rows stay apart. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .chunks import Chunks
from .common import buckets_of, fields, pack, pack_words, table, unpack, unpack_words

#: Characters of text in a block, about, for up to 256 buckets; in proportion for more, up to eight times that.
#: A longer text makes a longer block of its own.
BLOCK_CHARS = 1 << 23
BLOCK, WORDS = 0, 1
#: Bytes of a word that is merged alone, by a heap.
ALONE = 512
#: Above every rank.
NONE = 1 << 40


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Merges:
    """Byte pair merging by ranks: whichever two neighbours have the union of lowest rank become one token,
    the leftmost first, until no union is a token. A token's id is its rank.

    Only the two tokens count of which a token is made in the end when it is merged alone: no other two
    that cover it can ever stand side by side, as what was merged under them was merged as in the token
    alone. So a union always ranks above its parts."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.byte, self.keys, self.unions = table
        self.pairs = dict(zip(self.keys.tolist(), self.unions.tolist()))

    @staticmethod
    def table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id of each byte, pairs of ids that become one token, that token), sorted by pair."""
        of_byte, pairs = [ranks[bytes([b])] for b in range(256)], {}
        for token, k in sorted(ranks.items(), key=lambda x: x[1]):
            parts = [of_byte[b] for b in token]
            while len(parts) > 2:  # of unions with lower ranks, which are known
                unions = [pairs.get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
                at = unions.index(min(unions))
                if unions[at] == NONE:
                    raise ValueError(f"token {k} isn't made of two tokens of lower rank")
                parts[at : at + 2] = [unions[at]]
            if len(parts) == 2:
                if max(parts) >= k:
                    raise ValueError(f"token {k} isn't made of two tokens of lower rank")
                pairs[parts[0] << 32 | parts[1]] = k
        keys = np.array(sorted(pairs), np.int64)
        return np.array(of_byte, np.int64), keys, np.array([pairs[k] for k in keys.tolist()], np.int64)

    def alone(self, word: bytes) -> list[int]:
        """The ids of one word, by a heap of unions."""
        at, after, before = self.byte[np.frombuffer(word, np.uint8)].tolist(), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        pairs, end = self.pairs, len(word)
        heap = [(k, i, at[i], at[i + 1]) for i in range(end - 1) if (k := pairs.get(at[i] << 32 | at[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = after[i]
            if at[i] != a or j >= end or at[j] != b:
                continue
            at[i], at[j], after[i] = k, -1, after[j]
            if after[j] < end:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < end and (u := pairs.get(at[x] << 32 | at[y])) is not None:
                    heapq.heappush(heap, (u, x, at[x], at[y]))
        return [k for k in at if k >= 0]

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids of all words end to end). As no union ranks lower than its parts,
        all unions of a word's lowest rank are made in one round, but for those that overlap the one before."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        done = [(np.array([k]), np.array([len(ids)]), np.array(ids, np.int64)) for k in np.flatnonzero(sizes > ALONE).tolist() for ids in (self.alone(words[k]),)]
        mine = np.flatnonzero((sizes > 0) & (sizes <= ALONE))
        token, sizes = self.byte[np.frombuffer(b"".join([words[k] for k in mine.tolist()]), np.uint8)], sizes[mine]
        while len(mine):
            starts = np.cumsum(sizes) - sizes
            of = np.repeat(np.arange(len(mine)), sizes)
            key = token << 32
            key[:-1] |= token[1:]
            near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            union = np.where(self.keys[near] == key, self.unions[near], NONE)
            union[starts + sizes - 1] = NONE  # the last has no neighbour in its word
            least = np.minimum.reduceat(union, starts)
            hit = (union == least[of]) & (union < NONE)
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(hit, -1, np.arange(len(hit))))  # 1, 2, ... in a run of hits
            hit &= run % 2 == 1
            ended = least == NONE
            if ended.any():
                out = ended[of]
                done.append((mine[ended], sizes[ended], token[out]))
            token = np.where(hit, union, token)
            keep = np.concatenate([[True], ~hit[:-1]]) & ~ended[of]
            sizes = (sizes - np.add.reduceat(hit.astype(np.int64), starts))[~ended]
            mine, token = mine[~ended], token[keep]
        number = np.zeros(len(words), np.int64)
        for k, size, _ in done:
            number[k] = size
        starts, flat = np.cumsum(number) - number, np.empty(int(number.sum()), np.uint32)
        for k, size, own in done:
            flat[np.repeat(starts[k] - (np.cumsum(size) - size), size) + np.arange(len(own))] = own
        return number, flat


def end_to_end(values: pa.Array, numbers: np.ndarray, counts: np.ndarray) -> pa.Array:
    """For each document the bytes of values[numbers] of its `counts` numbers, end to end."""
    taken = values.cast(pa.large_binary()).take(pa.array(numbers))
    _, offsets, raw = taken.buffers()
    offsets = np.frombuffer(offsets, np.int64)[taken.offset :]
    ends = np.ascontiguousarray(offsets[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), raw]).cast(pa.binary())


def _blocks(docs: DataFrame, pattern: str, buckets: int, id_type: T.DataType) -> DataFrame:
    """Rows (kind, key, block, ids, payload): for each block its numbers by position, and for each
    bucket the block's words that fall in it."""
    schema = T.StructType([*fields("kind int, key long, block long").fields, T.StructField("ids", T.ArrayType(id_type)), T.StructField("payload", T.BinaryType())])
    arrow, most = to_arrow_schema(schema), BLOCK_CHARS * min(8, max(1, buckets // 256))

    def batch_of(kind, key, block, ids, payload):
        n = len(key)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([kind] * n, key, [block] * n, ids, payload), arrow.types)], schema=arrow)

    def over(batches):
        import regex

        split = regex.compile(pattern).findall
        task, nth = TaskContext.get().partitionId(), 0
        ids, counts, numbers, words, chars = [], [], [], {}, 0

        def number(chunks):
            return [tuple(words.setdefault(w, len(words)) for w in split(c)) for c in chunks]

        def flush():
            block = task << 32 | nth
            raw = [w.encode() for w in words]
            bucket = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % buckets
            seq = np.array(numbers, np.uint32)
            yield batch_of(BLOCK, [block], block, [ids], [pack(bucket.astype(np.uint32), np.array(counts, np.uint32), (seq & 0xFFFF).astype(np.uint16), (seq >> 16).astype(np.uint16))])
            order = np.argsort(bucket, kind="stable")
            if len(order):
                parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
                yield batch_of(WORDS, [int(bucket[p[0]]) for p in parts], block, [None] * len(parts), [pack(*pack_words([raw[k] for k in p])) for p in parts])

        chunks = Chunks(number)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for i, t in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    before = len(numbers)
                    for part in chunks.of(t or ""):
                        numbers.extend(part)
                    ids.append(i)
                    counts.append(len(numbers) - before)
                    chars += len(t or "")
                    if chars >= most:
                        yield from flush()
                        nth, ids, counts, numbers, chars = nth + 1, [], [], [], 0
                        words.clear()
                        chunks = Chunks(number)
        if ids:
            yield from flush()

    return docs.mapInArrow(over, schema)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): one row per row of docs; ids: little-endian unsigned 32-bit numbers."""
    with open(path, "rb") as f:
        merges = Merges.table(read_ranks(f.read()))
    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    id_type, buckets = picked.schema["id"].dataType, buckets_of(docs.sparkSession, 4)
    blocks = _blocks(picked, pattern, buckets, id_type).repartition(buckets_of(docs.sparkSession), "kind", "key")
    back = fields("kind int, key long, bucket long, payload binary")
    back_arrow, out = to_arrow_schema(back), T.StructType([T.StructField("id", id_type), T.StructField("ids", T.BinaryType())])
    out_arrow = to_arrow_schema(out)

    def encode_words(key, rows):
        kind, bucket = (k.as_py() for k in key)
        if kind != WORDS:
            return back_arrow.empty_table()
        parts = [unpack_words(*unpack(blob.as_py())) for blob in rows.column("payload")]
        number = {w: k for k, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
        sizes, ids = Merges(merges)(list(number))
        starts, payloads = np.cumsum(sizes) - sizes, []
        for part in parts:
            own = np.fromiter(map(number.__getitem__, part), np.int64, len(part))
            n = sizes[own]
            payloads.append(pack(n.astype(np.uint32), ids[np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]))
        n = len(payloads)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(([BLOCK] * n, rows.column("block").to_pylist(), [bucket] * n, payloads), back_arrow.types)], schema=back_arrow)

    def put_together(key, block, coded):
        if key[0].as_py() != BLOCK:
            return out_arrow.empty_table()
        bucket, counts, low, high = unpack(block.column("payload")[0].as_py())
        parts = [unpack(blob) for _, blob in sorted(zip(coded.column("bucket").to_pylist(), coded.column("payload").to_pylist()))]
        if sum(len(n) for n, _ in parts) != len(bucket):
            raise ValueError(f"a block of {len(bucket)} words got the ids of {sum(len(n) for n, _ in parts)}")
        sizes = np.concatenate([n for n, _ in parts]) if parts else np.empty(0, np.uint32)
        raw = b"".join(ids.tobytes() for _, ids in parts)
        offsets = np.concatenate([[0], 4 * np.cumsum(sizes, dtype=np.int64)])
        words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        rank = np.empty(len(bucket), np.int64)
        rank[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))  # ids came in the order of buckets
        texts = end_to_end(words, rank[low.astype(np.int64) | high.astype(np.int64) << 16], counts)
        return pa.Table.from_arrays([block.column("ids")[0].values, texts], schema=out_arrow)

    coded = blocks.groupBy("kind", "key").applyInArrow(encode_words, back)
    return blocks.groupBy("kind", "key").cogroup(coded.groupBy("kind", "key")).applyInArrow(put_together, out)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens (id, ids) with `decoded`, the bytes of its ids."""
    with open(path, "rb") as f:
        ranks = read_ranks(f.read())
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        by_id[k] = token
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())])
    arrow, at = to_arrow_schema(schema), tokens.columns.index("ids")

    def join(batches):
        table_ = pa.array(by_id, pa.large_binary())
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                blobs = part.column(at).to_pylist()
                numbers = np.frombuffer(b"".join(blobs), np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, end_to_end(table_, numbers, np.array([len(b) // 4 for b in blobs]))], schema=arrow)

    return tokens.mapInArrow(join, schema)


def op4_byte_level_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
