"""Substring dedup on a De Bruijn graph of words.

An edge is a window of WINDOW words; it joins the node of its first WINDOW - 1 words to that of its
last. Edges with two occurrences or more are repeated. Going along a document, a repeated edge and
the next one are one path as long as the node between them doesn't branch off the place where the
path was first seen: each edge's first occurrence directly follows the first occurrence of the edge
before. Such paths are compacted to spans (start, words, first place), and a span is only believed
after the words at both coordinates, its own and its source's, have been compared by digest.

How Spark does it:
1. Documents are read in blocks. A block hashes its windows, keeps the first of each and deals them
   by hash, sorted and packed with their places (about 8 bytes a window) and the ids of the documents
   that these lie in, of no others, so that a window costs no more with many buckets. Later ones of the same
   block are resolved in it, so a window that a third of all documents share has one entry a block.
2. A hash bucket finds edges of several blocks and sends each block the first places.
3. A block joins those with its own and compacts paths to spans. Only spans are stored.
4. Digests of the wanted ranges come from one join with the texts; spans whose digests differ go.
5. One join with the texts applies the spans.
Blocks and buckets read one exchange, as in bpe.py.

Order: a place is earlier by smaller document id (null ids last), then by the text's hash, then by
start. Rows alike in id and text are one document; each gets its result. A null text has no words; a
text of fewer than WINDOW words loses none. Very long texts make a block of their own. An empty table
gives an empty table. Other columns stay in strip_repeats() and are ignored in repeats().
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import buckets_of, fields, free_name, map_rows, pack, store, table, unpack, words_of

WINDOW = 20
#: Words in a block, about, for up to 512 buckets; in proportion for more, up to eight times that.
BLOCK_WORDS = 1 << 21
BLOCK, EDGES = 0, 1
NO_ID = np.iinfo(np.int64).max


def planes(a: np.ndarray) -> np.ndarray:
    """The bytes of a's numbers, all first bytes first: the empty ones then compress to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).ravel()


def unplanes(b: np.ndarray, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(b.reshape(size, -1).T).view(kind).ravel()


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each run of `window` word hashes: a polynomial by doubling, then mixed."""
    m, run, size, out, done = np.uint64(0x9E3779B97F4A7C15), words, 1, None, 0
    left = window
    while left:
        if left & 1:
            part = run[done : len(run)]
            out = part if out is None else out[: len(part)] * _power(m, size) + part[: len(out)]
            done += size
        left >>= 1
        if left:
            run = run[:-size] * _power(m, size) + run[size:]
            size *= 2
    out = out[: max(0, len(words) - window + 1)].copy()
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(factor)
    return out ^ (out >> np.uint64(33))


def _power(m: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(m), n, 1 << 64))


def _blocks(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Rows (kind, key, block, payload) from docs (id, text)."""
    schema = fields("kind int, key long, block long, payload binary")
    arrow, most = to_arrow_schema(schema), BLOCK_WORDS * min(8, max(1, buckets // 512))

    def flush(block, ids, marks, hashes):
        order = np.lexsort((marks, ids))
        ids, marks, sizes = ids[order], marks[order], np.array([len(hashes[k]) for k in order], np.int64)
        words = np.concatenate([hashes[k] for k in order]) if len(order) else np.empty(0, np.uint64)
        starts = np.cumsum(sizes) - sizes
        full = np.maximum(0, sizes - window + 1)
        at = np.repeat(starts - (np.cumsum(full) - full), full) + np.arange(full.sum())
        h = window_hashes(words, window)[at] if len(at) else np.empty(0, np.uint64)
        by = np.argsort(h, kind="stable")  # equal windows stay in the order of places
        h, at = h[by], at[by]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
        head = at[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))] if len(h) else at
        doc_of = np.repeat(np.arange(len(ids)), sizes)
        same = (ids[doc_of[at]] == ids[doc_of[head]]) & (marks[doc_of[at]] == marks[doc_of[head]]) & (at - starts[doc_of[at]] == head - starts[doc_of[head]])
        later = ~new & ~same
        # a row repeated within the block (alike in id and text) keeps its windows as those of the first
        twin = at[~new & same].astype(np.uint32), head[~new & same].astype(np.uint32)
        rows = [(BLOCK, block, block, pack(ids, marks, sizes, at[later].astype(np.uint32), head[later].astype(np.uint32), *twin))]
        h, at = h[new], at[new]
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        ends = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            if b > a:
                own = np.unique(doc_of[at[a:b]])
                head = np.diff(ids[own], prepend=np.int64(0)), marks[own], np.diff(starts[own], prepend=0).astype(np.uint32)
                rows.append((EDGES, k, block, pack(*head, planes(np.diff(h[a:b], prepend=np.uint64(0))), planes(at[a:b].astype(np.uint32)))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    def over(batches):
        task, nth = TaskContext.get().partitionId(), 0
        ids, marks, hashes, held = [], [], [], 0
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for i, t in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    raw = (t or "").encode()
                    own = raw.split()
                    ids.append(NO_ID if i is None else i)
                    marks.append(xxhash.xxh64_intdigest(raw, 42))
                    hashes.append(np.fromiter(map(digest, own), np.uint64, len(own)))
                    held += len(own)
                    if held >= most:
                        yield flush(task << 32 | nth, np.array(ids, np.int64), np.array(marks, np.uint64).view(np.int64), hashes)
                        nth, ids, marks, hashes, held = nth + 1, [], [], [], 0
        if ids:
            yield flush(task << 32 | nth, np.array(ids, np.int64), np.array(marks, np.uint64).view(np.int64), hashes)

    return docs.mapInArrow(over, schema)


def _places(at: np.ndarray, ids: np.ndarray, marks: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, mark, start) of places given as word numbers in a block."""
    doc = np.searchsorted(starts, at, "right") - 1
    return ids[doc], marks[doc], at - starts[doc]


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Compacted repeated paths of docs (id long, mark long, text), not yet verified:
    (id, mark, start, n_words, source_id, source_mark, source_start)."""
    spark = docs.sparkSession
    buckets = buckets_of(spark)
    blocks = _blocks(docs.select("id", "text"), window, buckets).repartition(buckets, "kind", "key")
    back = fields("kind int, key long, payload binary")
    back_arrow = to_arrow_schema(back)
    out = fields("id long, mark long, start long, n_words long, source_id long, source_mark long, source_start long")
    out_arrow = to_arrow_schema(out)

    def meet(key, rows):
        if key[0].as_py() != EDGES or rows.num_rows < 2:
            return back_arrow.empty_table()
        names, blobs = rows.column("block").to_pylist(), rows.column("payload")
        hashes, ats, heads = [], [], []
        for blob in blobs:
            ids, marks, starts, h, at = unpack(blob.as_py())
            hashes.append(np.cumsum(unplanes(h, np.uint64), dtype=np.uint64))
            ats.append(unplanes(at, np.uint32))
            heads.append((np.cumsum(ids), marks, np.cumsum(starts, dtype=np.int64)))
        every = np.concatenate(hashes)
        every.sort()
        twice = every[1:][every[1:] == every[:-1]]
        twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])] if len(twice) else twice
        found = []
        for k, (h, at, head) in enumerate(zip(hashes, ats, heads)):
            near = np.minimum(np.searchsorted(twice, h), max(0, len(twice) - 1))
            hit = twice[near] == h if len(twice) else np.zeros(len(h), bool)
            found.append((h[hit], np.full(int(hit.sum()), k), at[hit], *_places(at[hit], *head)))
        h, block, at, ids, marks, start = map(np.concatenate, zip(*found))
        order = np.lexsort((start, marks, ids, h))
        h, block, at, ids, marks, start = (x[order] for x in (h, block, at, ids, marks, start))
        if not len(h):
            return back_arrow.empty_table()
        first = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), np.arange(len(h)), 0))
        later = (ids != ids[first]) | (marks != marks[first]) | (start != start[first])
        rows_out = []
        for k in range(len(names)):
            own = np.flatnonzero(later & (block == k))
            if len(own):
                own = own[np.argsort(at[own])]
                src = first[own]
                rows_out.append((BLOCK, names[k], pack(np.diff(at[own].astype(np.int64), prepend=0).astype(np.uint32), np.diff(ids[src], prepend=0), marks[src], (start[src] - at[own]).astype(np.int64))))
        if not rows_out:
            return back_arrow.empty_table()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_out), back_arrow.types)], schema=back_arrow)

    def compact(key, block, met):
        if key[0].as_py() != BLOCK:
            return out_arrow.empty_table()
        ids, marks, sizes, at, head, twin, twin_head = unpack(block.column("payload")[0].as_py())
        total, starts = int(sizes.sum()), np.cumsum(sizes) - sizes
        has, s_id, s_mark, s_start = np.zeros(total, bool), np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64)
        for blob in met.column("payload"):
            t, i, m, d = unpack(blob.as_py())
            t = np.cumsum(t, dtype=np.int64)
            has[t], s_id[t], s_mark[t], s_start[t] = True, np.cumsum(i), m, d + t
        outer = has.copy()
        for targets, sources in ((at, head), (twin[outer[twin_head]], twin_head[outer[twin_head]])):
            i, m, s = _places(sources.astype(np.int64), ids, marks, starts)
            own = outer[sources]
            has[targets] = True
            s_id[targets], s_mark[targets], s_start[targets] = np.where(own, s_id[sources], i), np.where(own, s_mark[sources], m), np.where(own, s_start[sources], s)
        t = np.flatnonzero(has)
        if not len(t):
            return out_arrow.empty_table()
        i, m, start = _places(t, ids, marks, starts)
        joined = (np.diff(t) == 1) & (np.diff(start) == 1) & (np.diff(s_id[t]) == 0) & (np.diff(s_mark[t]) == 0) & (np.diff(s_start[t]) == 1)
        a = np.concatenate([[0], np.flatnonzero(~joined) + 1])
        n = np.diff(np.concatenate([a, [len(t)]])) + window - 1
        cols = [i[a], m[a], start[a], n, s_id[t[a]], s_mark[t[a]], s_start[t[a]]]
        return pa.Table.from_arrays([pa.array(c) for c in cols], schema=out_arrow)

    met = blocks.groupBy("kind", "key").applyInArrow(meet, back)
    return blocks.groupBy("kind", "key").cogroup(met.groupBy("kind", "key")).applyInArrow(compact, out)


def verified(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of found whose words equal those at the source, by 128-bit digests."""
    own = found.select("id", "mark", "start", "n_words")
    theirs = found.select(F.col("source_id").alias("id"), F.col("source_mark").alias("mark"), F.col("source_start").alias("start"), "n_words")
    wanted = own.union(theirs).distinct().groupBy("id", "mark").agg(F.collect_list("start").alias("starts"), F.collect_list("n_words").alias("sizes"))

    def digests(ids, marks, texts, starts, sizes):
        rows = []
        for i, m, t, s, n in zip(ids, marks, texts, starts, sizes):
            words = words_of(t)
            rows += [(i, m, a, k, hashlib.blake2b(b" ".join(words[a : a + k]), digest_size=16).digest()) for a, k in zip(s, n)]
        return list(zip(*rows)) or [[]] * 5

    texts = docs.join(wanted, ["id", "mark"]).select("id", "mark", "text", "starts", "sizes")
    taken = map_rows(texts, digests, fields("id long, mark long, start long, n_words long, digest binary"))
    taken = store(taken.groupBy("id", "mark", "start", "n_words").agg(F.min("digest").alias("digest")), "digests")
    source = taken.select(F.col("id").alias("source_id"), F.col("mark").alias("source_mark"), F.col("start").alias("source_start"), "n_words", F.col("digest").alias("source_digest"))
    return found.join(taken, ["id", "mark", "start", "n_words"]).join(source, ["source_id", "source_mark", "source_start", "n_words"]).filter("digest = source_digest").drop("digest", "source_digest")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Verified repeated spans: (id, mark, start, n_words, source_id, source_mark, source_start). A
    null id is the largest long; mark is the text's hash (XXH64, seed 42)."""
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(int(NO_ID))).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), F.col(text).alias("text"))
    return verified(keyed, store(spans(keyed, window), "spans"))


def _removed(n: int, starts, sizes) -> np.ndarray:
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, np.asarray(starts), 1)
    np.add.at(gone, np.asarray(starts) + np.asarray(sizes), -1)
    return np.cumsum(gone)[:n] > 0


@F.pandas_udf(fields("n_words long, n_removed long, kept string"))
def kept_words(text: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    rows = []
    for t, s, n in zip(text, starts, sizes):
        words = words_of(t)
        if s is None:
            rows.append((len(words), 0, b" ".join(words).decode()))
        else:
            gone = _removed(len(words), s, n)
            rows.append((len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode()))
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])


_SPACES = re.compile(r"([\x20\x09-\x0d]+)")


@F.pandas_udf(T.StringType())
def stripped(text: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.Series:
    """The text without its removed words and the space before each; all else stays."""
    out = []
    for t, s, n in zip(text, starts, sizes):
        if s is not None:
            lead = "" if t[0] not in " \t\n\r\x0b\x0c" else _SPACES.match(t)[0]
            parts = ["", *_SPACES.split(t)] if not lead else _SPACES.split(t)[1:]
            spaces, words = parts[::2], parts[1::2]
            if words and not words[-1]:
                words.pop()
            gone = _removed(len(words), s, n).tolist()
            t = "".join(a + w for a, w, g in zip(spaces, words, gone) if not g).lstrip(" \t\n\r\x0b\x0c")
        out.append(t)
    return pd.Series(out, dtype=object)


def _with_spans(docs: DataFrame, doc_id: str, text: str, window: int) -> tuple[DataFrame, str]:
    """(row, starts, sizes) for each row of docs; starts and sizes are null where nothing repeats."""
    cut = repeats(docs, doc_id, text, window).groupBy("id", "mark").agg(F.collect_list("start").alias("starts"), F.collect_list("n_words").alias("sizes"))
    row = free_name(docs, "row")
    keyed = docs.select(F.struct(*docs.columns).alias(row), F.coalesce(F.col(doc_id).cast("long"), F.lit(int(NO_ID))).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"))
    return keyed.join(store(cut, "cuts"), ["id", "mark"], "left").select(row, "starts", "sizes"), row


def strip_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with their own columns, the text without the words that repeated windows cover."""
    cut, row = _with_spans(docs, doc_id, text, window)
    return cut.select(*(stripped(f"{row}.{c}", "starts", "sizes").alias(c) if c == text else F.col(f"{row}.`{c}`") for c in docs.columns))


def op1_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut, row = _with_spans(docs, "doc_id", "text", WINDOW)
    kept = cut.select(f"{row}.doc_id", kept_words(f"{row}.text", "starts", "sizes").alias("k"))
    return kept.select("doc_id", "k.n_words", "k.n_removed", F.sha2("k.kept", 256).alias("kept_sha256"))


#: The same in SQL.
OP1_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), starts as (
  select doc_id, unnest(range(len(w) - 19)) as s, w from words where len(w) >= 20
), windows as (
  select doc_id, s, row_number() over (partition by md5(array_to_string(w[s + 1 : s + 20], ' ')) order by doc_id, s) as nth from starts
), gone as (
  select doc_id, count(distinct s + k) as n_removed, list(distinct s + k) as ks
  from (select doc_id, s, unnest(range(20)) as k from windows where nth > 1) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
  sha256(array_to_string(case when ks is null then w else list_filter(w, lambda x, i: not list_contains(ks, i - 1)) end, ' ')) as kept_sha256
from words left join gone using (doc_id)
"""
