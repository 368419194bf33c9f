"""SimHash near-duplicates by an inverted index over the fingerprints' bytes.

Two 64-bit fingerprints within 2 bits differ in at most 2 of their 8 bytes, so they share at least
6 positional bytes. Postings are keyed by four positional bytes (each choice of two out of four byte
pairs): fingerprints that share 6 bytes meet in one posting list at least. For each pair that meets,
the shared positional bytes are tallied; pairs with at least 6 are kept and verified bit by bit.

A posting list longer than LIST_LIMIT isn't paired out but split: each of its fingerprints gets
postings with two more of the remaining four bytes, so a pair that shares 6 bytes meets again in one
of the six finer lists. Lists that are still longer are split once more, by two of the four half bytes
that remain: two different bits leave two of them alike. Those lists have at most 256 fingerprints, as
8 bits are left. So each list is paired out in the end, no link is lost and a fingerprint never meets
more than a fixed number of others. Components need no more than a spanning forest of each list, so there
a list's pairs are tallied within its task and only the forest's links become rows. Links become components by alternating large-star and small-star
rounds (Kiveris et al., 2014).

The query links one fingerprint, by its contract. Few near copies come within 2 bits of 64: of pairs with
a five-word similarity of 0.8 or more about a tenth. So drop_near_duplicates() makes PARTS fingerprints
from different mixes of the same shingle hashes, puts each through the index as a part of its own, and
joins documents that are linked in any part.

Only narrow columns are shuffled: equal texts meet as one fingerprint from the start. Joins on a
fingerprint that many rows share carry no aggregate above them, so adaptive execution splits them.

Defined results: a null text counts as empty and gets fingerprint 0, linked like any other. A null
id never becomes the name of a component with another id; alone its component is null. Repeated
rows each get their row. An empty table gives an empty table. Other columns are ignored here, and
kept by drop_near_duplicates().
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buckets_of, free_name, lower_ascii, store, table

SEED, SHINGLE, BITS = 42, 3, 2
#: Longest posting list that is paired out; longer ones are split by further positions.
LIST_LIMIT = 64
#: Fingerprints of a document in drop_near_duplicates().
PARTS = 16
#: Multipliers and step of splitmix64 (fixed values).
MIX_STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def shingle_hashes(text: str | None) -> np.ndarray:
    words = lower_ascii(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    line, n, digest = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - SHINGLE].tolist()]
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())], np.uint64)


def _majority(h: np.ndarray) -> int:
    """The bits set in over half of h, as a signed number; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 255):  # a byte holds the count of 255 rows
        bits = np.unpackbits(h[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def _mixed(h: np.ndarray, part: int) -> np.ndarray:
    """Another 64-bit hash of h for each part; h itself for part 0."""
    if part == 0:
        return h
    h = h + np.uint64(part * MIX_STEP % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_A)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_B)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    return _majority(shingle_hashes(text))


def fingerprints(text: str | None) -> list[int]:
    """PARTS fingerprints, the first that of fingerprint(); all 0 for a text without words."""
    h = shingle_hashes(text)
    return [_majority(_mixed(h, part)) for part in range(PARTS)]


@F.pandas_udf(T.LongType())
def simhash(text: pd.Series) -> pd.Series:
    return text.map(fingerprint, na_action=None).astype("int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def simhashes(text: pd.Series) -> pd.Series:
    return text.map(fingerprints, na_action=None)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def finer(mask: int, width: int) -> list[int]:
    """The masks that add to `mask` two of the four units of `width` bits outside of it."""
    free = [m for k in range(0, 64, width) if not (m := ((1 << width) - 1) << k) & mask]
    return [mask | x | y for x, y in combinations(free, 2)]


def _posted(fps: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """(part, fp, mask, key): fps(part, fp, mask) with a posting for each of the masks that follow its own; `count`,
    the length of its list, 2 at least."""
    follow = F.create_map(*(x for m, ms in masks.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(k)) for k in ms)))))
    posts = fps.select("part", "fp", F.explode(F.element_at(follow, F.col("mask"))).alias("mask"))
    posts = posts.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    return posts.join(posts.groupBy("part", "mask", "key").count().filter("count > 1"), ["part", "mask", "key"])


def _lists(posts: DataFrame) -> DataFrame:
    """(part, fps) for each posting list, fps in order."""
    keys = ["part", "mask", "key"]
    return posts.repartition(buckets_of(posts.sparkSession), *keys).groupBy(*keys).agg(F.sort_array(F.collect_set("fp")).alias("fps"))


def _paired(posts: DataFrame, most: int) -> DataFrame:
    """Verified pairs (part, a, b) of fingerprints whose list has up to `most`."""
    x = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum((F.shiftrightunsigned(x, 8 * k).bitwiseAND(0xFF) == 0).cast("int") for k in range(8))
    met = _lists(posts).select("part", F.posexplode("fps").alias("n", "a"), "fps").select("part", "a", F.explode(F.slice("fps", F.col("n") + 2, most)).alias("b"))
    return met.filter(shared >= 8 - BITS).filter(F.bit_count(x) <= BITS)


def spanning(fps: np.ndarray) -> list[int]:
    """Of each fingerprint of a list the place of one that it is linked to, so that the links from a place to
    another span the list's components; of one fingerprint in each component its own place.

    All pairs of the list are tallied and verified, as a matrix."""
    x = fps[:, None] ^ fps[None, :]
    alike = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(2) >= 8 - BITS
    linked = alike & (np.bitwise_count(x.view(np.uint64)) <= BITS)
    towards = np.full(len(fps), -1)
    for first in range(len(fps)):
        if towards[first] < 0:
            towards[first], edge = first, [first]
            while edge:
                at = edge.pop()
                new = np.flatnonzero(linked[at] & (towards < 0))
                towards[new] = at
                edge += new.tolist()
    return towards.tolist()


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def spanning_places(fps: pd.Series) -> pd.Series:
    return fps.map(spanning)


def _spanned(posts: DataFrame) -> DataFrame:
    """Verified pairs (part, a, b) that join what is linked in a list: fewer than the list has fingerprints."""
    tied = _lists(posts).select("part", "fps", spanning_places("fps").alias("towards"))
    joined = F.filter(F.arrays_zip("fps", F.transform("towards", lambda k: F.element_at("fps", k + 1)).alias("to")), lambda e: e["fps"] != e["to"])
    return tied.select("part", F.explode(joined).alias("e")).select("part", F.least("e.fps", "e.to").alias("a"), F.greatest("e.fps", "e.to").alias("b"))


def links(fps: DataFrame, limit: int = LIST_LIMIT, whole: bool = True) -> DataFrame:
    """(part, a, b), a < b: all pairs of fingerprints fp of fps(part, fp) within BITS bits of each other in a part.

    Without `whole` only as many of them as join the same fingerprints: of each posting list a spanning
    forest, so rows grow with the lists' lengths, not with their squares."""
    found, crowded, masks = [], fps.select("part", "fp", F.lit(0).cast("long").alias("mask")), [0]
    for width in (16, 8, 4):
        steps = {m: finer(m, width) for m in masks}
        sized = _posted(crowded, steps)
        last = width == 4
        short = sized if last else sized.filter(F.col("count") <= limit)
        found.append(_paired(short, 256 if last else limit) if whole else _spanned(short))
        if not last:
            crowded = store(sized.filter(F.col("count") > limit).select("part", "fp", "mask").distinct(), "crowded")
            masks = sorted({k for ms in steps.values() for k in ms})
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b) but the roots; root: the smallest node reachable.

    Alternates large-star and small-star until the edges stay; each round is written to the shared
    folder. Only a count and a checksum of the edges reach the driver."""
    edges, before = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = store(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def roots_of(fps: DataFrame) -> DataFrame:
    """(fp, root) for each distinct fingerprint of fps."""
    distinct = store(fps.select("fp").distinct(), "fingerprints")
    stars = components(links(distinct.withColumn("part", F.lit(0)), whole=False))
    return distinct.join(stars, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: (id, fp, component_id)."""
    keys = store(docs.select(F.col(doc_id).alias("id"), simhash(text).alias("fp")), "simhash")
    roots = store(roots_of(keys).join(keys.groupBy("fp").agg(F.min("id").alias("least")), "fp"), "roots")
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(names, "root").select("fp", "component_id")
    return keys.join(named, "fp").select("id", "fp", "component_id")


def linked_nodes(keys: DataFrame) -> DataFrame:
    """(node, root) for each distinct node of keys(node, fps): nodes linked in any part have one root.

    In a part, nodes of one fingerprint hang on the least of them, which stands for the fingerprint in
    its links."""
    nodes = keys.select("node", "fps").distinct()
    values = store(nodes.select("node", F.posexplode("fps").alias("part", "fp")), "parts")
    heads = store(values.groupBy("part", "fp").agg(F.min("node").alias("head")), "heads")
    equal = values.join(heads, ["part", "fp"]).filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    ends = [heads.select("part", F.col("fp").alias(c), F.col("head").alias(f"{c}_head")) for c in "ab"]
    near = links(heads.select("part", "fp"), whole=False).join(ends[0], ["part", "a"]).join(ends[1], ["part", "b"])
    edges = equal.unionByName(near.select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))).filter("a <> b").distinct()
    stars = components(edges).withColumnRenamed("node", "linked")
    found = values.filter("part = 0").select("node").join(stars, F.col("node") == F.col("linked"), "left")
    return found.select("node", F.coalesce("root", "node").alias("root"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component of linked_nodes(), columns unchanged: the row with the smallest
    id (nulls last), then the smallest hash of its text; of rows alike in both, one."""
    mark, whole = F.xxhash64(F.coalesce(text, F.lit(""))), free_name(docs, "row")
    keys = docs.select(F.col(doc_id).alias("id"), mark.alias("mark"), simhashes(text).alias("fps"))
    keys = store(keys.withColumn("node", F.xxhash64("fps")), "simhash")
    best = keys.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("best"))
    winners = linked_nodes(keys).join(best, "node").groupBy("root").agg(F.min("best").alias("best")).select("best.id", "best.mark")
    copies = winners.join(keys.groupBy("id", "mark").count(), (winners["id"].eqNullSafe(keys["id"])) & (winners["mark"] == keys["mark"])).select(winners["id"].alias("w_id"), winners["mark"].alias("w_mark"), "count")
    copies = store(copies, "winners")
    rows = docs.select(F.struct(*docs.columns).alias(whole), F.col(doc_id).alias("id"), mark.alias("mark"))
    kept = rows.join(copies, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark")))
    once = kept.filter("count = 1").select(f"{whole}.*")
    again = kept.filter("count > 1").groupBy("w_id", "w_mark").agg(F.first(whole).alias(whole)).select(f"{whole}.*")
    return once.unionByName(again)


def op9_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
