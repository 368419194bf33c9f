"""Importance resampling towards a target distribution.

Hashed word n-grams of the target and of all documents are counted in an array of buckets; a bucket's
gain is the logarithm of the smoothed ratio of the two distributions, in thousandths. A document's weight
is the sum of its features' gains, its score that weight plus Gumbel noise made from its id, so that the
highest scores are a draw without replacement. The k-th score is found by radix selection: one histogram
of 16 bits for each digit of the key (score, id), over rows that agree in the digits before. Only rows up
to the k-th key are sorted, by range, and ranked.

Nulls and odd rows: a null text has no words; it scores its noise and is never drawn. A null id hashes as
'' and comes after all ids at the same score. Repeated rows each count and each may be drawn. A tie that
the ids don't decide is one of equal score and id: which of those rows is drawn is open, their number not.
Empty documents give an empty result; an empty target gives each bucket the gain of a count of zero."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc_sql, fields, map_rows, store, table

BUCKETS, SEED = 10000, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Bits of a digit of the selection; a histogram has at most 2^DIGIT rows.
DIGIT = 16
#: Rows of text that a worker holds at once.
ROWS = 64
#: Every byte that isn't a digit, a letter or part of a letter beyond ASCII parts words; A-Z are lowered.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SCORED = fields("id long, n_words long, n_features long, weight long, score long")


def features(text: str | None, ngram: int = 1) -> tuple[int, list[bytes]]:
    """The number of words and all runs of 1 to ngram consecutive words."""
    words = text.encode().translate(_LETTERS).split() if text else []
    runs = list(words)
    for n in range(2, ngram + 1):
        runs += [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
    return len(words), runs


def _hashed(runs: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % np.uint32(buckets)


def bucket_counts(docs: DataFrame, text: str = "text", ngram: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of all texts. A task keeps one array of `buckets` counts."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for t in batch.column(0).slice(at, ROWS).to_pylist():
                    total += np.bincount(_hashed(features(t, ngram)[1], buckets), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["bucket", "n"])

    return docs.select(text).mapInArrow(count, fields("bucket int, n long")).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain in thousandths, rounded down, from the counts in it."""
    s_all, t_all = sum(source.values()) + buckets, sum(target.values()) + buckets
    return [math.floor(1000 * math.log(float(target.get(b, 0) + 1) * float(s_all) / (float(source.get(b, 0) + 1) * float(t_all)))) for b in range(buckets)]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, rounded down, by the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", ngram: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) for each row of docs. The driver holds two arrays of
    `buckets` counts, whatever the size of the tables."""
    counted = [{r.bucket: r.n for r in bucket_counts(d, t, ngram, buckets).collect()} for d, t in ((docs, text), (target, target_text))]
    gain = np.array(gains(*counted, buckets), np.int64)

    def score(ids, texts):
        out = []
        for i, t in zip(ids, texts):
            n, runs = features(t, ngram)
            w = int(gain[_hashed(runs, buckets)].sum())
            out.append((i, n, len(runs), w, w + noise(i, seed)))
        return list(zip(*out)) if out else [[]] * 5

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("id"), text), score, _SCORED, ROWS)


def _keys() -> list[Column]:
    """The order of the draw as columns that compare as unsigned numbers: score down, nulls last, id up."""
    sign = F.lit(-(1 << 63))
    return [F.bitwise_not(F.col("score").bitwiseXOR(sign)), F.col("id").isNull().cast("long"), F.coalesce("id", F.lit(0)).bitwiseXOR(sign)]


def _unsigned(v: int) -> int:
    return v & ((1 << 64) - 1)


def kth(scored: DataFrame, k: int) -> tuple[int, int | None]:
    """(score, id) of the k-th row from 1 of scored(score, id), a stored table, by score down and id up.

    A job makes the histogram of one digit among the rows that agree with all digits found so far."""
    here, found = F.lit(True), []
    for key in _keys():
        low, high = (_unsigned(v) for v in scored.filter(here).agg(*(f(key.bitwiseXOR(F.lit(-(1 << 63)))) for f in (F.min, F.max))).first())
        low, high = low ^ 1 << 63, high ^ 1 << 63
        bits = (low ^ high).bit_length()
        value = low >> bits << bits
        while bits:
            width = min(DIGIT, bits)
            bits -= width
            digit = F.shiftrightunsigned(key, bits).bitwiseAND((1 << width) - 1)
            for r in sorted(scored.filter(here).groupBy(digit.alias("d")).count().collect()):
                if k <= r["count"]:
                    value, here = value | r.d << bits, here & (digit == r.d)
                    break
                k -= r["count"]
        found.append(value)
    to_signed = lambda v: (v ^ 1 << 63) - (1 << 64) if v ^ 1 << 63 >= 1 << 63 else v ^ 1 << 63
    return to_signed(~found[0] & (1 << 64) - 1), None if found[1] else to_signed(found[2])


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """scored(id, score, eligible, ...), a stored table, with `rank` of the k first eligible rows, null for others.

    Rows up to the k-th key are dealt by range and sorted; a row's rank is its place in its partition and
    the sizes of the partitions before, one number for each."""
    if k <= 0:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    eligible = scored.filter("eligible")
    score, last = kth(eligible, k)
    by_id = F.lit(True) if last is None else F.col("id").isNotNull() & (F.col("id") <= last)
    first = F.col("eligible") & ((F.col("score") > score) | ((F.col("score") == score) & by_id))
    order = [F.desc("score"), F.asc_nulls_last("id")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = scored.filter(first).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_ = store(sorted_.withColumn("place", F.monotonically_increasing_id()), "drawn")
    part, before, starts = F.shiftright("place", 33), 0, []
    for p, n in sorted(sorted_.groupBy(part.alias("p")).count().collect()):  # one row for each partition
        starts.append((p, before))
        before += n
    starts = scored.sparkSession.createDataFrame(starts, "part_ long, before_ long")
    placed = sorted_.join(F.broadcast(starts), part == F.col("part_"))  # one row for each partition
    rank = F.col("before_") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    drawn = placed.withColumn("rank", F.when(rank <= k, rank)).drop("place", "part_", "before_")
    return drawn.unionByName(scored.filter(~first).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) for each row of docs: of the N rows with at least
    `least_words` words, floor(percent N / 100) are drawn and ranked. Options: see scores()."""
    scored = store(scores(docs, target, **options).withColumn("eligible", F.col("n_words") >= least_words), "scores")
    n = scored.filter("eligible").count()
    return ranked(scored, percent * n // 100).drop("eligible")


def op13_importance_resampling(spark, sf_dir):
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10ffff}]+')"
OP13_SQL = f"""with recursive {CRC_TABLE_SQL}, docs as (select row_number() over () as nth, doc_id, {_WORDS} as words from documents),
told as (select unnest({_WORDS}) as w from benchmark), said as (select nth, unnest(words) as w from docs),
known as (select w, {crc_sql('w')} % 10000 as bucket from (select w from told union select w from said) q, crc_table),
s as (select bucket, count(*) as n from said join known using (w) group by 1), t as (select bucket, count(*) as n from told join known using (w) group by 1),
gain as (select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from said) + 10000)::double / ((s.n + 1)::double * ((select count(*) from told) + 10000)::double)))::bigint as g from s left join t using (bucket)),
weights as (select nth, sum(g) as weight from said join known using (w) join gain using (bucket) group by nth),
h as (select nth, doc_id, len(words) as n, coalesce(weight, 0) as weight, list_reduce(list_prepend(0::bigint, list_transform(range(1, 9), lambda i: (instr('123456789abcdef', substr(sha256('2024:' || coalesce(doc_id::varchar, '')), i::int, 1)))::bigint)), lambda a, b: a * 16 + b) as h from docs left join weights using (nth)),
f as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from h),
drawn as (select nth, row_number() over (order by score desc, doc_id nulls last) as r, count(*) over () as total from f where n >= 20)
select doc_id, n::bigint as n_features, weight::bigint as weight, score::bigint as score, (case when r <= 10 * total // 100 then r end)::bigint as rank from f left join drawn using (nth)"""
