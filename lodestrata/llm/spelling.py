"""Spelling variants: words one edit apart, found in the corpus's trie.

The words are the leaves of a trie. A node's heavy edge is the one with most words below it; a word passes
at most log2(words) light edges. At each of those its leaf is merged, as all of the light subtree, with the
character after the node skipped, replaced by the heavy one, or preceded by it, and with the character left
open towards the other light subtrees. Where that meets a leaf, the two words are one edit apart, and each
such pair is met once: of a run of equal characters the last is skipped, and what is put before a light
character is another one.

Nodes are prefixes by a 61-bit polynomial hash, so rows stay narrow however long a word is, and edges are
summed and joined by Spark. Two prefixes of one hash share a heavy character, which changes no pair; two
words of one hash are told apart by the check of the distance that each pair passes. Nodes with more than
HOT of all rows are few and go to the tasks; the others are joined by shuffle.

Nulls and odd rows: a null text has no runs; a null id is written as ''. Repeated rows count each. Words
with equally frequent near words take the one first by code points. Words without a near one have no form
and are their own root. No words give an empty result; other columns of docs are not read."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import CRC_TABLE_SQL, crc_sql, fields, store, table

#: Runs of letters, A-Z lowered (fixed by the query's contract).
RUN = "[a-zÀ-ÿ]+"
#: Of this many hashes of id and run one loses a character.
ERRATA = 31
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: A node with more than this share of all rows is hot; there are at most 1 / HOT of each length of prefix.
HOT = 1e-3
#: Different words or edges that a task counts before it passes them on.
HELD = 200_000
ROWS = 64
_RUN = re.compile(RUN)
_PRIME, _BASE, _OPEN = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1), 0x110001


def with_errata(doc_id: int | None, run: str, one_in: int = ERRATA) -> str:
    """The run, without one character where the hash of id and run says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % one_in == 0 else run


def _counted(batches, names: list[str], schema: pa.Schema, keys_of):
    """Sums of Counters over batches, passed on whenever they get large."""
    total = Counter()

    def rows():
        keys = list(zip(*total)) if len(names) > 2 else [list(total)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*keys, list(total.values())], schema.types)], schema=schema)

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns)):
                total.update(keys_of(*row))
                if len(total) > HELD:
                    yield rows()
                    total.clear()
    if total:
        yield rows()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int = ERRATA) -> DataFrame:
    """(word, n) of all texts."""
    schema = fields("word string, n long")

    def keys_of(i, t):
        found = Counter()
        for run, n in Counter(_RUN.findall(t.encode().lower().decode()) if t else ()).items():
            if len(run) >= least_length:
                word = with_errata(i, run, one_in)
                if len(word) >= least_length:
                    found[word] += n
        return found

    arrow = to_arrow_schema(schema)
    counted = docs.select(doc_id, text).mapInArrow(lambda b: _counted(b, schema.names, arrow, keys_of), schema)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def prefix_hashes(word: str) -> list[int]:
    """Hashes of all prefixes, the empty and the whole one too."""
    out, h = [0], 0
    for c in word:
        h = (h * _BASE + ord(c) + 1) % _PRIME
        out.append(h)
    return out


def numbered(words: DataFrame) -> DataFrame:
    """(wid, word, n, hash), stored."""

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([prefix_hashes(w)[-1] for w in b.column("word").to_pylist()], pa.int64())], names=["word", "n", "hash"])

    return store(words.mapInArrow(hashed, fields("word string, n long, hash long")).withColumn("wid", F.monotonically_increasing_id()), "words")


def _edges_of(word: str):
    """(node, character after it), 0 at the end of the word."""
    return zip(prefix_hashes(word), [*map(ord, word), 0])


def heavy_edges(words: DataFrame) -> DataFrame:
    """(node, size, heavy): the words below each node and the character that most of them go on with."""
    schema = fields("node long, after int, n long")
    arrow = to_arrow_schema(schema)
    edges = words.select("word").mapInArrow(lambda b: _counted(b, schema.names, arrow, _edges_of), schema)
    sums = edges.groupBy("node", "after").agg(F.sum("n").alias("n"))
    return sums.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "after")).alias("most")).select("node", "size", F.col("most.after").alias("heavy"))


def light_edges(words: DataFrame) -> DataFrame:
    """(wid, lights): for each word with light edges the array of (place, heavy character there)."""
    nodes = store(heavy_edges(words), "nodes")
    limit = (nodes.agg(F.sum("size")).first()[0] or 0) * HOT
    hot = {r.node: r.heavy for r in nodes.filter(F.col("size") > limit).collect()}  # at most 1 / HOT for the sum of all sizes

    def passed(is_hot):
        schema = fields("wid long, place int, node long, after int, heavy int")
        arrow = to_arrow_schema(schema)

        def over(batches):
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part, out = b.slice(at, 1024), []
                    for wid, word in zip(part.column("wid").to_pylist(), part.column("word").to_pylist()):
                        for place, (node, after) in enumerate(_edges_of(word)):
                            if (node in hot) == is_hot and hot.get(node) != after:
                                out.append((wid, place, node, after, hot.get(node)))
                    columns = list(zip(*out)) if out else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

        return words.select("wid", "word").mapInArrow(over, schema)

    few = passed(True).select("wid", "place", "heavy")
    rest = passed(False).drop("heavy").join(nodes.filter(F.col("size") <= limit).select("node", "heavy"), "node").filter("after <> heavy")
    return few.unionByName(rest.select("wid", "place", "heavy")).groupBy("wid").agg(F.collect_list(F.struct("place", "heavy")).alias("lights"))


def merges(word: str, lights: list[tuple[int, int]]):
    """(key, open) for each way in which the leaf is merged: the hash of the word that it would meet, or of
    the word with its light character left open."""
    heads = prefix_hashes(word)
    n, whole = len(word), heads[-1]
    for place, heavy in lights:
        head = heads[place]
        ahead = pow(_BASE, n - place, _PRIME)
        rest = (whole - head * ahead) % _PRIME  # of word[place:]
        if heavy:
            yield ((head * _BASE + heavy + 1) * ahead + rest) % _PRIME, False
        if place == n:
            continue
        behind = pow(_BASE, n - place - 1, _PRIME)
        tail = (whole - heads[place + 1] * behind) % _PRIME  # of word[place + 1:]
        if word[place + 1 : place + 2] != word[place]:
            yield (head * behind + tail) % _PRIME, False
        if heavy:
            yield ((head * _BASE + heavy + 1) * behind + tail) % _PRIME, False
        yield ((head * _BASE + _OPEN) * behind + tail) % _PRIME, True


_MERGED = fields("key long, open boolean, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), one row for each pair of words one edit apart, from numbered()."""
    arrow = to_arrow_schema(_MERGED)

    def over(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = [(key, open_, w, n) for w, n, lights in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)) for key, open_ in merges(w, [(s["place"], s["heavy"]) for s in lights])]
                columns = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    merged = store(words.join(light_edges(words), "wid").select("word", "n", "lights").mapInArrow(over, _MERGED), "merged")
    met = merged.filter("not open").join(words.select(F.col("hash").alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n")), "key").select("word", "n", "other", "other_n")
    # words that differ in one character at one place: no more than the alphabet has letters
    groups = merged.filter("open").groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("these")).filter(F.size("these") > 1)
    one = groups.select("these", F.explode("these").alias("one"))
    both = one.select("one", F.explode(F.filter("these", lambda o: o["word"] > F.col("one.word"))).alias("two"))
    pairs = met.unionByName(both.select("one.word", "one.n", F.col("two.word").alias("other"), F.col("two.n").alias("other_n")))
    return pairs.filter(F.levenshtein("word", "other", 1) == 1)


def roots(forms: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """(word, root) for each row of forms(word, form): each step multiplies the count by `ratio`, so the
    number of steps is bounded by the largest count `most`; the steps double in each round."""
    found, steps, longest = store(forms.select("word", F.col("form").alias("root")), "roots"), 1, 1
    while ratio**longest <= most:
        longest += 1
    for _ in range(max(0, int(log2(longest)) + 1)):
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = store(found.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return found


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of words(word, n), each word once."""
    words = numbered(words)
    pairs = store(near_pairs(words), "near")
    back = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = pairs.unionByName(back).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    has = -F.col("best.less") >= ratio * F.col("n")
    found = words.select("word", "n").join(near, "word", "left").select("word", F.when(has, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.less")).alias("form_n"))
    found = store(found, "forms")
    most = found.agg(F.max("form_n")).first()[0] or 0
    ends = roots(found.filter("form is not null").select("word", "form"), most, ratio)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir):
    return variants(word_counts(table(spark, sf_dir, "documents")))


_RUNS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{c0}-\x{ff}]+')"
OP11_SQL = f"""with recursive {CRC_TABLE_SQL}, said as (select coalesce(doc_id::varchar, '') || ':' || run as said, run, count(*) as n from (select doc_id, unnest({_RUNS_SQL}) as run from documents) where length(run) >= 7 group by all),
hashed as (select run, n, {crc_sql('said')} as h from said, crc_table),
words as (select word, sum(n)::bigint as n from (select n, case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed) where length(word) >= 7 group by word having sum(n) >= 2),
places as (select word, n, unnest(range(1, length(word) + 1))::int as k from words),
opened as (select word, n, substr(word, 1, k - 1) || '*' || substr(word, k + 1) as key from places), less as (select distinct word, n, substr(word, 1, k - 1) || substr(word, k + 1) as key from places),
gone as (select l.word as a, l.n as a_n, w.word as b, w.n as b_n from less l join words w on w.word = l.key),
near as (select a as word, b as other, b_n as other_n from gone union all select b, a, a_n from gone union all select o.word, p.word, p.n from opened o join opened p on o.key = p.key and o.word <> p.word),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word),
forms as (select w.word, case when other_n >= 10 * n then other end as form, n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * n then other_n end as form_n from words w left join best using (word)),
steps as (select word, word as here, 0 as k from words union all select s.word, f.form, k + 1 from steps s join forms f on f.word = s.here where f.form is not null),
ends as (select word, arg_max(here, k) as root from steps group by word)
select word, form, root, n::bigint as n, n_near::bigint as n_near, form_n::bigint as form_n from forms join ends using (word)"""
