"""Secrets in texts, told from copied examples by who else has them.

Patterns find assignments, access keys and hexadecimal runs, and candidates: long runs of mixed letters and
digits outside those. The values' hashes are counted over the whole corpus by distinct repositories and
owners. A value that few own is live-looking, a value that many have copied is an example; candidates that
are live-looking become spans of their own, kind `live`. Values themselves leave the worker as hashes only.

Matches are leftmost and don't overlap within a kind; what fails its length is dropped after it has taken
its letters. Positions are code points, ends exclusive.

Nulls and odd rows: a null text is empty; a null repository or owner counts as one named ''. Each row is a
document, so repeated rows each get their spans, and count once for their owner. Two spans that start at
the same place are listed in the order of KINDS. Other columns of docs are not read."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, store, table

KINDS = ("assign", "access", "hex", "live")
#: Owners and repositories up to which a value is live-looking.
OWNERS, REPOSITORIES = 2, 3
#: A value in more than this share of all rows of candidates is joined by broadcast; there are at most 1 / HOT.
HOT = 1e-3
ROWS = 64


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The names of what is assigned (fixed by the query's contract), in either case of ASCII letters alone.
_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
#: A candidate: this, with a small and a capital letter, two digits and ten different characters.
BARE = "[A-Za-z0-9+/_-]{20,}"
LEAST = (12, 18, 16)
_ASSIGN = re.compile(ASSIGN)
#: With its least length in it a run's pattern finds the same runs, without stopping at each short one.
_RUNS = ((1, re.compile("AKIA[A-Z0-9]{14,}")), (2, re.compile("[0-9a-f]{16,}")))
_BARE = re.compile(BARE)

FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("hash", T.StringType())]))


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the three base kinds, by start, then kind."""
    if not text:
        return []
    found = [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST[0]]
    found += [(k, m.start(), m.end(), m[0]) for k, runs in _RUNS for m in runs.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def looks_random(value: str) -> bool:
    return sum(c.isdigit() for c in value) >= 2 and any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value) and len(set(value)) >= 10


def candidates(text: str | None, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking runs that overlap no base span, as spans of kind 3."""
    runs = [(3, m.start(), m.end(), m[0]) for m in _BARE.finditer(text or "") if looks_random(m[0])]
    out, ahead, taken = [], sorted((s, e) for _, s, e, _ in base), 0
    k = 0
    for run in runs:
        while k < len(ahead) and ahead[k][0] < run[2]:
            taken = max(taken, ahead[k][1])
            k += 1
        if taken <= run[1]:
            out.append(run)
    return out


def _scan(ids, repositories, owners, texts):
    rows = []
    for t in texts:
        base = base_spans(t)
        rows.append([(k, s, e, hashlib.blake2b(v.encode(), digest_size=16).hexdigest()) for k, s, e, v in sorted(base + candidates(t, base), key=lambda s: (s[1], s[0]))])
    return ids, repositories, owners, rows


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scanned(docs: DataFrame, repository: Column | str, owner: Column | str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, repository, owner, found) for each row of docs, stored; `row` numbers the stored rows."""
    named = docs.select(F.col(doc_id).alias("id"), *(F.coalesce(_column(c).cast("string"), F.lit("")).alias(n) for c, n in ((repository, "repository"), (owner, "owner"))), F.col(text).alias("text"))
    schema = T.StructType([*named.schema.fields[:3], T.StructField("found", FOUND)])
    return store(map_rows(named, _scan, schema, ROWS).withColumn("row", F.monotonically_increasing_id()), "candidates")


def ownership(spans: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """(hash, n, n_repositories, n_owners, live) from spans(hash, repository, owner): counted by pairs first,
    so a value that a third of all rows has is a few rows by then."""
    by_pair = spans.groupBy("hash", "repository", "owner").agg(F.count("*").alias("n"))
    counted = by_pair.groupBy("hash").agg(F.sum("n").alias("n"), F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))
    return counted.withColumn("live", (F.col("n_owners") <= owners) & (F.col("n_repositories") <= repositories))


def judged(scanned_rows: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """(row, id, kind, start, end, hash, n_repositories, n_owners, live), a row for each span and candidate of
    scanned(). Values that more than HOT of the spans have are few and go by broadcast, the others by shuffle."""
    spans = scanned_rows.select("row", "id", "repository", "owner", F.inline("found"))
    known = store(ownership(spans, owners, repositories), "ownership")
    total = known.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > HOT * total
    hot = F.broadcast(known.filter(often).drop("n"))  # at most 1 / HOT rows
    spans = spans.drop("repository", "owner")
    return spans.join(hot, "hash").unionByName(spans.join(hot, "hash", "left_anti").join(known.filter(~often).drop("n"), "hash"))


def _listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas, in their order."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def digests(scanned_rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for each row of scanned(), with the live spans of judged()."""
    live = spans.filter("kind = 3 and live").groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("live"))
    base = F.filter("found", lambda s: s["kind"] < 3)
    rows = scanned_rows.withColumn("base", base).join(live, "row", "left")
    every = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))), F.coalesce("live", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return rows.select("id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"))


def op12_secret_scan(spark, sf_dir):
    """A document's source is its owner; the source and the language name its repository."""
    rows = scanned(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang"), "source")
    return digests(rows, judged(rows)).withColumnRenamed("id", "doc_id")


def _sql_spans(kind: int, pattern: str) -> str:
    """Matches by marks: private letters put around each, the text cut at them, lengths summed."""
    quoted = pattern.replace("'", "''")
    return f"""select nth, doc_id, repository, owner, {kind} as kind, starts as "start", starts + length(hit) as "end", {f"regexp_extract(hit, '{quoted}', 2)" if kind == 0 else 'hit'} as v from (
  select nth, doc_id, repository, owner, k, split_part(piece, chr(57345), 1) as hit, sum(length(replace(piece, chr(57345), ''))) over (partition by nth order by k) - length(replace(piece, chr(57345), '')) as starts from (
    select nth, doc_id, repository, owner, unnest(pieces) as piece, generate_subscripts(pieces, 1) as k from (select *, string_split(regexp_replace(text, '({quoted})', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) as pieces from d))) where k > 1"""


#: Texts that have U+E000 or U+E001 would mislead it; the tables have none.
OP12_SQL = f"""with d as (select row_number() over () as nth, doc_id, coalesce(text, '') as text, concat_ws('/', source, lang) as repository, coalesce(source, '') as owner from documents),
base as (select * from ({' union all '.join(_sql_spans(k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX)))}) where length(v) >= case kind when 0 then {LEAST[0]} when 1 then {LEAST[1]} else {LEAST[2]} end),
bare as (select * from ({_sql_spans(3, BARE)}) b where regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[0-9][^0-9]*[0-9]') and len(list_distinct(string_split(v, ''))) >= 10
  and not exists (select 1 from base q where q.nth = b.nth and q."start" < b."end" and b."start" < q."end")),
live as (select v from (select v, repository, owner from base union all select v, repository, owner from bare) group by v having count(distinct owner) <= {OWNERS} and count(distinct repository) <= {REPOSITORIES}),
spans as (select nth, kind, "start", "end" from base union all select nth, kind, "start", "end" from bare where v in (select v from live)),
said as (select nth, kind, "start" as s, case kind when 0 then 'assign' when 1 then 'access' when 2 then 'hex' else 'live' end || ':' || ("start")::bigint || ':' || ("end")::bigint as span from spans)
select doc_id, count(case when kind = 0 then 1 end)::bigint as n_assign, count(case when kind = 1 then 1 end)::bigint as n_access, count(case when kind = 2 then 1 end)::bigint as n_hex,
  sha256(coalesce(string_agg(case when kind < 3 then span end, ',' order by s, kind), '')) as base_sha256, coalesce(string_agg(span, ',' order by s, kind), '') as spans
from d left join said using (nth) group by nth, doc_id"""
