"""Packing token pieces into sequences of bounded length.

Lengths are all that packing needs, so Spark counts the pieces of each length (at most `capacity`
rows) and the plan is made on counts: large items (over a third of the capacity; two fit a sequence
at most) are matched greedily, the longest with the longest that fits beside it; smaller ones go,
longest first, into the smallest gap that takes them, and open new sequences when there is none.
The plan says how many sequences have which lengths. Its size depends on the capacity alone.

Pieces then find their place by their rank among those of their length. Ranks come from a count
within each task and the sums of the tasks before, so no length, however common, meets in one task.

Texts are tokenized once, as whole texts, by chunks (see chunks.py); the pieces are written to the
shared folder and only they are read afterwards. A text that holds the string of one of the
tokenizer's added tokens gets that token's id there, as the library's plain call gives it.

Defined results: a null text counts as empty and is one piece, the end id alone. Null ids stay null;
repeated rows are packed each. An empty table gives no sequences. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .chunks import Chunks
from .common import fields, store, table

CAPACITY, END_ID = 1024, 2
_encoders: dict = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others for the
    characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _merges(plan: dict, model) -> tuple[dict[bytes, int], np.ndarray] | None:
    """(rank of each token's bytes, id of each rank) if merging whichever two tokens have the union of
    lowest rank gives the model's ids; else None.

    It does if each token is made by one merge and each is what the model makes of its own letters: two
    tokens that stand side by side and cover a token exactly were then made as in that token alone, and
    the only two tokens that such a state can have are those of its merge."""
    bpe, letters = plan["model"], _byte_letters()
    if bpe.get("type") != "BPE" or any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return None
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in bpe["merges"]]
    tokens = [*letters.values(), *made]
    if len(set(tokens)) < len(tokens) or any(t not in bpe["vocab"] for t in tokens) or any(len(model.tokenize(t)) != 1 for t in made):
        return None
    back = {c: b for b, c in letters.items()}
    return {bytes(map(back.__getitem__, t)): k for k, t in enumerate(tokens)}, np.array([bpe["vocab"][t] for t in tokens], np.uint32)


class _Encoder:
    """ids(text) as the tokenizer of a tokenizers JSON file gives them without its post-processor, as bytes.

    Strings of added tokens in a text are their tokens, as in the library's plain call, unless
    `added_as_text`. For byte-level BPE without a normalizer the text between them is cut into chunks
    (see chunks.py) whose ids are kept for later texts and tasks, in a bounded number of bytes. The new
    chunks of a text are merged together, by tiktoken's loop over the file's merges (see _merges); only
    a chunk's first token begins with a space, so the ids part at those. Other tokenizers get whole
    texts."""

    def __init__(self, spec: str, added_as_text: bool):
        import tiktoken
        from tokenizers import Tokenizer

        plan, self.whole = json.loads(spec), Tokenizer.from_str(spec)
        self.whole.encode_special_tokens = added_as_text
        self.whole.no_truncation()
        self.whole.no_padding()
        before = plan.get("pre_tokenizer") or {}
        added = [t for t in plan.get("added_tokens") or () if not (added_as_text and t.get("special"))]
        bytewise = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not plan.get("normalizer")
        found = _merges(plan, self.whole.model) if bytewise and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")) else None
        self.chunked = found is not None
        if found:
            ranks, self.id_of = found
            self.merge = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.begins = np.zeros(len(ranks), bool)
            self.begins[[k for t, k in ranks.items() if t[:1] == b" "]] = True
            self.added = {t["content"]: np.uint32(t["id"]).tobytes() for t in added}
            self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
            self.chunks = Chunks(self._of_chunks)

    def _of_chunks(self, chunks: list[str]) -> list[bytes]:
        if all(c[0] == " " for c in chunks[1:]):
            ranks = np.array(self.merge("".join(chunks)), np.int64)
            ends = np.flatnonzero(self.begins[ranks[1:]]) + 1
            if len(ends) == len(chunks) - 1:
                raw, at = self.id_of[ranks].tobytes(), [0, *(4 * ends).tolist(), 4 * len(ranks)]
                return [raw[a:b] for a, b in zip(at, at[1:])]
        return [self.id_of[np.array(self.merge(c), np.int64)].tobytes() for c in chunks]

    def ids(self, text: str) -> bytes:
        if not self.chunked:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if any(map(text.__contains__, self.added)):
            return b"".join(self.added[p] if k % 2 else b"".join(self.chunks.of(p)) for k, p in enumerate(self.at_added.split(text)))
        return b"".join(self.chunks.of(text))


def _encoder(spec: str, added_as_text: bool) -> _Encoder:
    """One for each Python worker."""
    key = spec, added_as_text
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = _Encoder(*key)
    return _encoders[key]


def cut(n_tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than the capacity."""
    first = (n_tokens - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n_tokens, capacity))]


def token_pieces(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, added_as_text: bool = False) -> DataFrame:
    """(id, piece, start, length, ids, task, nth): nth numbers a task's pieces of each length."""
    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = fields("piece int, start long, length long, ids binary, task int, nth long")
    schema = type(schema)([picked.schema["id"], *schema.fields])
    arrow = to_arrow_schema(schema)
    end = np.uint32(END_ID).tobytes()

    def over(batches):
        task, seen, encoder = TaskContext.get().partitionId(), Counter(), _encoder(spec, added_as_text)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for i, t in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    ids = encoder.ids(t or "") + end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((i, k, start, length, ids[4 * start : 4 * (start + length)], task, seen[length]))
                        seen[length] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return picked.mapInArrow(over, schema)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) for `counts` items of each length."""
    left = {k: n for k, n in counts.items() if n}
    gaps: dict[int, list] = defaultdict(list)

    def put(pattern, n):
        if n:
            gaps[capacity - sum(pattern)].append((pattern, n))

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= min(a, capacity - a) and left[x] > (x == a)), None)
            if b is None:
                put((a,), left[a])
                left[a] = 0
            else:
                n = left[a] // 2 if a == b else min(left[a], left[b])
                put((a, b), n)
                left[a] -= n
                left[b] -= n
    for k in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[k]
        while n:
            gap = min((g for g in gaps if g >= k and gaps[g]), default=None)
            if gap is None:
                gap, pattern, have = capacity, (), -(-n // (capacity // k))
            else:
                pattern, have = gaps[gap].pop()
            each = gap // k
            full = min(have, n // each)
            put(pattern + (k,) * each, full)
            n -= full * each
            have -= full
            if have and n:
                put(pattern + (k,) * n, 1)
                n, have = 0, have - 1
            if pattern:
                put(pattern, have)
    return sorted((p, n) for g in gaps.values() for p, n in g)


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank, the first sequence and the offset of each run of places."""
    runs, taken, sequence = defaultdict(list), Counter(), 0
    for pattern, n in plan:
        at = 0
        for k in pattern:
            runs[k].append((taken[k], sequence, at))
            taken[k] += n
            at += k
        sequence += n
    return {k: tuple(np.array(v, np.int64).T) for k, v in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a stored table with length, task and nth) with sequence_id and offset."""
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    found = places(plan_bins({r["length"]: r["n"] for r in totals}, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(ahead, ["task", "length"]).withColumn("rank", F.col("ahead") + F.col("nth")).drop("ahead", "nth", "task")
    schema = type(ranked.schema)([*ranked.schema.fields, *fields("sequence_id long, offset long").fields])
    arrow = to_arrow_schema(schema)

    def put(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                ranks, first, at = found[int(length[own[0]])]
                run = np.searchsorted(ranks, rank[own], "right") - 1
                sequence[own], offset[own] = first[run] + rank[own] - ranks[run], at[run]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], schema=arrow)

    return ranked.mapInArrow(put, schema).drop("rank")


def best_fit_packing(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = True, added_as_text: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), and the ids as little-endian 32-bit
    numbers if keep_ids. added_as_text: strings of special tokens in a text are ordinary text."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    pieces = token_pieces(docs, spec, doc_id, text, capacity, added_as_text).withColumn("ids_crc32", F.crc32("ids"))
    return pack(store(pieces if keep_ids else pieces.drop("ids"), "pieces"), capacity)


def op2_best_fit_packing(spark, sf_dir):
    packed = best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return packed.withColumnRenamed("id", "doc_id")


