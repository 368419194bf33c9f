"""Language-model scores: a gated recurrent network over words with a class-factored output.

Tokens are a text's words, A-Z lowered, and an end. Every training document is counted and trained on.

Counts. Texts are read once. Blocks of documents number their distinct words, send each once, with its
count in training documents, to the word's hash bucket and get the global count back (as in bpe.py).
Blocks are stored with words, numbers and counts; training and scoring read only them. Buckets also
send their most frequent words and the mass of each word class; of those, a number that the model's
size bounds reaches the driver.

Model. The TOP most frequent words stand for themselves, in classes by rank; all others, known or
not, fall in one of TAILS classes by their spelling. The network predicts the class by softmax, then
the word in its class: by softmax for top words, by its share of the class's training mass otherwise
(with the same half count per word, and for the unknown, as the unigram base).
P(word) = P(class | state) P(word | class, state).

Training. A bounded sample of documents (WARM tokens) gives a start; then each task goes over all
training documents of its blocks by truncated backpropagation in numpy: many documents abreast,
gradients cut after STEPS tokens, the state carried through each whole document and cleared at its
start. Where only few documents are left abreast, windows are longer (the gradients' cuts stay), and
steps on few tokens as much smaller. The tasks' weights are averaged by tokens: partial sums in Spark,
then one row for each shuffle partition. So the model, and with it the score, depends a little on how
the table is cut into tasks. Scoring carries the state in the same way.

Defined results: a null text counts as empty, its only token is the end. A null id has the fold of
crc32(''). Repeated rows get equal results. Without training documents all counts are 0 and the
network is untrained. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import buckets_of, crc_of_id, fields, pack, pack_words, store, table, unpack, unpack_words

FOLDS, HELD_OUT = 5, 1
TOP, IN_CLASS, TAILS, HIDDEN = 512, 32, 32, 16
CLASSES = TOP // IN_CLASS + TAILS
LANES, STEPS, WARM = 512, 16, 1_000_000
#: Tokens held at once in a task, about.
HELD = 6_000_000
#: Rows in which sums over tasks or buckets reach the driver.
FEW = 16
END = b" "  # no word has a space
BLOCK, WORDS, VOCABULARY = 0, 1, 2
#: Tokens in a block, about, for up to 256 buckets; in proportion for more, up to eight times that.
BLOCK_WORDS = 1 << 21


def tail_class(word: bytes) -> int:
    """Class of a word that isn't a top word, by its last four bytes: the sign it ends with, if any,
    and its last letters."""
    end = word[-4:]
    if end not in _tails:
        bare = end.rstrip(b".,;:!?\"')#%&*$")
        sign = 0 if len(bare) == len(end) else 1 if end[-1:] in b".," else 2
        _tails[end] = (zlib.crc32(bare[-3:]) % 11 + 11 * sign) % TAILS
        if len(_tails) > 500_000:
            _tails.clear()
            return tail_class(word)
    return _tails[end]


_tails: dict[bytes, int] = {}


# ---- counts


def _blocks(docs: DataFrame, buckets: int, id_type) -> DataFrame:
    """Rows (kind, key, block, ids, payload): each block with its words, and its words for each bucket."""
    schema = T.StructType([*fields("kind int, key long, block long").fields, T.StructField("ids", T.ArrayType(id_type)), T.StructField("payload", T.BinaryType())])
    arrow, most = to_arrow_schema(schema), BLOCK_WORDS * min(8, max(1, buckets // 256))

    def flush(block, ids, marks, held, counts, numbers, words):
        seq = np.concatenate(numbers)
        raw, held = list(words), np.array(held, np.uint8)
        train = np.bincount(seq[np.repeat(held == 0, counts)], minlength=len(raw))
        bucket = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % buckets
        order = np.argsort(bucket, kind="stable")  # words in the order in which their counts come back
        rank = np.empty(len(raw), np.uint32)
        rank[order] = np.arange(len(raw), dtype=np.uint32)
        seq, raw, bucket, train = rank[seq], [raw[k] for k in order.tolist()], bucket[order], train[order].astype(np.uint32)
        rows = [(BLOCK, block, block, ids, pack(np.array(marks, np.int64), held, np.array(counts, np.uint32), (seq & 0xFFFF).astype(np.uint16), (seq >> 16).astype(np.uint16), *pack_words(raw)))]
        for part in np.split(np.arange(len(raw)), np.flatnonzero(np.diff(bucket)) + 1):
            a, b = int(part[0]), int(part[-1]) + 1
            rows.append((WORDS, int(bucket[a]), block, None, pack(*pack_words(raw[a:b]), train[a:b])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    def numbered():
        return defaultdict(itertools.count().__next__)  # a new word gets the next number

    def over(batches):
        task, nth = TaskContext.get().partitionId(), 0
        ids, marks, held, counts, numbers, words, size = [], [], [], [], [], numbered(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own_ids, own_marks, texts = batch.slice(at, 256).columns
                for i, mark, t in zip(own_ids.to_pylist(), own_marks.to_pylist(), texts.cast(pa.binary()).to_pylist()):
                    tokens = [*(t or b"").lower().split(), END]  # A-Z alone, and the six spaces
                    numbers.append(np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)))
                    ids.append(i)
                    marks.append(mark)
                    held.append(crc_of_id(i) % FOLDS == HELD_OUT)
                    counts.append(len(tokens))
                    size += len(tokens)
                    if size >= most:
                        yield flush(task << 32 | nth, ids, marks, held, counts, numbers, words)
                        nth, ids, marks, held, counts, numbers, words, size = nth + 1, [], [], [], [], [], numbered(), 0
        if ids:
            yield flush(task << 32 | nth, ids, marks, held, counts, numbers, words)

    return docs.mapInArrow(over, schema)


def counted(docs: DataFrame) -> DataFrame:
    """From docs(id, mark, text): rows (kind, ids, payload, known): blocks with the global count of each of
    their words, kind BLOCK, and the buckets' vocabulary, kind VOCABULARY."""
    spark, id_type = docs.sparkSession, docs.schema["id"].dataType
    buckets = buckets_of(spark, 2)
    blocks = _blocks(docs, buckets, id_type).repartition(buckets_of(spark), "kind", "key")
    back = fields("kind int, key long, bucket long, payload binary")
    back_arrow = to_arrow_schema(back)
    out = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), *fields("payload binary, known binary").fields])
    out_arrow = to_arrow_schema(out)

    def count(key, rows):
        kind, bucket = (k.as_py() for k in key)
        if kind != WORDS:
            return back_arrow.empty_table()
        total, parts = {}, []
        for blob in rows.column("payload"):
            lengths, raw, n = unpack(blob.as_py())
            words = unpack_words(lengths, raw)
            parts.append(words)
            for w, k in zip(words, n.tolist()):
                total[w] = total.get(w, 0) + k
        names = rows.column("block").to_pylist()
        made = [(BLOCK, b, bucket, pack(np.fromiter(map(total.__getitem__, p), np.int64, len(p)))) for b, p in zip(names, parts)]
        end = [(-total[END], END)] if total.get(END) else []  # the end is kept, however rare
        most = heapq.nsmallest(TOP, ((-n, w) for w, n in total.items() if n and w != END)) + end
        masses = np.bincount([tail_class(w) for w in total], [n + 0.5 if n else 0.0 for n in total.values()], TAILS)
        known = np.array([sum(total.values()), sum(map(bool, total.values()))], np.int64)
        made.append((VOCABULARY, bucket, bucket, pack(known, masses, np.array([-n for n, _ in most], np.int64), *pack_words([w for _, w in most]))))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), back_arrow.types)], schema=back_arrow)

    def put_together(key, block, found):
        kind = key[0].as_py()
        if kind == VOCABULARY:
            n = found.num_rows
            return pa.Table.from_arrays([pa.array([kind] * n, pa.int32()), pa.nulls(n, out_arrow.types[1]), found.column("payload").combine_chunks(), pa.nulls(n, pa.binary())], schema=out_arrow)
        if kind != BLOCK:
            return out_arrow.empty_table()
        got = [unpack(p)[0] for _, p in sorted(zip(found.column("bucket").to_pylist(), found.column("payload").to_pylist()))]
        return pa.Table.from_arrays([pa.array([kind], pa.int32()), block.column("ids").combine_chunks(), block.column("payload").combine_chunks(), pa.array([pack(np.concatenate(got))], pa.binary())], schema=out_arrow)

    found = blocks.groupBy("kind", "key").applyInArrow(count, back)
    return blocks.groupBy("kind", "key").cogroup(found.groupBy("kind", "key")).applyInArrow(put_together, out)


class Block:
    """A stored block: for each document its mark, fold and tokens; for each distinct word its global count."""

    def __init__(self, payload: bytes, known: bytes):
        self.marks, self.held, counts, low, high, lengths, raw = unpack(payload)
        self.words, self.known = unpack_words(lengths, raw), unpack(known)[0]
        if len(self.words) != len(self.known):
            raise ValueError(f"a block of {len(self.words)} words got the counts of {len(self.known)}")
        self.seq = low.astype(np.int64) | high.astype(np.int64) << 16
        self.counts = counts.astype(np.int64)
        self.ends = np.cumsum(self.counts)

    def codes(self, top: dict[bytes, int]) -> list[np.ndarray]:
        """Each document's tokens as codes: the rank of top words, TOP + class of others."""
        own = np.fromiter((top[w] if w in top else TOP + tail_class(w) for w in self.words), np.int32, len(self.words))
        return np.split(own[self.seq], self.ends[:-1])

    def sums(self, of_word: np.ndarray) -> np.ndarray:
        """The sum over each document's tokens."""
        return np.add.reduceat(of_word[self.seq], self.ends - self.counts)


def merged(vocabulary: DataFrame, groups: int) -> DataFrame:
    """Vocabulary rows (at, payload) of equal at as one: totals and masses added, the TOP most frequent words."""
    schema = fields("at long, payload binary")

    def merge(key, rows):
        known, masses, words = np.zeros(2, np.int64), np.zeros(TAILS), {}
        for blob in rows.column("payload"):
            k, m, n, lengths, raw = unpack(blob.as_py())
            known, masses = known + k, masses + m
            words |= dict(zip(unpack_words(lengths, raw), n.tolist()))  # a word is in one bucket
        end = words.pop(END, 0)
        most = heapq.nsmallest(TOP, ((-n, w) for w, n in words.items())) + [(-end, END)] * bool(end)
        blob = pack(known, masses, np.array([-n for n, _ in most], np.int64), *pack_words([w for _, w in most]))
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([blob], pa.binary())], names=schema.names)

    return vocabulary.withColumn("at", F.col("at") % groups).groupBy("at").applyInArrow(merge, schema)


class Vocabulary:
    """Totals N and V, the top words with their counts, and the training mass of each tail class."""

    def __init__(self, parts: list[bytes]):
        self.total = self.distinct = 0
        masses, words = np.zeros(TAILS), {}
        for blob in parts:
            known, mass, n, lengths, raw = unpack(blob)
            self.total += int(known[0])
            self.distinct += int(known[1])
            masses += mass
            words |= dict(zip(unpack_words(lengths, raw), n.tolist()))
        end = words.pop(END, 0)
        top = sorted(words, key=lambda w: (-words[w], w))[: TOP - 1]
        self.words = [END, *top]
        self.counts = np.array([end, *(words[w] for w in top)])
        for w, n in zip(self.words, self.counts.tolist()):
            masses[tail_class(w)] -= n + 0.5 if n else 0.0
        self.log_masses = np.log10(np.maximum(0.0, masses) + 0.5)
        self.codes = {w: k for k, w in enumerate(self.words)}

    def base(self, log_sum, n_tokens):
        return log_sum - n_tokens * np.log10(self.total + 0.5 * (self.distinct + 1))


# ---- the network

SHAPES = {"E": (TOP + TAILS + 1, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "C": (HIDDEN + 1, CLASSES), "W": (TOP // IN_CLASS, HIDDEN + 1, IN_CLASS)}
START = TOP + TAILS


def fresh(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (rng.standard_normal(s) * (0.3 if k == "U" else 0.1)).astype(np.float32) for k, s in SHAPES.items()}


def flat(weights: dict) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def shaped(a: np.ndarray) -> dict[str, np.ndarray]:
    """Views into a, if that is of single precision."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = a[at : at + n].reshape(s).astype(np.float32, copy=False)
        at += n
    return out


class Streams:
    """Documents laid end to end in lanes of about equal length, the longest lane first."""

    def __init__(self, docs: list[np.ndarray], lanes: int = LANES, mixed: int | None = None):
        """mixed: a seed by which each lane's documents are put in random order."""
        heap = [(0, k) for k in range(min(lanes, max(1, len(docs))))]
        rows: list[list[int]] = [[] for _ in heap]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            n, k = heapq.heappop(heap)
            rows[k].append(d)
            heapq.heappush(heap, (n + len(docs[d]), k))
        if mixed is not None:
            rng = np.random.default_rng(mixed)
            rows = [rng.permutation(r).tolist() for r in rows]
        rows.sort(key=lambda r: -sum(len(docs[d]) for d in r))
        self.order = [d for r in rows for d in r]
        sizes = np.array([len(docs[d]) for d in self.order], np.int64)
        self.codes = np.concatenate([docs[d] for d in self.order]) if docs else np.empty(0, np.int32)
        self.starts = np.cumsum(sizes) - sizes
        self.lengths = np.array([sum(len(docs[d]) for d in r) for r in rows], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        before = np.concatenate([[START], self.codes[:-1]]).astype(np.int32)
        before[self.starts] = START
        self.before = before

    def windows(self, tokens: int = LANES * STEPS):
        """(place of each step and lane, whether it is one) for each window; lanes that ended are left out. Where
        lanes are few, a window is some times STEPS long, up to about so many tokens, with a quarter of its lanes
        ending in it at most."""
        t, longest = 0, int(self.lengths[0]) if len(self.lengths) else 0
        while t < longest:
            n = int(np.searchsorted(-self.lengths, -t))
            most = min(tokens // n, int(self.lengths[3 * n // 4]) - t)
            size = min(STEPS, longest - t) if most <= STEPS else -(-most // STEPS) * STEPS
            steps = t + np.arange(size)[:, None]
            live = steps < self.lengths[:n]
            yield self.offsets[:n] + np.minimum(steps, self.lengths[:n] - 1), live
            t += size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def forward(w: dict, x: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each step of x (steps, lanes), from h (lanes, units); a document's start clears the state.

    Here and below a unit's values of all steps and lanes lie side by side, so that each operation runs over
    long rows; arrays that go in and come out are views with the units last."""
    n, h = HIDDEN, h.T
    out, of_x, going = np.empty((n, *x.shape), w["U"].dtype), np.take(w["E"].T, x, axis=1), x != START
    cleared, of_h, kept = (~going.all(1)).tolist(), np.ascontiguousarray(w["U"].T), None
    if keep is not None:  # states before, the state's part of the candidate, gates, candidates
        kept = [np.empty((k * n, *x.shape), out.dtype) for k in (1, 1, 2, 1)]
        keep.extend(kept)
    for t in range(len(x)):
        if cleared[t]:
            h = h * going[t]
        a, u = of_x[:, t], of_h @ h
        rz = _sigmoid(a[: 2 * n] + u[: 2 * n])
        g = rz[:n] * u[2 * n :]
        g += a[2 * n :]
        np.tanh(g, out=g)
        if kept:
            for to, k in zip(kept, (h, u[2 * n :], rz, g)):
                to[:, t] = k
        after = out[:, t]
        np.subtract(h, g, out=after)
        after *= rz[n:]
        after += g
        h = after
    return out.transpose(1, 2, 0)


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials, their sum) of each column, its largest taken off the logits in place first."""
    logits -= logits.max(0)
    e = np.exp(logits)
    return e, e.sum(0)


def classes_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < TOP, codes // IN_CLASS, codes - TOP + TOP // IN_CLASS)


def output(w: dict, h: np.ndarray, codes: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural-log probability of each code's class and, for top words, of the word in it; and, if
    grad is given, the loss's gradient by h, adding those by the weights to grad."""
    n, k, h = HIDDEN, classes_of(codes), h.T

    def part(weights: np.ndarray, of_weights: np.ndarray | None, h: np.ndarray, picked: np.ndarray):
        rows, logits = np.arange(len(picked)), weights[:n].T @ h
        logits += weights[n][:, None]
        e, total = _softmax(logits)
        p = logits[picked, rows] - np.log(total)
        if of_weights is None:
            return p, None
        e /= total
        e[picked, rows] -= 1
        of_weights[:n] += h @ e.T
        of_weights[n] += e.sum(1)
        return p, weights[:n] @ e

    p, dh = part(w["C"], grad and grad["C"], h, k)
    order = np.argsort(k.astype(np.uint8 if CLASSES < 256 else np.int64), kind="stable")
    ends = np.searchsorted(k[order], np.arange(TOP // IN_CLASS + 1))
    order = order[: ends[-1]]
    own, at = h[:, order], codes[order] % IN_CLASS
    more, dh_own = np.empty(len(order), p.dtype), np.empty_like(own)
    for c, (a, b) in enumerate(zip(ends, ends[1:])):
        if b > a:
            more[a:b], d = part(w["W"][c], grad and grad["W"][c], own[:, a:b], at[a:b])
            if grad:
                dh_own[:, a:b] = d
    p[order] += more
    if not grad:
        return p, None
    dh[:, order] += dh_own
    return p, dh.T


def _abreast(a: np.ndarray) -> np.ndarray:
    """(..., steps, lanes) with each STEPS steps of a longer window as lanes of their own."""
    *rest, steps, lanes = a.shape
    if steps <= STEPS:
        return a
    return a.reshape(*rest, steps // STEPS, STEPS, lanes).swapaxes(-3, -2).reshape(*rest, STEPS, -1)


def backward(w: dict, x: np.ndarray, kept: list, dh_out: np.ndarray, grad: dict) -> None:
    """Backpropagation through the window's steps, cut after each STEPS."""
    n, x = HIDDEN, _abreast(x)
    h, ug, rz, g, dh_out = map(_abreast, (*kept, dh_out.transpose(2, 0, 1)))
    r, z, going = rz[:n], rz[n:], x != START
    # what the gradient by a state or a candidate's sum is multiplied by
    to_candidate, to_r, to_z = (1 - z) * (1 - g * g), ug * (r * (1 - r)), (h - g) * (z * (1 - z))
    d = np.empty((4 * n, *x.shape), np.float32)  # by the sums of both gates, by the state's part of the candidate, by its sum
    cleared, u = (~going.all(1)).tolist(), np.ascontiguousarray(w["U"])
    dh = np.zeros_like(dh_out[:, 0])
    for t in range(len(x) - 1, -1, -1):
        dh = dh + dh_out[:, t]
        dt = d[:, t]
        dg = np.multiply(dh, to_candidate[:, t], out=dt[3 * n :])
        np.multiply(dg, to_r[:, t], out=dt[:n])
        np.multiply(dh, to_z[:, t], out=dt[n : 2 * n])
        np.multiply(dg, r[:, t], out=dt[2 * n : 3 * n])
        dh *= z[:, t]
        dh += u @ dt[: 3 * n]
        if cleared[t]:
            dh *= going[t]
    d = d.reshape(4 * n, -1)
    grad["U"] += h.reshape(n, -1) @ d[: 3 * n].T
    ids = x.ravel()
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    d[2 * n : 3 * n] = d[3 * n :]
    grad["E"][ids[order[first]]] += np.add.reduceat(np.take(d[: 3 * n], order, axis=1), first, axis=1).T


class Trainer:
    """Adam over windows of documents, each whole."""

    def __init__(self, weights: dict, rate: float):
        self.all, self.rate, self.steps = flat(weights), rate, 0
        self.m, self.v, self.w = np.zeros_like(self.all), np.zeros_like(self.all), shaped(self.all)

    def over(self, docs: list[np.ndarray]) -> None:
        streams = Streams(docs, mixed=len(docs))
        h = np.zeros((len(streams.lengths), HIDDEN), np.float32)
        for at, live in streams.windows():
            x, keep = streams.before[at], []
            states = forward(self.w, x, h[: at.shape[1]], keep)
            h = states[-1]
            total = np.zeros_like(self.all)
            grad = shaped(total)
            on = np.flatnonzero(live)
            _, d = output(self.w, _chosen(states, on), streams.codes[at.ravel()[on]], grad)
            dh = d.T
            if len(on) < live.size:
                dh = np.zeros((HIDDEN, live.size), np.float32)
                dh[:, on] = d.T
            backward(self.w, x, keep, dh.reshape(HIDDEN, *x.shape).transpose(1, 2, 0), grad)
            self._step(total, max(1, len(on)))

    def _step(self, grad: np.ndarray, n: int) -> None:
        """n: tokens of the window; below an eighth of a full one the step is shorter in proportion."""
        self.steps += 1
        a, b, rate = 1 - 0.9**self.steps, 1 - 0.99**self.steps, self.rate * min(1.0, 8 * n / (LANES * STEPS))
        grad *= np.float32(1 / n)
        self.m += 0.1 * (grad - self.m)
        grad *= grad
        self.v += 0.01 * (grad - self.v)
        size = np.sqrt(self.v * np.float32(1 / b))
        size += 1e-6
        self.all -= rate / a * self.m / size


def _chosen(states: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The rows of states (steps, lanes, units) at the places `on` of steps and lanes."""
    flat_states = states.transpose(2, 0, 1).reshape(HIDDEN, -1)
    return (flat_states if len(on) == flat_states.shape[1] else flat_states[:, on]).T


def log_probabilities(w: dict, docs: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each document's classes and top words, the state carried through it."""
    if not docs:
        return np.empty(0)
    streams = Streams(docs, 2 * LANES)
    p = np.zeros(len(streams.codes), np.float64)
    h = np.zeros((len(streams.lengths), HIDDEN), np.float32)
    for at, live in streams.windows():
        states = forward(w, streams.before[at], h[: at.shape[1]])
        h = states[-1]
        on = np.flatnonzero(live)
        places = at.ravel()[on]
        p[places] = output(w, _chosen(states, on), streams.codes[places])[0]
    out = np.empty(len(docs))
    out[streams.order] = np.add.reduceat(p, streams.starts) / np.log(10)
    return out


# ---- on Spark


def _trained(parts: DataFrame, codes_of, start: np.ndarray, rate: float, most: float = float("inf")) -> tuple[np.ndarray, float]:
    """Weights after each partition of `parts` went on from `start`, averaged by tokens. codes_of gives the
    documents of a row; `most`: tokens after which a task stops."""
    groups = buckets_of(parts.sparkSession)
    schema = fields("at int, n double, weights binary")

    def learn(batches):
        trainer, held, size, total = Trainer(shaped(start), rate), [], 0, 0
        for batch in batches:
            for row in zip(*batch.columns):
                if total + size >= most:
                    break
                for own in codes_of(*(x.as_py() for x in row)):
                    held.append(own)
                    size += len(own)
                    if size >= HELD:
                        trainer.over(held)
                        total, held, size = total + size, [], 0
        if held:
            trainer.over(held)
        total += size
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups], pa.int32()), pa.array([float(total)]), pa.array([(flat(trainer.w).astype(np.float64) * total).tobytes()], pa.binary())], names=schema.names)

    def add(key, rows):
        total = sum(np.frombuffer(b.as_py(), np.float64) for b in rows.column("weights"))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([sum(rows.column("n").to_pylist())]), pa.array([total.tobytes()], pa.binary())], names=schema.names)

    done = parts.mapInArrow(learn, schema).groupBy("at").applyInArrow(add, schema)
    done = done.withColumn("at", F.col("at") % FEW).groupBy("at").applyInArrow(add, schema).collect()  # at most FEW rows
    total = sum(r["n"] for r in done)
    return (sum(np.frombuffer(r["weights"], np.float64) for r in done) / total if done else start), total


def below(n_train_tokens: int) -> int:
    """Marks, as unsigned 64-bit numbers, under which documents are of the warm start: about WARM tokens, and
    never none, however many tokens there are."""
    return max(1 << 20, min(1 << 64, (WARM << 64) // max(1, n_train_tokens)))


def train(blocks: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """The network trained on all training documents of the blocks(payload, known)."""
    start = flat(fresh())
    if not vocabulary.total:
        return shaped(start)
    codes, bound, schema = vocabulary.codes, below(vocabulary.total), fields("mark long, codes binary")

    def sample(batches):
        for batch in batches:
            for payload, known in zip(*batch.columns):
                marks, held = unpack(payload.as_py())[:2]
                own = np.flatnonzero((held == 0) & (marks.view(np.uint64) <= np.uint64(bound - 1)))
                if len(own):
                    docs = Block(payload.as_py(), known.as_py()).codes(codes)
                    yield pa.RecordBatch.from_arrays([pa.array(marks[own]), pa.array([pack(docs[k]) for k in own.tolist()], pa.binary())], names=schema.names)

    warm = blocks.mapInArrow(sample, schema).dropDuplicates(["mark"]).repartition(1).sortWithinPartitions("mark")  # about WARM tokens
    start, _ = _trained(warm.select("codes"), lambda blob: unpack(blob), start, 0.02, 2 * WARM)

    def documents(payload, known):
        block = Block(payload, known)
        return [c for c, held in zip(block.codes(codes), block.held.tolist()) if not held]

    return shaped(_trained(blocks, documents, start, 0.004)[0])


def score(blocks: DataFrame, weights: dict, vocabulary: Vocabulary) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base_score, score) of all documents of the blocks(ids, payload, known)."""
    schema = T.StructType([T.StructField("id", blocks.schema["ids"].dataType.elementType), *fields("held_out boolean, n_tokens long, n_known long, base_score double, score double").fields])
    arrow, codes, masses, counts = to_arrow_schema(schema), vocabulary.codes, vocabulary.log_masses, vocabulary.counts
    per_token = float(np.log10(vocabulary.total + 0.5 * (vocabulary.distinct + 1)))

    of_code = np.concatenate([-np.log10(counts + 0.5), np.zeros(TOP - len(counts)), -masses])  # what isn't a word's own share

    def over(batches):
        def flush():
            each = log_probabilities(weights, [c for _, _, docs in held for c in docs])
            for ids, block, docs in held:
                logs, n = block.sums(np.log10(block.known + 0.5)), len(docs)
                own = logs + np.add.reduceat(of_code[np.concatenate(docs)], block.ends - block.counts)
                cols = [ids.values, pa.array(block.held == 1), pa.array(block.counts), pa.array(block.sums((block.known > 0).astype(np.int64))), pa.array(logs - block.counts * per_token), pa.array(each[:n] + own)]
                each = each[n:]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

        held, size = [], 0
        for batch in batches:
            for ids, payload, known in zip(*batch.columns):
                block = Block(payload.as_py(), known.as_py())
                held.append((ids, block, block.codes(codes)))
                size += int(block.ends[-1])
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return blocks.mapInArrow(over, schema)


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, base_score, score, train_tokens) for each row of docs."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).alias("mark"), F.col(text).alias("text"))
    found = store(counted(keyed), "counts")
    rows = found.filter(F.col("kind") == VOCABULARY).select(F.pmod(F.xxhash64("payload"), F.lit(1 << 30)).alias("at"), "payload")
    vocabulary = Vocabulary([r["payload"] for r in merged(merged(rows, buckets_of(spark)), FEW).collect()])  # at most FEW rows
    blocks = found.filter(F.col("kind") == BLOCK).select("ids", "payload", "known")
    weights = train(blocks.select("payload", "known"), vocabulary)
    return score(blocks, weights, vocabulary).withColumn("train_tokens", F.lit(vocabulary.total).cast("long"))


def op7_lm_score(spark, sf_dir):
    found = scored(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
