"""Toxicity of deobfuscated text.

1. A character language model: counts of three characters in a row over all texts, a table whose size
   the alphabet bounds.
2. A noisy channel: a suspicious stretch (letters mixed with look-alike digits and signs, letters
   spaced apart, letters repeated) is a lattice of what each character may stand for, whether a run
   is one letter or two, and whether a gap is a word's end. Viterbi finds the likeliest reading.
3. The restored text is scored: which of the chosen words and word beginnings it has, how often and
   how densely, by logistic regression.

Learning: labels come only from the training fold, from at most SAMPLE labelled rows, picked by a
hash of their id (all of them where there are fewer). Words and beginnings are counted over that
sample in Spark; those that toxic texts have significantly more often are chosen, at most CHOSEN.

Defined results: a null text counts as empty; empty texts get the score of no evidence. Rows with a
null id belong to the fold of crc32('') and have no label; of several labels of one id the largest counts. Repeated rows get equal scores; a labels
table without toxic rows, or empty, gives the score 0 to all. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, id_crc, map_rows, pack, store, table, unpack

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
SAMPLE, CHOSEN = 40_000, 4096
#: What a sign may stand for besides itself.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
#: Letters of the model: those of Latin-1 in lower case; all else is one sign, which parts words.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_CODE = np.zeros(256, np.int32)
for _k, _c in enumerate(LETTERS, 1):
    _CODE[ord(_c)] = _k
_N = len(LETTERS) + 1
_AT = {c: k for k, c in enumerate(LETTERS, 1)}


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts [a, b, c] of characters in a row over all texts, words parted by one sign."""

    def count(batches):
        total = np.zeros(_N**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                joined = " ".join(t or "" for t in batch.column(0).slice(at, 512).to_pylist()).lower()
                codes = _CODE[np.frombuffer(joined.encode("latin-1", "replace"), np.uint8)]
                codes = np.concatenate([codes[:1] * 0, codes[:1] * 0, codes[:1], codes[1:][(codes[1:] > 0) | (codes[:-1] > 0)], codes[:1] * 0])
                before = codes[:-2] * (codes[1:-1] > 0)  # nothing is known at a word's start
                total += np.bincount((before * _N + codes[1:-1]) * _N + codes[2:], minlength=_N**3)
        at = np.flatnonzero(total)
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = docs.select(text).mapInArrow(count, fields("at long, n long")).groupBy("at").agg(F.sum("n").alias("n")).collect()  # at most _N ** 3 = 205,379
    out = np.zeros(_N**3)
    for at, n in rows:
        out[at] = n
    return out.reshape(_N, _N, _N)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log p(c | a, b), the trigram's share mixed with the pair's and an even one."""
    three = counts / np.maximum(1, counts.sum(2, keepdims=True))
    pairs = counts.sum(0)
    two = pairs / np.maximum(1, pairs.sum(1, keepdims=True))
    return np.log(0.8 * three + 0.19 * two[None] + 0.01 / _N)


#: Letters spaced apart over several tokens or within one, and a token's part of letters and look-alikes.
SPACED = re.compile(r"(?<![^\s\"'(])[^\W_](?:[ .\-_*]{1,3}[^\W_]){2,}(?!\w)")
#: Letters with up to three signs between; possessive, so a long one is read once.
MIXED = re.compile(r"[^\W\d_]++(?:[0-9@$!|+*(€]{1,3}+[^\W\d_]++)*+")
#: What a mixed part may begin with, end with, and must be followed by unless the token ends.
_LEADING, _TRAILING, _AFTER = frozenset("013457@$!|+*"), frozenset("0123456789@$!|+(€"), frozenset(".,;:!?#%&*$\"')")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_ODD = re.compile(r"[0-9@$!|+*(€]")


def mixed_parts(token: str):
    """(start, end) of the mixed parts: up to three leading signs, the letters, up to two trailing signs, as
    far as to the last place that the token or a sign of _AFTER ends it. Linear in the token's length."""
    since, n = 0, len(token)
    for m in MIXED.finditer(token):
        a, b = m.span()
        end = b
        while end < min(n, b + 2) and token[end] in _TRAILING:
            end += 1
        while end > a and not ((end == n or token[end] in _AFTER) and any(token[e - 1].isalpha() for e in range(end, max(a, end - 3), -1) if all(c in _TRAILING for c in token[e:end]))):
            end -= 1
        start = max(a, since)
        if end <= start:
            continue
        while start > since and a - start < 3 and token[start - 1] in _LEADING:
            start -= 1
        yield start, end
        since = end


#: Pieces of a stretch that are read at once; a longer stretch is read in parts.
PIECES = 4096
_PIECE = re.compile(r"([^\W\d_])\1*|[ .\-_]+|.", re.S)


def _choices(piece: str) -> list[tuple[str, float]]:
    """What a piece of a stretch may stand for, and at what cost."""
    if piece[0].isalpha():
        c = piece[0]
        return [(c, 0.0)] if len(piece) == 1 else [(c + c, 0.0), (c, -2.0)] if len(piece) == 2 else [(c, 0.0), (c + c, -0.5)]
    if piece.strip(" .-_") == "":
        return [("", -0.1), (" ", -2.5)]
    if piece in LOOKS:
        return [(x, -0.3) for x in LOOKS[piece]] + ([] if piece.isalnum() else [("", -8.0)])
    return [("", -3.0)]


def _read_back(link) -> str:
    out = []
    while link:
        link, emitted = link
        out.append(emitted)
    return "".join(reversed(out))


def _moves(states: tuple, piece: str | None, model: np.ndarray) -> tuple[tuple, list]:
    """The states (two last letters) after a piece, and the ways to each: (state before, log probability, read)."""
    ways: dict = {}
    for k, state in enumerate(states):
        for emitted, s in _choices(piece) if piece else [(" ", 0.0)]:
            x, y = state
            for c in emitted:
                at = _AT.get(c, 0)
                s += model[x, y, at]
                x, y = (0, 0) if at == 0 else (y, at)
            ways.setdefault((x, y), []).append((k, float(s), emitted))
    return tuple(ways), list(ways.values())


def viterbi(stretch: str, model: np.ndarray, moves: dict | None = None) -> str:
    """The likeliest reading of a stretch: for each two last letters the best path, as a chain of what was
    read. moves, if given, keeps the steps from a set of states by a piece, over many calls."""
    moves, out = {} if moves is None else moves, []
    pieces = [m[0][:3] for m in _PIECE.finditer(stretch.lower())]
    states, best = ((0, 0),), [(0.0, None)]
    for at, piece in enumerate([*pieces, None], 1):
        found = moves.get((states, piece))
        if found is None:
            if len(moves) > 100_000:
                moves.clear()
            found = moves[states, piece] = _moves(states, piece, model)
        states, ways = found
        after = []
        for way in ways:
            k, s, emitted = way[0]
            score = best[k][0] + s
            for other, s, e in way[1:]:
                if best[other][0] + s > score:
                    k, score, emitted = other, best[other][0] + s, e
            after.append((score, (best[k][1], emitted)))
        best = after
        if at % PIECES == 0:
            k = max(range(len(best)), key=lambda k: best[k][0])
            out.append(_read_back(best[k][1]))
            states, best = (states[k],), [(0.0, None)]
    most = max(s for s, _ in best)
    return ("".join(out) + max(_read_back(path) for s, path in best if s == most)).rstrip(" ")


_SIGNS = {"-", ".", "_", "*"}


class Restorer:
    """Suspicious stretches become their readings; each distinct token is read once."""

    def __init__(self, model: np.ndarray):
        self.model, self.known, self.moves = model, {}, {}

    def _spaced(self, m: re.Match) -> str:
        return viterbi(m[0], self.model, self.moves)

    def _mixed(self, token: str) -> str:
        out, done = [], 0
        for a, b in mixed_parts(token):
            part = token[a:b]
            s = part.rstrip("!*$|+(") or part
            odd = _ODD.search(s) or _RUN.search(s)
            if odd or ("$" in part and s != part and b == len(token)):
                out += [token[done:a], viterbi(s if odd else part, self.model, self.moves)]
                done = b
        return "".join([*out, token[done:]]) if out else token

    def token(self, token: str) -> str:
        if not _ODD.search(token) and not _RUN.search(token) and not (token[1:2] in _SIGNS and SPACED.match(token)):
            return token
        if token not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            at = token.find("@")  # an address isn't obfuscated
            self.known[token] = token if 0 < at < token.rfind(".") - 1 else self._mixed(SPACED.sub(self._spaced, token))
        return self.known[token]

    def words(self, token: str) -> list[str]:
        """The words of the restored token, lower case."""
        return _WORD.findall(self.token(token).lower())

    def gaps(self, text: str, kinds: bytes) -> str:
        """The text with its spaced letters drawn together, if three tokens of one letter follow each other.
        kinds: of each token of the text."""
        if b"\1\1\1" in kinds.translate(_LETTER_OR_SIGN) and kinds.translate(_ONE_LETTER).count(1) > 2:
            return SPACED.sub(self._spaced, text)
        return text

    def __call__(self, text: str) -> str:
        return re.sub(r"\S+", lambda m: self.token(m[0]), self.gaps(text, bytes(map(kind_of, text.split()))))


#: What a byte says of a token: its number of words, MANY for that or more, and the flags.
MANY, LETTER, SIGN, HIT = 7, 8, 16, 32
_LETTER_OR_SIGN, _ONE_LETTER = (bytes(bool(k & flags) for k in range(256)) for flags in (LETTER | SIGN, LETTER))


def kind_of(token: str) -> int:
    """The flags that a token has by itself: a single letter or digit, or a sign that may stand between such."""
    return (LETTER if len(token) < 3 and sum(map(str.isalnum, token)) == 1 else 0) | (SIGN if token in _SIGNS else 0)


class Kinds(dict):
    """The byte of each token met, worked out once: kinds[token]. What doesn't fit in it: `many` has the number of
    words of tokens with MANY, `hits` the units of tokens with a HIT."""

    def __init__(self, restore: Restorer, units, most: int = 500_000):
        """units: the units of a word that count."""
        super().__init__()
        self.restore, self.units, self.most, self.many, self.hits, self.plain = restore, units, most, {}, {}, {}

    def __missing__(self, token: str) -> int:
        n, plain = 1, token.lower().rstrip(".,;:?\"'")
        own = self.plain.get(plain)
        if own is None:
            if plain.isalpha() and not _RUN.search(plain):  # a word and the signs after it: nothing to restore
                own = self.plain[plain] = self.units(plain)
            else:
                words = self.restore.words(token)
                n, own = len(words), [u for w in words for u in self.units(w)]
        kind = kind_of(token) | min(n, MANY)
        if n >= MANY:
            self.many[token] = n
        if own:
            self.hits[token] = own
            kind |= HIT
        self[token] = kind
        return kind

    def of(self, text: str | None) -> tuple[list[str], np.ndarray]:
        """The tokens of the text, spaced letters drawn together, and their bytes."""
        if len(self) > self.most:
            for found in (self, self.many, self.hits, self.plain):
                found.clear()
        tokens = (text or "").split()
        kinds = bytes(map(self.__getitem__, tokens))
        drawn = self.restore.gaps(text or "", kinds)
        if drawn != (text or ""):
            tokens = drawn.split()
            kinds = bytes(map(self.__getitem__, tokens))
        return tokens, np.frombuffer(kinds, np.uint8)

    def total(self, tokens: list[str], kinds: np.ndarray) -> int:
        """The number of words."""
        n = kinds & MANY
        return int(n.sum(dtype=np.int64)) + sum(self.many[tokens[k]] - MANY for k in np.flatnonzero(n == MANY).tolist())


_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = range(4, 10)


def levels(n: int, n_words: int) -> list[int]:
    """How often (1: once, 2: twice, 3: four times or more) and how densely (4: from 1 in 150, 5: from 1 in 40)."""
    return [1, *[k for k, least in ((2, 2), (3, 4)) if n >= least], *[k for k, one_in in ((4, 150), (5, 40)) if n * one_in >= n_words]]


def head_of(word: str) -> int:
    """A hash of the three letters that all units of a word begin with."""
    return (zlib.crc32(word[:3].encode()) & 0xFFFF) << 35


def bases_of(word: str) -> tuple[int, ...]:
    """A number for each of a word's units, which are the word itself, marked by its end, and its beginnings: the
    hash of the word's head, that of the unit, and three bits for the level, which make it a feature."""
    n = len(word)
    if n < 3:
        return ()
    head, raw = head_of(word), word.encode()
    units = [raw + b"$", *([raw[:k] for k in BEGINNINGS if k < n] if len(raw) == n else [word[:k].encode() for k in BEGINNINGS if k < n])]
    return tuple([head | zlib.crc32(u) << 3 for u in units])


class Features:
    """All features of a text, sorted."""

    def __init__(self, model: np.ndarray):
        self.kinds = Kinds(Restorer(model), self._units, 200_000)

    def _units(self, word: str) -> list[bytes]:
        """The bases of a word, as one string of bytes."""
        return [np.array(own, np.int64).tobytes()] if (own := bases_of(word)) else []

    def __call__(self, text: str | None) -> np.ndarray:
        tokens, kinds = self.kinds.of(text)
        own, each = [], []
        for t, n in Counter(tokens).items():
            for bases in self.kinds.hits.get(t, ()):
                own.append(bases)
                each.append(n)
        each = np.repeat(np.array(each, np.int64), [len(b) // 8 for b in own])
        units, at = np.unique(np.frombuffer(b"".join(own), np.int64), return_inverse=True)
        n, total = np.bincount(at, each, len(units)).astype(np.int64), self.kinds.total(tokens, kinds)
        return np.sort(np.concatenate([units[on] | k for k, on in ((1, n > 0), (2, n >= 2), (3, n >= 4), (4, n * 150 >= total), (5, n * 40 >= total))]))


class Scorer:
    """Scores of texts by the chosen features' weights."""

    def __init__(self, model: np.ndarray, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.bases = {f & ~7 for f in weights}
        self.heads, self.begun = {f >> 35 << 35 for f in weights}, {}
        self.kinds = Kinds(Restorer(model), self._units)

    def _units(self, word: str) -> list[int]:
        """A word's units that any chosen feature has."""
        begins = self.begun.get(word[:3])
        if begins is None:
            if len(self.begun) > 100_000:
                self.begun.clear()
            begins = self.begun[word[:3]] = head_of(word) in self.heads
        return [u for u in bases_of(word) if u in self.bases] if begins else []

    def features(self, text: str | None) -> list[int]:
        tokens, kinds = self.kinds.of(text)
        total, units = self.kinds.total(tokens, kinds), Counter()
        for k in np.flatnonzero(kinds & HIT).tolist():
            for u in self.kinds.hits[tokens[k]]:
                units[u] += 1
        return [f for u, n in units.items() for k in levels(n, total) if (f := u | k) in self.weights]

    def __call__(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        return 1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[f] for f in self.features(text)), -30, 30)))


def logistic(rows: list[tuple[int, list[int]]], rounds: int = 500, ridge: float = 0.1) -> tuple[dict[int, float], float]:
    """Weights of the features of (label, features) rows, and the bias: full-batch gradient steps
    scaled by each feature's curvature."""
    names = sorted({f for _, fs in rows for f in fs})
    at = {f: k for k, f in enumerate(names)}
    y = np.array([r[0] for r in rows], float)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.array([at[f] for _, fs in rows for f in fs], np.int64)
    w, bias = np.zeros(len(names)), log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    each = np.bincount(doc, minlength=len(rows)) + 1.0  # features of a row move together
    scale = ridge + 0.25 * np.bincount(col, each[doc], len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(doc, w[col], len(rows)), -30, 30)))
        w += (np.bincount(col, (y - p)[doc], len(names)) - ridge * w) / scale
        bias += (y - p).sum() / (0.25 * each.sum())
    return dict(zip(names, w.tolist())), float(bias)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, dict[int, float], float]:
    """(character model, weights, bias) from docs(doc_id, text) and labels(doc_id, toxic)."""
    model = log_model(character_counts(docs, text))
    fold = labels.filter(F.pmod(id_crc(doc_id), F.lit(FOLDS)) != HELD_OUT).filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    count = fold.count()
    if not count:
        return model, {}, 0.0
    bound = min(1 << 63, int(0.95 * SAMPLE) * (1 << 63) // count)  # as finely as the hash, so never none
    picked = fold.filter(F.xxhash64(doc_id).bitwiseAND((1 << 63) - 1) <= F.lit(max(0, bound - 1)).cast("long")).groupBy(doc_id).agg(F.max(label).alias("y"))  # at most about SAMPLE rows
    texts = docs.select(doc_id, text).join(F.broadcast(picked), doc_id).select("y", text)

    made: list = []

    def look(ys, all_texts):
        if not made:
            made.append(Features(model))
        return ys, [pack(made[0](t)) for t in all_texts]

    found = store(map_rows(texts.withColumn("y", F.col("y").cast("int")), look, fields("y int, features binary")), "labelled")

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def opened(blobs: pd.Series) -> pd.Series:
        return pd.Series([unpack(b)[0] for b in blobs], dtype=object)

    n, toxic = found.agg(F.count("*"), F.sum("y")).first()
    if not toxic:
        return model, {}, 0.0
    each = found.select("y", F.explode(opened("features")).alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("t"))
    rate = toxic / n
    p, m = F.col("t") / F.col("n"), F.col("n")
    low = (p + 1.92 / m - 1.96 * F.sqrt(p * (1 - p) / m + 0.9604 / (m * m))) / (1 + 3.84 / m)  # Wilson's lower bound of the rate
    chosen = each.filter((F.col("t") >= 3) & (low > min(0.9, 1.5 * rate + 0.02))).orderBy(F.desc(F.col("t") * (low - rate)), "f").limit(CHOSEN).select("f").collect()
    names = {r[0] for r in chosen}
    if not names:
        return model, {}, 0.0

    def keep(ys, blobs):
        wanted = np.array(sorted(names), np.int64)

        def kept(own: np.ndarray) -> np.ndarray:
            return own[wanted[np.searchsorted(wanted, own).clip(max=len(wanted) - 1)] == own]

        return ys, [pack(kept(unpack(b)[0])) for b in blobs]

    rows = sorted((r[0], unpack(r[1])[0].tolist()) for r in map_rows(found, keep, fields("y int, features binary")).collect())  # at most about SAMPLE
    return model, *logistic(rows)


def score(docs: DataFrame, trained: tuple, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) for each row of docs."""
    made: list = []

    def over(ids, texts):
        if not made:
            made.append(Scorer(*trained))
        return ids, [float(made[0](t)) for t in texts]

    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return map_rows(picked, over, T.StructType([picked.schema["id"], T.StructField("score", T.DoubleType())]))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (F.pmod(id_crc("doc_id"), F.lit(FOLDS)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
