"""Quality rules by weak supervision.

Each rule votes keep (+1), reject (-1) or abstains (0). How often each rule votes how for good and
for bad documents isn't given: expectation-maximisation (Dawid and Skene's model) estimates it from
the votes of all documents. A document's quality is its posterior probability of being good.

Spark counts the vote patterns over all documents (partial aggregation, then at most 3^9 rows); the
estimation needs only those counts, so the driver's work doesn't grow with the corpus.

Defined results: a null text has no words, as an empty one; both get n_words 0 and are rejected by
the base rules. Repeated rows get equal results. An empty table gives an empty table. keep_good()
keeps all columns of its input, whatever their names. rule_features() and judge() add columns to those
of their input; where one has the name of a result they raise ValueError and name it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fields, free_name, store, table, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: (name, reject if below, keep from, keep to, reject if above); between, the rule abstains.
RULES = (
    ("n_words", 20, 60, np.inf, np.inf),
    ("mean_chars", 2.0, 3.0, 12.0, 16.0),
    ("symbols_per_word", -1, -1, 0.05, 0.25),
    ("repeat_share", -1, -1, 0.1, 0.3),
    ("dup_line_share", -1, -1, 0.05, 0.3),
    ("upper_share", -1, -1, 0.2, 0.5),
    ("distinct_share", 0.15, 0.3, np.inf, np.inf),
    ("lettered_share", 0.75, 0.9, np.inf, np.inf),
    ("marked_share", -1, -1, 0.35, 0.6),
)
#: Prior probabilities that a rule rejects, abstains from, keeps a good document.
GOOD_VOTES = (0.005, 0.095, 0.9)
#: Posterior that documents with two rejects don't pass.
UNSURE = 0.45
FEATURES = fields("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes string")


def repeat_words(words: list) -> int:
    """Words in 3-word windows that occur at least twice, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    m = len(number)
    pair = ids[:-1] * m + ids[1:]
    if m > 2_000_000:  # three numbers would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    three = pair[:-1] * m + ids[2:]
    _, inverse, counts = np.unique(three, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : k + n - 2] |= twice
    return int(cover.sum())


def features(text: str | None) -> tuple:
    """The five base counts and the votes ('+', '-' or '0' for each rule)."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    again = repeat_words(words)
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    distinct = set(words)
    lettered = {w for w in distinct if w.decode().upper() != w.decode().lower()}
    ends = {w for w in distinct if not w.decode()[-1].isalnum()}
    d = max(n, 1)
    values = (
        n, chars / d, symbols / d, again / d, dup_lines / max(len(lines), 1), upper / max(letters, 1),
        len(distinct) / d ** 0.75 if n else 0.0,
        sum(map(lettered.__contains__, words)) / d,
        sum(map(ends.__contains__, words)) / d,
    )
    votes = "".join("-" if v < low or v > high else "+" if keep <= v <= top else "0" for v, (_, low, keep, top, high) in zip(values, RULES))
    return n, chars, symbols, dup_lines, again, votes


@F.pandas_udf(FEATURES)
def _features(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(map(features, text)), columns=FEATURES.names)


#: Not moved or doubled by the optimizer: a filter on one of its fields would else run it once more.
_features = _features.asNondeterministic()


def _no_clash(df: DataFrame, names) -> None:
    if clash := {c.lower() for c in df.columns} & set(names):
        raise ValueError(f"the input has columns with names of results: {', '.join(sorted(clash))}")


def rule_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts and the rules' votes."""
    _no_clash(docs, FEATURES.names)
    at = free_name(docs, "features")
    return docs.withColumn(at, _features(F.col(text))).select("*", f"{at}.*").drop(at)


def _rates(counts: np.ndarray) -> np.ndarray:
    """Likeliest vote probabilities from counts [class, rule, vote] (good, bad; reject, abstain, keep) such
    that a rule's reject is no likelier in good documents and its keep no likelier in bad ones. Where the
    free shares don't hold to that, the votes concerned get the share of both classes; of equally likely
    ways to do so the one that ties fewest votes, rejects before keeps."""
    both = np.broadcast_to(counts.sum(0), counts.shape)
    both = both / both.sum(2, keepdims=True)

    def tied(vote):
        rest = counts * (np.arange(3) != vote)
        out = rest / rest.sum(2, keepdims=True) * (1 - both[:, :, vote, None])
        out[:, :, vote] = both[:, :, vote]
        return out

    ways = np.stack([counts / counts.sum(2, keepdims=True), tied(0), tied(2), both])
    holds = (ways[:, 1, :, 0] >= ways[:, 0, :, 0] - 1e-12) & (ways[:, 1, :, 2] <= ways[:, 0, :, 2] + 1e-12)
    fit = np.where(holds, (counts * np.log(ways)).sum((1, 3)), -np.inf)  # `both` always holds
    return ways[fit.argmax(0), :, np.arange(counts.shape[1])].transpose(1, 0, 2)


def estimate(patterns: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Posterior probability of 'good' for each vote pattern, from the patterns' counts.

    Each class keeps, for each rule, the probabilities of the three votes. Rules are written so that
    each sees one kind of bad text: a good document is rarely rejected by any rule (a Dirichlet prior,
    GOOD_VOTES, weighing a fifth of the documents), while a bad one is often kept by most. The start
    follows from that: no reject is good, two rejects are bad, one is likelier good.

    A rule may be wrong about a whole source, whatever its share of the documents: a script without
    capitals, tables, lists. So one reject alone doesn't make a document bad. Documents with one reject
    take no part in what the bad class looks like, and a reject weighs no more than the classes' shares
    (prior odds of good), so what the other rules say decides. Two rejects stay under UNSURE. A reject
    never speaks for good nor a keep for bad (_rates), and documents that all rules keep count as good."""
    if not patterns:
        return {}
    names = sorted(patterns)
    votes = np.array([["-0+".index(v) for v in p] for p in names])
    count = np.array([patterns[p] for p in names], float)
    rejects = (votes == 0).sum(1)
    good = np.array([0.95, 0.75, 0.05])[np.minimum(rejects, 2)]
    prior_votes = np.stack([0.2 * count.sum() * np.array(GOOD_VOTES), np.full(3, 1 / 3)])
    one_hot = np.eye(3)[votes]
    clean = (votes == 2).all(1)
    good[clean] = 1
    for _ in range(rounds):
        weight = np.stack([count * good, count * (1 - good)])
        prior = (weight.sum(1) + 1) / (count.sum() + 2)
        weight[1, rejects == 1] = 0
        log = np.log(_rates(np.einsum("cp,prv->crv", weight, one_hot) + prior_votes[:, None, :]))
        odds, against = np.log(prior[0] / prior[1]), log[1] - log[0]
        against = np.einsum("prv,rv->pr", one_hot, against)
        lone = (votes == 0) & (rejects == 1)[:, None]
        against = np.where(lone, np.minimum(against, max(0.0, odds)), against)
        every = against.sum(1)
        good = 1 / (1 + np.exp(np.clip(every - odds, -700, 700)))
        good[rejects > 1] = np.minimum(good[rejects > 1], UNSURE)
        good[clean] = 1
    return dict(zip(names, good.tolist()))


def judge(featured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds quality (posterior), base_failed and kept to rows that rule_features() made.

    The counts of vote patterns are taken over all rows of `featured`; it is read twice."""
    _no_clash(featured, ("quality", "base_failed", "kept"))
    rows = featured.groupBy("votes").count().collect()  # at most 3 ** len(RULES)
    posterior = estimate({r[0]: r[1] for r in rows})
    spark = featured.sparkSession
    known = spark.createDataFrame(list(zip(posterior, posterior.values())) or [("", 0.5)], "votes string, quality double")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    joined = featured.join(F.broadcast(known), "votes", "left")  # bounded by the number of patterns
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns."""
    at = free_name(docs, "row")
    nested = docs.select(F.struct(*docs.columns).alias(at))
    featured = nested.withColumn("features_", _features(F.col(f"{at}.{text}"))).select(at, "features_.*")
    judged = judge(store(featured, "quality"), threshold)  # read twice, the texts once
    return judged.filter("kept").select(f"{at}.*")


def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(store(rule_features(docs).drop("text"), "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "votes")


