import re

import brute
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lodestrata.llm import pii, quality, substrings
from lodestrata.llm.common import SPACES


def test_run_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).toPandas()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]

    found = {d: quality.features(t) for d, t in docs}
    counts = {}
    for f in found.values():
        counts[f[5]] = counts.get(f[5], 0) + 1
    good = quality.estimate(counts)
    docs = [(d, t) for d, t in docs if found[d][0] >= 50 and 100 * found[d][4] <= 50 * found[d][0] and good[found[d][5]] >= 0.5]

    names = brute.components_of_parts([d for d, _ in docs], [brute.simhashes(t) for _, t in docs])
    docs = [(d, t) for (d, t), c in zip(docs, names) if d == c]

    gone = brute.removed_words(docs, substrings.WINDOW)
    cut = []
    for d, t in docs:
        parts = re.findall(rf"([{SPACES}]*)([^{SPACES}]+)", t)
        cut.append((d, "".join(a + w for k, (a, w) in enumerate(parts) if k not in gone[d]).lstrip(SPACES) if gone[d] else t))
    docs = [(d, pii.pseudonymise(t, pii.EXAMPLE_KEY)[0]) for d, t in cut]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], np.uint32).tobytes() for d, t in docs}
    assert set(want) == set(got.doc_id)
    for d, pieces in got.sort_values("start").groupby("doc_id"):
        assert b"".join(pieces.ids) == want[d]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 1024 and list(s.offset) == [0, *np.cumsum(s.length)[:-1]]
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 1024 + 1


def test_stages_keep_the_columns_of_documents(spark):
    rows = [(1, "a b c " * 30, "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, "").columns == table.columns
            stage(spark, table, "").collect()
        corpus_pipeline.packing_stage(spark, table, "").collect()
