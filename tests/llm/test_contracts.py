"""Each opN_ query on the smallest tables: names, types and values of its result, by plain Python."""

import hashlib
import re
import zlib

import brute
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from lodestrata.llm import bpe, licenses, pii, quality
from lodestrata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = "[^\\x20\\x09-\\x0d]+"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name, columns):
    """The result with the contract's columns first, of the contract's types."""
    found = QUERIES[name](spark, SF)
    kinds = dict(found.dtypes)
    for column in columns.split(", "):
        c, kind = column.split(" ")
        assert kinds[c] == {"long": "bigint"}.get(kind, kind), (c, kinds[c])
    return found.toPandas()


def test_op1(spark, texts):
    got = run(spark, "op1_substring_dedup", "doc_id long, n_words long, n_removed long, kept_sha256 string").set_index("doc_id")
    gone = brute.removed_words(list(texts.items()), 20)
    assert set(got.index) == set(texts)
    for d, t in texts.items():
        words = re.findall(SPACE, t or "")
        kept = " ".join(w for k, w in enumerate(words) if k not in gone[d])
        assert tuple(got.loc[d][["n_words", "n_removed", "kept_sha256"]]) == (len(words), len(gone[d]), hashlib.sha256(kept.encode()).hexdigest())


def test_op2(spark, texts):
    got = run(spark, "op2_best_fit_packing", "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, pieces in got.sort_values("piece").groupby("doc_id"):
        ids = np.array([*library.encode(texts[d] or "", add_special_tokens=False).ids, 2], "<u4")
        assert list(pieces.piece) == list(range(len(pieces))) and list(pieces.start) == [0, *np.cumsum(pieces.length)[:-1]] and pieces.length.sum() == len(ids)
        assert (pieces.length[1:] == 1024).all() and pieces.length.iloc[0] <= 1024
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(pieces.start, pieces.length)] == list(pieces.ids_crc32)
    assert set(got.doc_id) == set(texts)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 1024 and list(s.offset) == [0, *np.cumsum(s.length)[:-1]]
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 1024 + 1


def test_op3(spark, texts):
    got = run(spark, "op3_media_columns", "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").set_index("doc_id")
    alike = {}
    for d, t in texts.items():
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got.loc[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_bytes > r.payload_bytes and alike.setdefault(t, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_op4(spark, texts):
    got = run(spark, "op4_byte_level_bpe", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").set_index("doc_id")
    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, t in texts.items():
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        assert tuple(got.loc[d][["n_tokens", "ids_sha256", "decoded_sha256"]]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert regex.findall(public_tokenizers.PATTERN, "a b") == ["a", " b"]


def test_op5(spark, texts):
    got = run(spark, "op5_license_scan", "doc_id long, license string, exact boolean")
    want = [(d, h[0], h[1], h[2]) for d, t in texts.items() if t for h in licenses.scan(t)]
    assert sorted(map(str, zip(got.doc_id, got.block_start, got.block_end, got.license))) == sorted(map(str, want))
    notices = {"GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-4.0": "Licensed under CC BY 4.0."}
    exact = set(zip(got[got.exact].doc_id, got[got.exact].license))
    for d, t in texts.items():
        for name, notice in notices.items():
            assert notice not in (t or "") or (d, name) in exact


def test_op6(spark, texts):
    got = run(spark, "op6_pii_pseudonyms", "doc_id long, n_found long, kinds string, text string").set_index("doc_id")
    links = {}
    for d, t in texts.items():
        new, spans = pii.pseudonymise(t, pii.EXAMPLE_KEY)
        assert got.loc[d].text == new and got.loc[d].n_found == len(spans)
        shift, at = 0, 0
        for a, b, kind in spans:  # what isn't a value stays; values keep their format, and equal ones their pseudonym
            assert new[at + shift : a + shift] == t[at:a]
            value, end = t[a:b], b + shift
            pseudonym = new[a + shift : end]
            assert kind == "ip" or re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", pseudonym))) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value))) or kind == "secret"
            if kind == "ip":
                pseudonym = re.match(r"[0-9.]*[0-9]", new[a + shift :])[0]
                shift += len(pseudonym) - len(value)
            assert links.setdefault((kind, value), pseudonym) == pseudonym
            at = b
        assert new is None or new[at + shift :] == t[at:]
    assert len({(k, p) for (k, _), p in links.items()}) == len(links)


def test_op7(spark, texts):
    got = run(spark, "op7_lm_score", "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").set_index("doc_id")
    tokens = {d: [*(t or "").encode().lower().split(), b" "] for d, t in texts.items()}
    count = {}
    for d, own in tokens.items():
        for w in own if zlib.crc32(str(d).encode()) % 5 != 1 else ():
            count[w] = count.get(w, 0) + 1
    n, kinds = sum(count.values()), len(count)
    for d, own in tokens.items():
        r = got.loc[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d).encode()) % 5 == 1, len(own), sum(w in count for w in own), n)
        assert r.base_score == pytest.approx(sum(np.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (kinds + 1))) for w in own)) and r.score < 0
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_op8(spark, texts):
    got = run(spark, "op8_quality_rules", "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean").set_index("doc_id")
    for d, t in texts.items():
        t = t or ""
        words, seen, dup = re.findall(SPACE, t), set(), 0
        for line in t.split("\n"):
            if re.search(SPACE, line):
                dup += line in seen
                seen.add(line)
        windows = {}
        for k in range(len(words) - 2):
            windows.setdefault(tuple(words[k : k + 3]), []).append(k)
        cover = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(3)}
        r = got.loc[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), dup, len(cover))
        failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
        assert r.base_failed == failed and not (failed and r.kept) and r.kept == (not failed and r.quality >= 0.5)
    counts = pd.Series([quality.features(t)[5] for t in texts.values()]).value_counts().to_dict()
    posterior = quality.estimate(counts)
    assert all(got.loc[d].quality == pytest.approx(posterior[quality.features(t)[5]]) for d, t in texts.items())


def test_op9(spark, texts):
    got = run(spark, "op9_simhash", "doc_id long, fingerprint string, component_id long").set_index("doc_id")
    ids = sorted(texts)
    fps = [brute.simhash(texts[d]) for d in ids]
    assert [got.loc[d].fingerprint for d in ids] == [f"{f:016x}" for f in fps]
    assert [got.loc[d].component_id for d in ids] == brute.components(ids, fps)


def test_op10(spark, texts):
    got = run(spark, "op10_toxicity", "doc_id long, held_out boolean, score double, predicted int").set_index("doc_id")
    assert set(got.index) == set(texts) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert all(got.loc[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in texts)
