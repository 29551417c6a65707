"""Very long texts, two million characters each, through every operator that reads texts and every stage."""

import hashlib
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crestline.llm import bpe_trie, lattice_lm, license_scan, line_dedup, packing, quality_classifier, quality_rules, simhash, token_counts

LONG = {1: " " * 2_000_000, 2: "\n\t" * 1_000_000, 3: "a" * 2_000_000, 4: "word " * 400_000, 5: "short"}
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t) for k, t in LONG.items()], SCHEMA).repartition(3)


def test_token_counts(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: len(tok.encode(t, add_special_tokens=False).ids) for k, t in LONG.items()}
    got = token_counts.count_edited(docs.withColumn("edits", F.expr("array(struct(1000 as start, 1010 as stop, 'new words' as new))")), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    for r in got:
        t = LONG[r.doc_id]
        after = t[:1000] + "new words" + t[1010:]
        assert r.edited == after and r.n_tokens_after == len(tok.encode(after, add_special_tokens=False).ids)


def test_packing(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), prompt=packing.first_line(F.col("text")), max_loss=packing.MAX_LOSS).collect()
    for k, t in LONG.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == struct.pack(f"<{len(ids)}I", *ids)


def test_bpe(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in bpe_trie.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).collect():
        ids = tok.encode(LONG[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)


def test_native_rules_and_lines(docs):
    got = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(docs).collect()}
    assert got == {k: False for k in LONG}
    lines = {r.doc_id: r for r in line_dedup.with_lines_dropped(docs, counts=True).collect()}
    assert lines[2].n_lines == 1_000_001 and all(lines[k].n_dropped == 0 and lines[k].text == t for k, t in LONG.items())


def test_scores_scans_and_fingerprints(docs):
    model = quality_classifier.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")), fold=None)
    assert quality_classifier.score(docs, model).count() == 5
    assert {r.doc_id: r.n_words for r in license_scan.scan(docs).collect()} == {1: 0, 2: 0, 3: 1, 4: 400_000, 5: 1}
    same = {r.doc_id: r.component_id for r in simhash.simhash_classes(docs).collect()}
    assert same == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3, 4, 5]


def test_lattice(docs):
    # a long word is a plain loop over its bytes: a fifth of it, for time
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.expr("left(text, 400000)")).otherwise(F.col("text")))
    got = {r.doc_id: r for r in lattice_lm.score(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 1 and got[4].n_tokens == 400_001
    assert got[1].score == got[2].score and all(r.score < 0 for r in got.values()) and got[3].score < got[5].score
