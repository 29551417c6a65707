"""Packing, SimHash and BPE against brute force and the tokenizers library."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crestline.llm.bpe_trie import encode_decode, op8_bpe_trie
from crestline.llm.packing import MAX_LOSS, byte_bpe, encoded, first_line, op6_packing, pack, pack_documents
from crestline.llm.simhash import components, op10_simhash, shard_links, simhash_classes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = ["", None, " \t\n ", "one", "Two  words", "a" * 3000, "<|endoftext|> x<|endoftext|>", "naïve ﬁ Σας İ 日本 🙂🙂", "x y z " * 4000]


def odd_docs(spark):
    rows = [(n, t, "src", 7, "k") for n, t in enumerate(ODD)] + [(3, "one", "src", 1, None), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, node int, key string")


def texts_of(spark, sf=SF):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


# packing ---------------------------------------------------------------------


def check_pieces(rows, ids_of, max_tokens=1024, max_segments=64):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == ids_of.keys()
    for k, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids_of[k])
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids_of[k][at : at + p.length]))
            at += p.length
        assert at == len(ids_of[k])
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert len(pieces) <= max_segments and (at == max_tokens or at & (at - 1) == 0) and at <= max_tokens


def test_op6_every_id_once(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = texts_of(spark)
    ids = {k: [*tok.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}
    rows = op6_packing(spark, SF).collect()
    check_pieces(rows, ids)
    loss, by_seq = defaultdict(int), defaultdict(list)
    for r in rows:
        loss[r.doc_id] += r.loss_tokens
        by_seq[r.sequence_id].append(r)
    # an id that begins in the first line and ends in it bears no loss
    for k, t in texts.items():
        ends, free = 0, len(t[: t.find("\n") + 1].encode())
        prompt = 0
        for i in ids[k][:-1]:
            ends += len(byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")).decode_single_token_bytes(i))
            prompt += ends <= free
        assert loss[k] == len(ids[k]) - prompt
    assert max(sum(p.loss_tokens for p in s) for s in by_seq.values()) == 992
    full = [s for s in by_seq.values() if sum(p.length for p in s) == 1024]
    assert len(full) > 0.9 * len(by_seq)


def test_each_limit_binds_by_itself(spark):
    """Answers alone meet the loss limit, prompts alone the token limit, one-token texts the segment limit."""
    answers = [(n, "word " * 3000) for n in range(4)]
    prompts = [(n, "word " * 3000 + "\n") for n in range(4)]
    small = [(n, "") for n in range(200)]
    found = []
    for rows in (answers, prompts, small):
        by_seq = defaultdict(list)
        for r in pack_documents(spark.createDataFrame(rows, DOCS).coalesce(1), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                prompt=first_line(F.col("text")), max_loss=MAX_LOSS).collect():
            by_seq[r.sequence_id].append(r)
        found.append([max(f(s) for s in by_seq.values()) for f in (lambda s: sum(p.length for p in s), len, lambda s: sum(p.loss_tokens for p in s))])
    assert found[0][0] == found[0][2] == 512  # 992, cut back to a power of two
    assert found[1][0] == 1024 and found[1][1] < 64 and found[1][2] < 992
    assert found[2] == [64, 64, 64]


def test_pack_odd_texts(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pack_documents(odd_docs(spark), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in [*ODD, "one", "no id"])
    assert sum(r.length for r in got) == total
    assert any(r.doc_id is None for r in got)


@pytest.mark.parametrize("limits", [(16, 3, 5), (64, 4, 64), (8, 1, 8), (32, 2, 1)])
def test_pack_keeps_all_three_limits(spark, limits):
    rng = random.Random(3)
    rows = []
    for n in range(300):
        ids = [rng.randrange(50000) for _ in range(rng.choice([0, 1, 2, 5, 17, 40, 200]))]
        rows.append((n, struct.pack(f"<{len(ids)}I", *ids), rng.choice([None, 0, 1, 4, len(ids)])))
    got = pack(spark.createDataFrame(rows, "doc_id long, ids binary, loss_start long").repartition(3), *limits, pool=20).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_seq.values():
        assert sum(p.length for p in pieces) <= limits[0] and len(pieces) <= limits[1]
        assert sum(p.loss_tokens for p in pieces) <= limits[2]
    for n, ids, loss_start in rows:
        assert b"".join(bytes(p.ids) for p in sorted(by_doc[n], key=lambda p: p.start)) == ids
        assert sum(p.loss_tokens for p in by_doc[n]) == max(0, len(ids) // 4 - (loss_start or 0))


def test_runs_of_white_space_keep_the_library_s_ids():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc, rng = byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(1)
    for _ in range(40):
        parts = [" " * rng.randrange(900, 1100), "\n" * 1500, "\u3000" * 1200, "\x1c" * 1200, "a", "b c", "<|endoftext|>", "\t", " " * 1200, "'s", "1"]
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12))) + "q" * 100_000 + rng.choice(["", " " * 1500])
        assert encoded(text, enc) == tok.encode(text, add_special_tokens=False).ids


def test_pack_empty_table_and_bad_limits(spark):
    none = spark.createDataFrame([], "doc_id long, ids binary, loss_start long")
    assert pack(none).count() == 0
    with pytest.raises(ValueError):
        pack(none, max_segments=0)


# BPE -------------------------------------------------------------------------


def test_op8_equals_the_library(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = texts_of(spark)
    got = {r.doc_id: r for r in op8_bpe_trie(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_texts_and_random_letters(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    texts = [*ODD, *("".join(rng.choice("aeinrsth") for _ in range(rng.randrange(30))) for _ in range(300)),
             *("".join(rng.choice("ab1'sS \n\t.!é中’ºΣİß՘Ɤ") for _ in range(rng.randrange(40))) for _ in range(300)), *("ab" * n for n in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for r in encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).collect():
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert r.decoded == tok.decode(ids, skip_special_tokens=False)
    assert encode_decode(odd_docs(spark), public_tokenizers.path("word_bpe_49k.json")).count() == len(ODD) + 2
    assert encode_decode(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


# SimHash ---------------------------------------------------------------------


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    label = dict(enumerate(range(len(fps))))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_op10_equals_brute_force(spark):
    texts = texts_of(spark, "/root/testdata/sf0.001")
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[k]) for k in ids]
    want = {k: (f"{f:016x}", ids[c]) for k, f, c in zip(ids, fps, brute_components(fps, 2))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op10_simhash(spark, "/root/testdata/sf0.001").collect()} == want


@pytest.mark.parametrize("cap", [4096, 20])
def test_links_of_crowded_fingerprints(spark, cap):
    """Clusters of near fingerprints, in one cell and in many."""
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = set(centres)
    while len(fps) < 700:
        f = rng.choice(centres)
        for _ in range(rng.randrange(9)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    rng.shuffle(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from crestline.llm.simhash import band_keys

    nodes = spark.createDataFrame([(f,) for f in signed], "node long").select("node", F.col("node").alias("fp"))
    routed = nodes.select("node", "fp", F.explode(band_keys(F.col("fp"), 2, 3)).alias("key"))
    links = shard_links(routed, 2, cap)
    root = {r.node: r.root for r in components(links).collect()}
    want = brute_components(fps, 2)
    by_class, by_root = defaultdict(set), defaultdict(set)
    for f, c in zip(signed, want):
        by_class[c].add(f)
    for f in signed:
        by_root[root.get(f, f)].add(f)
    assert sorted(map(sorted, by_class.values())) == sorted(map(sorted, by_root.values()))


def test_simhash_odd_tables(spark):
    got = simhash_classes(odd_docs(spark)).collect()
    assert len(got) == len(ODD) + 2
    zero = {r.doc_id: r.component_id for r in got}
    assert zero[0] == zero[1] == zero[2] == 0 and zero[3] == 3
    lone = [r for r in got if r.doc_id is None]
    assert len(lone) == 1 and lone[0].component_id is None
    assert simhash_classes(odd_docs(spark).limit(0)).count() == 0
