"""Top-k search against brute force, near-duplicates, and the pipeline's stages."""

import random
import re
from collections import defaultdict

import pytest

from crestline.llm.hamming_search import top_k
from crestline.llm.simhash import components, keep_one, near_classes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bits", [16, 40, 64])
def test_top_k_equals_brute_force(spark, bits):
    rng = random.Random(bits)
    centres = [rng.getrandbits(bits) for _ in range(5)]
    rows = []
    for n in range(300):
        code = rng.choice(centres) if n % 3 else rng.getrandbits(bits)
        for _ in range(rng.randrange(6)):
            code ^= 1 << rng.randrange(bits)
        rows.append((n, code - (1 << 64) if code >> 63 else code))
    rows += rows[:3] + [(None, 1), (999, None)] + [(1000 + n, rows[0][1]) for n in range(30)]
    codes = spark.createDataFrame(rows, "id long, code long")
    queries = codes.filter("id % 20 = 0")
    got = defaultdict(list)
    for r in top_k(codes, queries, 7, bits).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.id))
    full = {i: c for i, c in rows if i is not None and c is not None}
    for q in got.keys() | {i for i in full if i % 20 == 0}:
        want = sorted((((full[q] ^ c) & (1 << 64) - 1).bit_count(), i) for i, c in full.items() if i != q)[:7]
        assert got[q] == want


def test_top_k_small_tables(spark):
    none = spark.createDataFrame([], "id long, code long")
    some = spark.createDataFrame([(1, 5), (2, 7)], "id long, code long")
    assert top_k(none, some).count() == 0 and top_k(some, none).count() == 0
    assert [(r.query_id, r.rank, r.id, r.distance) for r in top_k(some, some.filter("id = 1")).collect()] == [(1, 1, 2, 1)]


def test_top_k_of_ids_with_many_codes(spark):
    """An id may have any number of codes: none of its own is in its answer, and others keep k + 1 codes."""
    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(6)]
    near = lambda c: c ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60))
    rows = list({(n, near(rng.choice(base))) for n in range(120)} | {(7, near(b)) for b in base for _ in range(40)} | {(20, base[0]), (20, base[1]), (200, base[0]), (201, base[0])})
    queries = [(i, c) for i, c in rows if i in (20, 40, 200)] + [r for r in rows if r[0] == 7][:10] + [(5000, base[2])]
    got = defaultdict(set)
    for r in top_k(spark.createDataFrame(rows, "id long, code long"), spark.createDataFrame(queries, "id long, code long"), 5).collect():
        got[r.query_id].add((r.rank, r.distance, r.id))
    want = defaultdict(set)
    for q, c in queries:
        for n, (d, i) in enumerate(sorted(((c ^ x).bit_count(), i) for i, x in rows if i != q)[:5]):
            want[q].add((n + 1, d, i))
    assert got == want
    alone = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (2, 9)], "id long, code long")
    assert sorted((r.query_id, r.rank, r.id, r.distance) for r in top_k(alone, alone).collect()) == [
        (1, 1, 2, 2), (1, 1, 2, 3), (1, 1, 2, 4), (2, 1, 1, 2), (2, 2, 1, 3), (2, 3, 1, 4)]


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_near_classes_by_similarity(spark):
    rng = random.Random(2)
    docs, family = [], {}
    for f in range(40):
        base = words(rng, 200)
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(200)] = "edit"
            family[len(docs)] = f
            docs.append((len(docs), " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    s = {k: shingles(t) for k, t in docs}
    for a in s:
        for b in s:
            j = len(s[a] & s[b]) / len(s[a] | s[b])
            if j >= 0.85:
                assert got[a] == got[b]
            if family[a] != family[b]:
                assert got[a] != got[b]


@pytest.mark.parametrize(("cap", "most"), [(1024, 16), (40, 16), (10, 3)])
def test_near_classes_equal_brute_force_about_the_bound(spark, monkeypatch, cap, most):
    """Templated pages and editions of similarity 0.7 to 0.9: linked from 0.8 on, and only those. The last bounds make the largest group one that goes by band keys."""
    import crestline.llm.simhash as simhash

    exact = simhash.exact_links
    monkeypatch.setattr(simhash, "exact_links", lambda *args: exact(*args, cap=cap, most=most))
    rng = random.Random(8)
    docs, pages = [], [words(rng, 300) for _ in range(30)]
    for f, base in enumerate(pages):
        for _ in range(60 if f == 0 else rng.randrange(2, 6)):
            w, edits = list(base), rng.randrange(2, 8)
            for at in rng.sample(range(300), edits):
                w[at] = f"edit{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    s = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in docs)]
    label, seen = list(range(len(docs))), []
    for i in range(len(s)):
        for j in range(i):
            share = len(s[i] & s[j]) / len(s[i] | s[j])
            seen.append(share)
            if share >= 0.8 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert sum(0.7 <= x < 0.8 for x in seen) > 100 and sum(0.8 <= x < 0.9 for x in seen) > 100
    assert {r.doc_id: r.component_id for r in near_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()} == dict(enumerate(label))


def test_a_vast_group_goes_by_band_keys(spark):
    """A group of more parts than allowed: its sets meet those that share a key, once a key; others stay whole."""
    from crestline.llm.simhash import cells_of

    groups = spark.createDataFrame([(n, bytes([n]), 5, 0) for n in range(12)] + [(n, bytes([n]), 5, 20) for n in (20, 21)], "node long, same binary, n long, root long")
    # neighbours share a key: 0 1, 1 2, ...; keys of the ends are their own
    keys = spark.createDataFrame([(n, bytes([n]), [n, n + 1]) for n in [*range(12), 20, 21]], "node long, same binary, keys array<long>")
    got = {r.doc_id: {c.root for c in r.cells} for r in cells_of(groups, keys, cap=2, cap_hashes=1 << 20, most=4).collect()}
    assert got.keys() == {*range(12), 20, 21} and got[20] == got[21] == {20}
    assert all(bool(got[a] & got[b]) == (b == a + 1) for a in range(12) for b in range(a + 1, 12))
    whole = {r.doc_id: {(c.root, c.parts) for c in r.cells} for r in cells_of(groups, keys, cap=2, cap_hashes=1 << 20, most=6).collect()}
    assert whole[3] == {(0, 6)} and whole[20] == {(20, 1)}


def test_near_copies_with_repeats_of_their_own(spark):
    """A passage said over and over counts once, as in the similarity."""
    rng = random.Random(9)
    docs = []
    for n in range(20):
        base, own = words(rng, 1000), words(rng, 20)
        docs += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(base + own * 30))]
    got = {r.doc_id: r.component_id for r in near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: k // 2 * 2 for k, _ in docs}


def test_crowds_of_near_copies(spark):
    """A family beyond a shard's cap stays one class."""
    rng = random.Random(5)
    base = words(rng, 120)
    docs = []
    for n in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"edit{n}"
        docs.append((n, " ".join(w)))
    docs += [(1000 + n, " ".join(words(rng, 120))) for n in range(50)]
    import crestline.llm.simhash as simhash

    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one(df).collect()) == [0, *range(1000, 1050)]
    links = simhash.shard_links
    simhash.shard_links = lambda routed, radius, cap=50, similarity=None: links(routed, radius, 50, similarity)
    try:
        assert sorted(r.doc_id for r in keep_one(df).collect()) == [0, *range(1000, 1050)]
    finally:
        simhash.shard_links = links


def test_keep_one_odd_table(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "a b c", 3), (3, "a b c", 4), (4, "A b c", 5), (None, "a b c", 6), (5, "other", 7)]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string, gone int"))
    assert got.columns == ["doc_id", "text", "gone"]
    assert sorted(r.gone for r in got.collect()) == [1, 3, 4, 6, 7]
    assert keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_classes_recall_at_the_bound(spark):
    """Pairs of similarity 0.80 to 0.82: none of 1,000 lost."""
    rng = random.Random(21)
    docs = []
    for n in range(1000):
        base = [f"w{rng.getrandbits(40)}" for _ in range(104)]
        other = list(base)
        other[47], other[60] = "edit", "edit"  # 90 of 110 shingles are in both
        docs += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(other))]
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(100)} for _, t in docs[:2])
    assert 0.8 <= len(a & b) / len(a | b) < 0.82
    got = {r.doc_id: r.component_id for r in near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    caught = sum(got[2 * n + 1] == 2 * n for n in range(1000))
    assert caught >= 999 and all(got[2 * n] == 2 * n for n in range(1000))


def test_edges_of_a_hub(spark):
    """A class whose centre has most edges: broadcast, not brought to one task."""
    edges = [(0, n) for n in range(1, 2000)] + [(5000 + n, 5001 + n) for n in range(300)] + [(7, 5000), (9000, 9001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 for n in [*range(2000), *range(5000, 5301)]} | {9000: 9000, 9001: 9000}


def test_stages_keep_odd_rows_and_columns(spark):
    import corpus_pipeline as pipeline

    good = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    text = next(t for k, t in good.items() if labels.get(k) == 1 and len(t.split()) > 100)
    rows = [(1, text, "en", None, 1), (1, text, "en", "s", 2), (None, text, None, "s", None), (2, None, "en", "s", 0), (3, "", None, None, 0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        found = stage(spark, odd, SF)
        assert stage(spark, odd.limit(0), SF).count() == 0
        if name in ("quality rules", "quality classifier"):
            assert found.columns == odd.columns
            kept = [tuple(r) for r in found.collect()]
            assert set(kept) <= set(rows) and all(r in kept for r in rows[:3])
        elif name == "packing":
            by = defaultdict(int)
            for r in found.collect():
                by[r.doc_id] += r.length
            assert by.keys() == {1, 2, 3, None} and by[2] == by[3] == 1 and by[1] == 2 * by[None]
        else:
            assert found.columns == odd.columns


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as pipeline
    from crestline.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES:
        new = written(stage(spark, docs, SF), "stage")
        seen.append((name, docs.count(), new.count()))
        if name != "packing":
            assert sorted(new.columns) == sorted(columns)
            old = {r.doc_id for r in docs.select("doc_id").collect()}
            kept = {r.doc_id for r in new.select("doc_id").collect()}
            assert kept <= old
            if name == "line dedup":
                assert kept == old
                lines = defaultdict(set)
                for r in new.collect():
                    assert r.n_chars == len(r.text)
                    for line in r.text.split("\n"):
                        lines[re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))].add(r.doc_id)
                assert all(len(ids) == 1 for k, ids in lines.items() if len(k) >= 10)
        else:
            assert {r.doc_id for r in new.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
        docs = new
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert not any(labels.get(k) == 0 for k in kept)
    assert pipeline.run(spark, SF).count() == docs.count()
