"""Line dedup, quality rules, classifier, LM, license scan and token counts."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from crestline.llm import license_scan, line_dedup, quality_classifier, quality_rules, token_counts
from crestline.llm.lattice_lm import Lattice, op4_lattice_lm, score, vocabulary
from crestline.llm.common import written
from crestline.llm.packing import byte_bpe, encoded
from crestline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
ODD = ["", None, " \t\n ", "one", "Same line of text here\nSAME LINE OF TEXT HERE \nshort", "same line of text here", "a" * 3000, "x y z " * 4000, "same line of text here"]


def odd_docs(spark):
    """Nulls, empty and long texts, a repeated row, and columns named like the operators' own."""
    rows = [(n, t, "a", 1, True) for n, t in enumerate(ODD)] + [(3, "one", None, None, None), (None, "same line of text here", "b", 2, False)]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, n_words int, kept boolean")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetch_df()
    got = QUERIES[name](spark, SF).select(*want.columns).toPandas()
    key = list(want.columns)
    assert sorted(map(tuple, got[key].astype(str).to_numpy())) == sorted(map(tuple, want[key].astype(str).to_numpy()))


# line dedup ------------------------------------------------------------------


def plain_dedup(docs, min_chars):
    first, holders = {}, {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for k, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                first[key(line)] = min(first.get(key(line), k), k)
                holders.setdefault(key(line), set()).add(k)
    return {k: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < min_chars or first[key(x)] == k) for k, t in docs}


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (9, 3)])
def test_line_dedup_is_the_same_for_any_batches(spark, batches, fanout):
    rng = random.Random(batches)
    lines = [f"line number {n} of the pool" for n in range(40)] + ["Line number 3 of the POOL", "tiny", ""]
    docs = [(n * 3, "\n".join(rng.choice(lines) for _ in range(rng.randrange(8)))) for n in range(120)]
    rng.shuffle(docs)
    got = line_dedup.with_lines_dropped(spark.createDataFrame(docs, "doc_id long, text string"), batches=batches, fanout=fanout)
    assert {r.doc_id: r.text for r in got.collect()} == plain_dedup(docs, 10)


def test_runs_are_merged_in_their_order(spark):
    """Neither a batch's anti-join nor a compaction sorts or shuffles a run."""
    runs = line_dedup.SortedRuns(spark, 4, 3)

    def hashes(start, stop):
        rows = spark.range(start, stop).repartition(3).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), "id")
        return rows.groupBy("h1", "h2").agg(F.min("id").alias("owner"))

    try:
        with runs.settings():
            runs.add(hashes(0, 1000))
            runs.add(hashes(500, 1500))
            assert sorted(r.h2 for r in runs.all().collect()) == list(range(1500))
            batch = hashes(900, 3000)
            plan = runs.unseen(batch)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == 2 and plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1
            both = runs.merged(*runs.levels[0])
            plan = both._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == 1 and "Sort [" not in plan and "Exchange" not in plan
            assert sorted(r.owner for r in both.collect()) == list(range(1500))
            runs.add(batch)
            assert [len(x) for x in runs.levels] == [0, 1] and sorted(r.h2 for r in runs.all().collect()) == list(range(3000))
            files = [f.rsplit("/", 1)[1] for f in runs.all().inputFiles()]
            assert len(files) == 4  # one a bucket
    finally:
        runs.forget()


def test_line_dedup_goes_on_with_kept_runs(spark, tmp_path):
    rng = random.Random(7)
    lines = [f"line number {n} of the pool" for n in range(60)] + ["Line number 3 of the POOL", "tiny"]
    docs = [(n, "\n".join(rng.choice(lines) for _ in range(rng.randrange(6)))) for n in range(150)]
    want, folder = plain_dedup(docs, 10), f"{tmp_path}/it's runs"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for part in (docs[:60], docs[60:100], docs[100:], docs[60:100]):  # the last again
        got = line_dedup.with_lines_dropped(spark.createDataFrame(part, "doc_id long, text string"), batches=2, folder=folder)
        assert {r.doc_id: r.text for r in got.collect()} == {k: want[k] for k, _ in part}
    # other tables lie in other folders; another number of partitions goes on with the buckets there are
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        got = line_dedup.with_lines_dropped(spark.createDataFrame([(900, "line number 5 of the pool\nquite a new line")], "doc_id long, text string"), folder=folder)
        assert got.first().text == ("quite a new line" if any("number 5 " in t for _, t in docs) else "line number 5 of the pool\nquite a new line")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert line_dedup.with_lines_dropped(spark.createDataFrame(docs[:0], "doc_id long, text string"), folder=folder).count() == 0


def test_line_dedup_odd_table(spark):
    rows = line_dedup.with_lines_dropped(odd_docs(spark), counts=True).collect()
    assert len(rows) == len(ODD) + 2 and "kept" in rows[0]
    by = {r.doc_id: r for r in rows}
    assert by[4].text == ODD[4] and by[5].text == "" and by[8].n_dropped == 1 and by[None].text == "" and by[1].text == "" and by[1].n_lines == 1
    assert line_dedup.with_lines_dropped(odd_docs(spark).limit(0)).count() == 0


# quality rules ----------------------------------------------------------------


def test_rules_in_any_order_give_one_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [r.name for r in quality_rules.RULES]
    want = None
    for order in (names, names[::-1], None):
        got = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(docs, order=order).collect()}
        want = want or got
        assert got == want
    assert 0 < sum(want.values()) < len(want)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if v}


def test_rule_estimates_order_by_rejection_per_cost(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = quality_rules.estimate_rules(docs.select("doc_id", "text"), quality_rules.RULES)
    rates = [x["rejects"] / x["cost"] for x in found if x["cost"]]
    assert rates == sorted(rates, reverse=True) and {x["rule"] for x in found} == {r.name for r in quality_rules.RULES}


def test_rules_odd_table(spark):
    rows = quality_rules.quality_verdicts(odd_docs(spark)).collect()
    assert len(rows) == len(ODD) + 2 and not any(r.kept for r in rows)
    assert quality_rules.quality_verdicts(odd_docs(spark).limit(0)).count() == 0
    assert quality_rules.keep_good(odd_docs(spark)).count() == 0


# classifier -------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    got = {r.doc_id: r for r in quality_classifier.op3_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    seen = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in labels)
    assert len(seen) > 50 and sum(p == q for p, q in seen) / len(seen) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_dual_descent_finds_a_separating_plane():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(200):
        label = rng.choice([-1, 1])
        rows.append(np.unique(np.r_[[0] if label > 0 else [1], rng.integers(2, 30, 5)]).astype(np.int32))
        y.append(label)
    model = quality_classifier.fit(rows, np.array(y), 32)
    assert all((model.margin(r) > 0) == (t > 0) for r, t in zip(rows, y))


def plain_features(text, dims):
    """The places of a text's n-grams, written out one by one."""
    big = 1 << 64
    row, looks, codes = text.encode().split(), [], []
    for k, w in enumerate(row):
        codes.append(zlib.crc32(w.lower()))
        looks.append(quality_classifier.shape(w) * 2 + (k > 0 and codes[-1] == codes[-2]))

    def mixed(x, salt):
        x = (x + salt) * 0x9E3779B97F4A7C15 % big
        return x ^ x >> 29

    grams = [mixed(c, 1) for c in codes] + [mixed((mixed(a, 2) + b) % big, 2) for a, b in itertools.pairwise(codes)]
    grams += [mixed(x, 3) for x in looks] + [mixed(a << 12 | b, 4) for a, b in itertools.pairwise(looks)]
    grams += [mixed(a << 24 | b << 12 | c, 5) for a, b, c in zip(looks, looks[1:], looks[2:])]
    return sorted({g * 0xD6E8FEB86659FD93 % big >> 65 - dims.bit_length() for g in grams})


def test_op3_equals_brute_force(spark):
    """Chosen rows, ratios, the hinge-loss optimum and every score, with plain loops; the weights by their optimality."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    model = quality_classifier.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    dims = quality_classifier.DIMS
    places = {k: plain_features(t, dims) for k, t in docs.items()}
    known = [k for k in labels if k in docs and zlib.crc32(str(k).encode()) % 5 != 0]
    up, down = [k for k in known if labels[k]], [k for k in known if not labels[k]]
    has = [Counter(j for k in group for j in places[k]) for group in (down, up)]
    ratio = {j: math.log((has[1][j] + 1) / (len(up) + 2) / ((has[0][j] + 1) / (len(down) + 2))) for j in has[0].keys() | has[1].keys() if has[0][j] + has[1][j] >= 3}
    assert np.count_nonzero(model.ratios) <= len(ratio) and all(abs(model.ratios[j] - x) < 1e-9 for j, x in ratio.items())

    def margin(k):
        x = [(j, ratio.get(j, 0.0)) for j in places[k]]
        length = math.sqrt(sum(v * v for _, v in x)) or 1.0
        return sum(model.weights[j] * v / length for j, v in x) + model.weights[-1]

    # the primal value lies at the optimum: no small step in any of many directions is better
    rows = [(1 if labels[k] else -1, k) for k in known]
    loss = sum(max(0.0, 1 - y * margin(k)) for y, k in rows) + (model.weights @ model.weights) / 2
    rng, kept = np.random.default_rng(0), model.weights.copy()
    for _ in range(20):
        step = np.zeros(dims + 1)
        for _, k in [rows[i] for i in rng.integers(0, len(rows), 5)]:
            step[places[k]] += rng.normal(0, 0.05)
        model.weights = kept + step
        assert sum(max(0.0, 1 - y * margin(k)) for y, k in rows) + (model.weights @ model.weights) / 2 > loss - 2e-3 * len(rows)
    model.weights = kept
    got = {r.doc_id: r for r in QUERIES["op3_quality_classifier"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for k, r in got.items():
        want = 1 / (1 + math.exp(-min(max(model.slope * margin(k) + model.shift, -30), 30)))
        assert abs(r.score - want) < 1e-4 and r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)


def test_a_repeated_label_id_brings_one_row(spark):
    docs = spark.createDataFrame([(1, f"good text {n % 7}") for n in range(10_000)] + [(n, f"good words {n}" if n % 2 else f"BAD $$ {n}") for n in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(1, 60)], "doc_id long, quality int")
    seen = []
    fit = quality_classifier.fit
    quality_classifier.fit = lambda rows, y, dims: seen.append(len(rows)) or fit(rows, y, dims)
    try:
        quality_classifier.train(docs, labels, fold=None)
    finally:
        quality_classifier.fit = fit
    assert seen == [59]


def test_the_fit_is_bounded_in_bytes(spark):
    """The first rows in the order of their ids' hashes that come to the bound, and none after them."""
    docs = spark.createDataFrame([(n, " ".join(f"w{n}x{k}" for k in range(10 * n))) for n in range(1, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(1, 30)], "doc_id long, quality int")
    seen = []
    fit = quality_classifier.fit
    quality_classifier.fit = lambda rows, y, dims: seen.append(sorted(4 * len(r) for r in rows)) or fit(rows, y, dims)
    try:
        for most in (1 << 28, 5000, 0):
            quality_classifier.train(docs, labels, fold=None, max_bytes=most)
    finally:
        quality_classifier.fit = fit
    every, some, none = seen
    assert len(every) == 29 and 0 < len(some) < 29 and sum(some) <= 5000 < sum(every) and not none


def test_classifier_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_classifier.train(odd_docs(spark), labels)
    rows = quality_classifier.score(odd_docs(spark), model).collect()
    assert len(rows) == len(ODD) + 2 and {r.score for r in rows} == {0.5}
    assert quality_classifier.score(odd_docs(spark).limit(0), model).count() == 0


# language model ---------------------------------------------------------------


def test_lattice_sums_all_segmentations():
    pieces = tuple(sorted([b" ", b"a", b"b", b"c", b" a", b"ab", b"bc", b"abc", b" ab"]))
    p = np.arange(1, len(pieces) + 1) / sum(range(1, len(pieces) + 1))
    lattice = Lattice(pieces, np.log(p))
    weight = dict(zip(pieces, p))

    def total(text):
        return 1.0 if not text else sum(weight[text[:k]] * total(text[k:]) for k in range(1, len(text) + 1) if text[:k] in weight)

    words = [b" " + bytes(x) for n in range(1, 6) for x in itertools.product(b"abc", repeat=n)]
    want = np.array([math.log(total(w)) for w in words])
    assert np.allclose(lattice.log_probabilities(words), want) and np.allclose([lattice.long_word(w) for w in words], want)

    def counts(text, mass=1.0, used=()):
        if not text:
            yield mass, used
        for k in range(1, len(text) + 1):
            if text[:k] in weight:
                yield from counts(text[k:], mass * weight[text[:k]], (*used, text[:k]))

    expected = Counter()
    for w in words[:60]:
        every = list(counts(w))
        for mass, used in every:
            for u in used:
                expected[u] += 2 * mass / sum(m for m, _ in every)
    got = lattice.expected_counts(words[:60], np.full(60, 2.0))
    assert np.allclose(got, [expected[x] for x in pieces])


def test_pieces_of_a_long_word():
    """A word of 1,000 bytes, in exact arithmetic over all its segmentations."""
    pieces = tuple(sorted([b" ", b"a", b"b", b"c", b" a", b"ab", b"bc", b"abc", b" ab"]))
    whole = sum(range(1, len(pieces) + 1))
    weight = {x: Fraction(k, whole) for k, x in enumerate(pieces, 1)}
    word = b" " + bytes(np.random.default_rng(4).choice(list(b"abc"), 1000).tolist())
    ahead, behind = [Fraction(1)] + [Fraction(0)] * 1001, [Fraction(0)] * 1001 + [Fraction(1)]
    for at in range(1, 1002):
        ahead[at] = sum(ahead[at - len(x)] * p for x, p in weight.items() if word[:at].endswith(x))
    for at in range(1000, -1, -1):
        behind[at] = sum(behind[at + len(x)] * p for x, p in weight.items() if word.startswith(x, at))
    want = [float(3 * sum(ahead[at] * p * behind[at + len(x)] for at in range(1001) if word.startswith(x, at)) / ahead[-1]) for x, p in weight.items()]
    lattice = Lattice(pieces, np.log([float(p) for p in weight.values()]))
    got = lattice.expected_counts([word, b" ab"], np.array([3.0, 0.0]))
    assert np.allclose(got, want) and math.isclose(sum(n * len(x) for n, x in zip(got, pieces)), 3 * 1001)


def test_op4_base_counts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    words = {k: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if w] + ["\0"] for k, t in texts.items()}
    seen = Counter(w for k, row in words.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in row)
    total = sum(seen.values())
    for r in op4_lattice_lm(spark, SF).collect():
        row = words[r.doc_id]
        base = sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (len(seen) + 1))) for w in row)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(row), sum(seen[w] > 0 for w in row), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)


def test_lm_score_equals_brute_force(spark):
    """Scores and learnt weights of whole texts, words of 65 to 5,000 bytes among them, by plain recursions."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "Cat", "naïve", "中文字", "x1", "a" * 65, "ab" * 60, "言" * 30]) for _ in range(rng.randrange(1, 12))) for _ in range(12)]
    texts += ["", "q" * 5000, "一" * 400 + " the"]
    got = {r.doc_id: r for r in score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, F.col("doc_id") % 3 != 1, head=3).collect()}
    pieces, prior = vocabulary(path)
    weight = dict(zip(pieces, prior))
    longest = max(map(len, pieces))

    def plain(text):
        return [b"".join(bytes([b + 32]) if 65 <= b <= 90 else bytes([b]) for b in w) for w in text.encode().split()]

    def alphas(word, weight):
        # scaled by the sum so far, so that nothing underflows
        a, scale = [1.0], [0.0]
        for end in range(1, len(word) + 1):
            total = sum(a[s] * math.exp(scale[s] - scale[-1]) * weight[word[s:end]] for s in range(max(0, end - longest), end) if word[s:end] in weight)
            a.append(1.0)
            scale.append(scale[-1] + math.log(total))
        return scale

    expected = np.zeros(len(pieces))
    place = {p: i for i, p in enumerate(pieces)}
    backward = {p[::-1]: w for p, w in weight.items()}
    for n, text in enumerate(texts):
        if n % 3 != 1:
            for w in plain(text):
                w = b" " + w
                ahead, behind = alphas(w, weight), alphas(w[::-1], backward)[::-1]
                for s in range(len(w)):
                    for e in range(s + 1, min(len(w), s + longest) + 1):
                        if w[s:e] in weight:
                            expected[place[w[s:e]]] += math.exp(ahead[s] + behind[e] - ahead[-1]) * weight[w[s:e]]
    learnt = 1000 * prior + expected
    learnt = dict(zip(pieces, learnt / learnt.sum()))
    train = [plain(t) for n, t in enumerate(texts) if n % 3 != 1]
    tokens = sum(map(len, train)) + len(train)
    stop = (len(train) + 1) / (tokens + 2)
    for n, text in enumerate(texts):
        own = plain(text)
        want = math.log10(stop) + len(own) * math.log10(1 - stop) + sum(alphas(b" " + w, learnt)[-1] for w in own) / math.log(10)
        assert math.isclose(got[n].score, want, rel_tol=1e-9) and got[n].train_tokens == tokens


def test_lm_rare_words_and_odd_table(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    few, many = (sorted((str(r.doc_id), r.n_tokens, round(r.score, 6), round(r.base_score, 6)) for r in score(odd_docs(spark), path, head=h).collect()) for h in (1, 1000))
    assert few == many and len(few) == len(ODD) + 2
    assert score(odd_docs(spark).limit(0), path).count() == 0
    pieces, prior = vocabulary(path)
    assert all(bytes([b]) in set(pieces) for b in range(256) if b != 32) and math.isclose(prior.sum(), 1)


# license scan -----------------------------------------------------------------


def test_license_spans(spark):
    docs = [(1, "Released under the MIT License."), (2, "This work is licenced under the GNU General Public Licence, version 3"), (3, "Licensed under CC BY-NC 4.0."),
            (4, "nothing to see"), (5, "Redistribution and use in source and binary form, with or without modificatoin, are permitted"), (6, "limit license; apache licenses"), (7, None)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [(x.word, x.label) for x in got[1].exact] == [(3, "mit")] and got[1].n_words == 5
    assert {x.label for x in got[2].spans} == {"gpl"} and not got[2].exact and got[2].spans[0].edits == 2
    assert got[2].spans[0].first_word == 3 and got[2].spans[0].last_word == 10
    assert {x.label for x in got[3].spans} == {"cc-by-nc"} and {x.label for x in got[5].spans} == {"bsd"}
    assert not got[4].spans and not got[6].exact and got[7].n_words == 0
    rows = license_scan.op5_license_scan(spark, SF).collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in rows)
    assert license_scan.scan(odd_docs(spark)).count() == len(ODD) + 2


def test_license_spans_of_neighbours_and_repeats():
    find = license_scan.searcher(license_scan.NOTICES, 0.08)
    # a notice with an error keeps its span when an exact one follows
    rows = license_scan.spans_by_word("released under the mit licence released under the mit license", find)
    assert [(r["first_word"], r["last_word"], r["edits"]) for r in rows] == [(0, 4, 1), (5, 9, 0)]
    rows = license_scan.spans_by_word(" ".join(["x released under the mit license"] * 2000), find)
    assert [r["first_word"] for r in rows] == [1 + 6 * k for k in range(2000)]


def test_op5_base_columns_equal_sql(spark):
    sql = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
p AS (SELECT * FROM (VALUES ('mit license', 2, 'mit'), ('apache license', 2, 'apache'), ('general public license', 3, 'gpl')) t(phrase, n, label)),
f AS (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), p WHERE array_to_string(w[i:i + n - 1], ' ') = phrase)
SELECT d.doc_id, len(w) AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id, w"""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = {r[0]: tuple(r[1:]) for r in con.execute(sql).fetchall()}
    got = license_scan.op5_license_scan(spark, sf).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == want and sum(x[1] for x in want.values()) > 20


def test_repeated_heads_of_a_notice_cost_little():
    find = license_scan.searcher(license_scan.NOTICES, 0.08)
    head = license_scan.NOTICES[1][0]
    began = time.perf_counter()
    assert not license_scan.fuzzy_spans(" ".join([head[:60]] * 1700), find) and not license_scan.fuzzy_spans(" ".join([head[:75]] * 1400), find)
    assert time.perf_counter() - began < 5


def test_license_base_is_every_consecutive_place(spark):
    text = "MIT license mit LICENSE x general public license general public license"
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [x.word for x in row.exact] == [0, 2, 5, 8]


def test_fuzzy_search_misses_nothing_within_its_bound():
    find = license_scan.searcher(license_scan.NOTICES, 0.08)
    rng = random.Random(9)
    for notice in find.notices:
        for _ in range(20):
            s = list(notice.text)
            for _ in range(rng.randrange(notice.errors + 1)):
                k = rng.randrange(1, len(s) - 1)
                op = rng.randrange(3)
                s[k : k + (op != 0)] = [] if op == 1 else [rng.choice("abcdefg")]
            text = f"foo bar {''.join(s)} baz"
            assert any(x[0] == notice.label for x in license_scan.fuzzy_spans(text, find))


# token counts -----------------------------------------------------------------


def test_edits_count_as_a_fresh_count():
    enc = byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    counts = token_counts.Counts(enc._encode_single_piece)
    rng = random.Random(4)
    parts = ["a", "b", "the ", "'s", " ", "  ", "\n", "1", "23", ".", " !", "é", "'", "re ", "\t"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 30, 900])))
        tree = token_counts.SegmentTree(text, counts, rng.choice([1, 2, 16]))
        for _ in range(rng.randrange(1, 10)):
            a = rng.randrange(-2, len(text) + 3)
            b = a + rng.choice([0, 1, 3, 20, 200])
            new = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 40])))
            tree.edit(a, b, new)
            start = min(max(a, 0), len(text))
            stop = min(max(b, start), len(text))
            text = text[:start] + new + text[stop:]
            assert tree.text() == text and tree.n_tokens == len(enc.encode_ordinary(text)) and tree.n_pieces == len(token_counts.SPLIT.findall(text))


def test_the_special_token_is_one_token():
    """As packing counts it, also where an edit makes, breaks or meets it."""
    enc = byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    counts = token_counts.Counts(enc._encode_single_piece)
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|", "endoftext", "|>", "<", "<|endof", "text|>", "x", " ", "\n ", "!", "  ", "some "]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 2, 8, 60])))
        tree = token_counts.SegmentTree(text, counts, rng.choice([1, 2, 16]))
        assert tree.n_tokens == len(encoded(text, enc))
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(0, len(text) + 1)
            b = min(a + rng.choice([0, 1, 1, 3, 13]), len(text))
            new = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.n_tokens == len(encoded(text, enc))


def test_kept_trees_are_edited_on(spark):
    """Two calls of edits on a stored table of trees count as fresh texts do, and encode little."""
    path, enc = public_tokenizers.path("byte_bpe_50k.tiktoken"), byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = {1: "some words of a text. " * 3000, 2: "", 3: None, 4: "a <|endoftext|> b", 5: " \n" * 50}
    trees = written(token_counts.build_trees(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path), "trees")
    texts = {k: t or "" for k, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in trees.collect()} == {k: len(encoded(t, enc)) for k, t in texts.items()}
    schema = "doc_id long, edits array<struct<start: int, stop: int, new: string>>"
    for edits in ({1: [(30000, 30005, "new ones"), (5, 6, None)], 2: [(0, 0, "no more <|endoftext|>")], 9: [(0, 1, "?")]}, {1: [(60000, 60001, "")], 4: [(3, 4, "")], 5: None}):
        trees = written(token_counts.edit_trees(trees, spark.createDataFrame(list(edits.items()), schema), path).drop("n_reencoded") if 9 not in edits else
                        token_counts.edit_trees(trees, spark.createDataFrame(list(edits.items()), schema), path), "trees")
        for k, some in edits.items():
            for a, b, new in (some or []) if k in texts else []:
                texts[k] = texts[k][:a] + (new or "") + texts[k][max(a, b):]
        rows = {r.doc_id: r for r in trees.collect()}
        assert {k: (r.text, r.n_tokens, sum(r.tokens)) for k, r in rows.items()} == {k: (t, len(encoded(t, enc)), len(encoded(t, enc))) for k, t in texts.items()}
        if 9 in edits:
            assert 0 < rows[1].n_reencoded < 60 and rows[4].n_reencoded == 0
    assert token_counts.build_trees(trees.limit(0), path).count() == 0


def test_edits_touch_little(spark):
    docs = spark.createDataFrame([(1, "some words of a text. " * 2000)], "doc_id long, text string")

    edits = F.array(*[F.struct(F.lit(k * 4000).alias("start"), F.lit(k * 4000 + 5).alias("stop"), F.lit("new ones").alias("new")) for k in range(10)])
    row = token_counts.count_edited(docs.withColumn("edits", edits), public_tokenizers.path("byte_bpe_50k.tiktoken")).first()
    assert row.n_edits == 10 and row.n_pre_tokens > 10000 and row.n_reencoded < 100


def test_op2_counts(spark):
    enc = byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    edits = {r.doc_id: r.edits for r in docs.withColumn("edits", token_counts.derived_edits()).collect()}
    for r in token_counts.op2_token_counts(spark, SF).collect():
        text = texts[r.doc_id]
        assert r.n_tokens == len(enc.encode_ordinary(text)) and r.n_edits == len(edits[r.doc_id])
        for e in edits[r.doc_id]:
            text = text[: e.start] + e.new + text[max(e.stop, e.start) :]
        assert r.n_tokens_after == len(enc.encode_ordinary(text)) and r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_token_counts_odd_table(spark):

    docs = odd_docs(spark).withColumn("edits", F.when(F.col("doc_id") == 3, F.array(F.struct(F.lit(99).alias("start"), F.lit(None).cast("int").alias("stop"), F.lit(None).cast("string").alias("new")))))
    rows = token_counts.count_edited(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert len(rows) == len(ODD) + 2 and all(r.n_tokens == r.n_tokens_after for r in rows)
