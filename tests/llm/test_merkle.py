"""Merkle manifest against a plainly built tree."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from crestline.llm import merkle
from crestline.llm.merkle import OP13_SQL, downward, folded, height, manifest, op13_merkle_manifest, upward

SF = "/root/testdata/sf0.001"
NAMES = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, siblings of each leaf by level as (left, right))."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            paths[k].append((run[: p % 8], run[p % 8 + 1 :]))
        level = [h(*level[k : k + 8]) for k in range(0, len(level), 8)]
        at = [p // 8 for p in at]
    return level[0], paths


def plain(rows, tampered):
    """rows: tuples of NAMES."""
    def leaf(r):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    def lower(t):
        return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = own, *plain_tree([leaf(r) for r in own])
    root, tops = plain_tree([trees[g][1] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        own, subroot, paths = trees[g]
        for r, path in zip(own, paths, strict=True):
            siblings = path + top
            fold = leaf((*r[:4], lower(r[4]))) if tampered(r[0]) else leaf(r)
            for left, right in siblings:
                fold = h(*left, fold, *right)
            out.append((r[0], leaf(r), subroot, root, h(*[x for left, right in siblings for x in left + right]), fold, fold == root))
    return sorted(out, key=str)


def crc3(k):
    return k is not None and zlib.crc32(str(k).encode()) % 3 == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 73, 511, 512, 513])
def test_a_block(n):
    leaves = [h(str(k)) for k in range(n)]
    top = height(n)
    if n <= 512:
        root, paths = plain_tree(leaves)
        assert upward(iter(leaves), n, top) == root
        got = list(downward(leaves, top, (("x", "y"),)))
        assert [k for k, _ in got] == list(range(n))[::-1]
        for k, path in got:
            assert [("".join(a), "".join(b)) for a, b in paths[k]] + [("x", "y")] == list(path)
            assert folded(leaves[k], path[:-1]) == root
    else:
        assert top == merkle.LEVELS


def test_the_whole_table(spark):
    rows = [tuple(r[c] for c in NAMES) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*NAMES).collect()]
    got = sorted((tuple(r) for r in op13_merkle_manifest(spark, SF).collect()), key=str)
    assert got == plain(rows, crc3)
    assert 0 < sum(r[-1] for r in got) < len(got)
    names = [n.split()[0] for n in merkle.PROOFS.split(", ")]
    want = duckdb.connect().execute(f"SELECT {', '.join(names)} FROM ({OP13_SQL.replace('FROM documents', f"FROM '{SF}/documents.parquet'")})").fetchall()
    assert sorted(want, key=str) == got


def odd(n, seed):
    """Nulls in all columns, empty and long texts, repeated rows and ids, groups of one and of many."""
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        lang = draw.choice(["en"] * 20 + ["de", None, "", "é", "zz"] + [f"l{draw.randrange(40)}"])
        rows.append((draw.choice([k, k, k, k // 2, None]), draw.choice(["web", None]), lang, draw.choice([None, k]), draw.choice(["Aß:", "", None, "ABC" * draw.randrange(50)])))
    return rows + rows[:5] + [(n + 1, "x", "only", 1, "Z" * 300000)]


@pytest.mark.parametrize("n,levels", [(0, 3), (3, 3), (700, 3), (1500, 1)])
def test_odd_rows(spark, n, levels):
    """Blocks of 8 nodes give as many rounds as a large corpus; columns named like the operator's own change nothing."""
    rows = odd(n, n) if n else [(7, "s", "one", 1, "Text")]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int")
    got = manifest(docs, {"text": F.translate(docs.text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}, F.crc32(docs.doc_id.cast("string")) % 3 == 0, levels=levels)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, crc3)
    assert manifest(docs.limit(0)).count() == 0


def test_nothing_changed_is_verified(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert manifest(docs).filter("verified").count() == docs.count()
    assert manifest(docs, {"n_chars": docs.n_chars + 1}, docs.doc_id == 5).filter("not verified").select("doc_id").collect() == [(5,)]
