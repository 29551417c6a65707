"""Merkle manifest of a dataset, with a proof for every document, by time-forward processing.

Documents are the leaves of one 8-ary tree a group (language), the groups' roots those of
one more. A node's label is (last leaf under it, its level): children come before their
parent. An upward sweep takes nodes by label and sends each digest forward to its
parent, a downward sweep takes them by falling label and sends each child what its proof
still lacks: the siblings of all its ancestors.

Messages wait in a priority queue ordered by label. Between tasks that is Spark's
external sort: rows are dealt by block, SPAN ** LEVELS neighbouring nodes, and sorted,
so a block reads its nodes (and, downwards, first what was sent to its top) in order.
In a task it is a heap, which never holds more than SPAN messages a level. A round lifts
all nodes by LEVELS levels, so rounds are few (4 for 10 ** 10 documents), every block is
bounded, and what a block sends on is one digest up, one proof suffix down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

SPAN, LEVELS = 8, 3
#: (left siblings, right siblings), level by level from the node up, digests concatenated.
Path = tuple[tuple[str, str], ...]
PATH = "array<struct<l: string, r: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*columns: Column) -> Column:
    """sha256 of the columns, each its UTF-8 byte count, a colon and itself, or - for NULL."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


# one block ------------------------------------------------------------------------


def height(n: int, levels: int = LEVELS) -> int:
    """Levels above n nodes of a group within a round."""
    t = 0
    while t < levels and SPAN**t < n:
        t += 1
    return t


def label(level: int, index: int, n: int) -> tuple[int, int]:
    return min((index + 1) * SPAN**level, n) - 1, level


def upward(digests: Iterator[str], n: int, top: int, runs: dict[tuple[int, int], list[str]] | None = None) -> str:
    """The digest of the node `top` levels above a block's n nodes, which come in order. runs: gets the children of every inner node."""
    if top == 0:
        return next(digests)
    queue: list[tuple[tuple[int, int], int, str]] = []  # (label of the receiver, which child, digest)
    for at, own in enumerate(digests):
        heappush(queue, (label(1, at // SPAN, n), at, own))
        # whoever has its last child by now is next in the order of labels
        while queue[0][0][0] <= at:
            receiver = queue[0][0]
            run, child = [], 0
            while queue and queue[0][0] == receiver:
                _, child, message = heappop(queue)
                run.append(message)
            level, index = receiver[1], child // SPAN
            if runs is not None:
                runs[level, index] = run
            own = digest("".join(run))
            if level == top:
                return own
            heappush(queue, (label(level + 1, index // SPAN, n), index, own))
    raise ValueError("a block lacks nodes")


def downward(digests: list[str], top: int, suffix: Path) -> Iterator[tuple[int, Path]]:
    """(which, path to the root) of a block's nodes, last first. suffix: the path of the block's top."""
    n, runs = len(digests), {}
    upward(iter(digests), n, top, runs)
    first = label(top, 0, n)
    queue: list[tuple[int, int, int, Path]] = [(-first[0], -top, 0, suffix)]
    while queue:
        _, level, index, path = heappop(queue)
        level = -level
        if level == 0:
            yield index, path
            continue
        run = runs[level, index]
        for k in range(len(run)):
            child = index * SPAN + k
            last, below = label(level - 1, child, n)
            heappush(queue, (-last, -below, child, (("".join(run[:k]), "".join(run[k + 1 :])), *path)))


def folded(own: str, path: Path) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        own = digest(left + own + right)
    return own


# all blocks ------------------------------------------------------------------------


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos (from 0, by order) and n within grp, without a group in one task: ranges are sorted, then offsets by range added."""
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())  # rows that are equal throughout can lie in several ranges
    by = ["grp", *order, "_tie"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = tie.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "merkle-order").withColumn("_range", F.shiftright("_at", 33))
    runs = placed.groupBy("grp", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    own, before = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select("grp", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("n"))
    return placed.join(shifts, ["grp", "_range"]).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "n")


def in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[dict]]]:
    """The rows of each (grp, block), in order; they don't outlive the next block."""
    rows = (r for batch in batches for r in batch.to_pylist())
    return groupby(rows, lambda r: (r["grp"], r["block"]))


def sweep_up(nodes: DataFrame, levels: int) -> DataFrame:
    """(grp, pos, n, digest) of the nodes some levels above, or of a group's root if that comes first."""
    size = SPAN**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, block), rows in blocks_of(batches):
            first = next(rows)
            n = first["n"]
            top = height(n, levels)
            found = upward((r["digest"] for r in (first, *rows)), min(size, n - block * size), top)
            yield pa.RecordBatch.from_pylist([{"grp": grp, "pos": block, "n": -(-n // SPAN**top), "digest": found}])

    blocks = in_blocks(nodes.select("grp", "pos", "n", "digest", F.floor(F.col("pos") / size).alias("block")))
    return blocks.mapInArrow(run, "grp string, pos long, n long, digest string")


def sweep_down(nodes: DataFrame, suffixes: DataFrame, emit: Callable[[dict, Path, dict], dict], schema: str, levels: int,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """emit(node, path, suffix row) of all nodes. suffixes: grp, pos of the block above, path, subroot, root."""
    sent = suffixes.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", "subroot", "root")
    own = nodes.select("grp", "pos", F.floor(F.col("pos") / SPAN**levels).alias("block"), "n", "digest", *keep)
    mixed = in_blocks(own.unionByName(sent, allowMissingColumns=True))
    target = mixed.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in blocks_of(batches):
            above, *held = rows
            suffix = tuple((p["l"], p["r"]) for p in above["path"])
            found = [emit(held[k], path, above) for k, path in downward([r["digest"] for r in held], height(held[0]["n"], levels), suffix)]
            yield pa.RecordBatch.from_pylist(found, schema=target)

    return mixed.mapInArrow(run, schema)


def passed_on(node: dict, path: Path, above: dict) -> dict:
    return {"grp": node["grp"], "pos": node["pos"], "path": [{"l": a, "r": b} for a, b in path], "subroot": above["subroot"], "root": above["root"]}


def rounds_up(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """nodes and the tables of each round above them; the last has one node a group."""
    found = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        found.append(written(sweep_up(found[-1], levels), "merkle-up"))
        most = -(-most // SPAN**levels)
    return found


def rounds_down(rounds: list[DataFrame], suffixes: DataFrame, levels: int) -> DataFrame:
    """Suffixes of the nodes of rounds[0], from those above the last."""
    for nodes in reversed(rounds):
        suffixes = written(sweep_down(nodes, suffixes, passed_on, f"grp string, pos long, path {PATH}, subroot string, root string", levels), "merkle-down")
    return suffixes


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf. leaves: doc_id, grp, leaf, claim.

    claim: the leaf that whoever holds a document computes; the original siblings lead
    from it to folded_root, which is the root only if nothing was changed. NULL: the leaf.

    Leaves of a group ascend by doc_id (NULL first), those of one id by digest; groups
    ascend bytewise. A repeated row is a leaf each time. A group's lone leaf is its
    subroot, a lone subroot the root. No leaves, no rows. levels: those of a round.
    """
    leaves = numbered(leaves.withColumn("digest", F.col("leaf")).select("grp", "doc_id", "digest", "claim"), ["doc_id", "digest"])
    leaves = written(leaves, "merkle-leaves")
    rounds = rounds_up(leaves, levels)
    subroots = rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    groups = written(numbered(subroots, ["name"]), "merkle-groups")
    tops = rounds_up(groups, levels)
    # the root's own suffix is empty
    start = tops[-1].select("grp", "pos", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    found = rounds_down(tops[:-1], start, levels)
    named = found.join(groups.select("pos", F.col("name"), F.col("digest").alias("own")), "pos")
    suffixes = named.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("own").alias("subroot"), "root")
    suffixes = rounds_down(rounds[1:-1], suffixes, levels)

    def emit(node: dict, path: Path, above: dict) -> dict:
        root = folded(node["claim"] or node["digest"], path)
        return {"doc_id": node["doc_id"], "leaf": node["digest"], "subroot": above["subroot"], "root": above["root"], "proof_sha256": digest("".join(a + b for a, b in path)),
                "folded_root": root, "verified": root == above["root"]}

    return sweep_down(leaves, suffixes, emit, PROOFS, levels, ("doc_id", "claim"))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None, columns: tuple[str, ...] = COLUMNS,
             id_col: str = "doc_id", group_col: str = "lang", levels: int = LEVELS) -> DataFrame:
    """A proof for each row of docs; see proofs().

    changed: what whoever verifies holds instead of some columns, where `where` is true.
    Rows count by the named columns alone, NULLs and empty texts are told apart, texts
    are hashed whole; other columns may have any name. A NULL group is the first.
    """
    changed = changed or {}
    own = [docs[c] for c in columns]
    claim = leaf_digest(*[changed.get(c, docs[c]) for c in columns])
    hashed = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("1"), docs[group_col].cast("string")), F.lit("0")).alias("grp"),
                         leaf_digest(*own).alias("leaf"), (F.when(where, claim) if where is not None else F.lit(None).cast("string")).alias("claim"))
    return proofs(written(hashed, "merkle-hashes"), levels)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    tampered = F.crc32(docs["doc_id"].cast("string")) % 3 == 0
    return manifest(docs, {"text": ascii_lower(docs["text"])}, tampered)


def _sql() -> str:
    """Levels one by one: 7 of a group's tree, 3 of the groups'."""
    value = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in COLUMNS)
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = value.replace("strlen(text::VARCHAR)", f"strlen({lower})").replace("text::VARCHAR", lower)
    step = "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)), {step}), 4294967295)"
    ctes = [f"""leaves AS MATERIALIZED (SELECT doc_id, coalesce('1' || lang, '0') AS grp, sha256({value}) AS h, CASE WHEN {crc} % 3 = 0 THEN sha256({changed}) ELSE sha256({value}) END AS claim FROM documents)""",
            "a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves)"]

    def tree(name: str, levels: int) -> None:
        side = "coalesce(string_agg(h, '') OVER (PARTITION BY grp, pos // 8 ORDER BY pos ROWS BETWEEN {}), '')"
        for k in range(levels):
            ctes.append(f"{name}s{k} AS MATERIALIZED (SELECT grp, pos, {side.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{k} WHERE n > 1)")
            ctes.append(f"{name}{k + 1} AS MATERIALIZED (SELECT grp, pos // 8 AS pos, (any_value(n) + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{k} WHERE n > 1 GROUP BY grp, pos // 8)")
        ctes.append(f"{name}top AS (" + " UNION ALL ".join(f"SELECT grp, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")")

    tree("a", 7)
    ctes.append("b0 AS MATERIALIZED (SELECT 0 AS grp, grp AS name, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, h FROM atop)")
    tree("b", 3)
    joins, steps = "", [f"a{k}" for k in range(7)] + [f"b{k}" for k in range(3)]
    for s in steps:
        at = f"x.grp = {s}.grp AND x.pos // {8 ** int(s[1])} = {s}.pos" if s[0] == "a" else f"b.pos // {8 ** int(s[1])} = {s}.pos"
        joins += f" LEFT JOIN {s[0]}s{s[1]} {s} ON {at}"
    proof = " || ".join(f"coalesce({s}.l || {s}.r, '')" for s in steps)
    sides = ", ".join(f"{s}.l AS {s}l, {s}.r AS {s}r" for s in steps)
    ctes.append(f"f0 AS (SELECT x.doc_id, x.h AS leaf, b.h AS subroot, btop.h AS root, sha256({proof}) AS proof_sha256, x.claim AS f, {sides} FROM a0 x JOIN b0 b ON b.name = x.grp CROSS JOIN btop{joins})")
    for k, s in enumerate(steps):
        ctes.append(f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN {s}l IS NULL THEN f ELSE sha256({s}l || f || {s}r) END AS f) FROM f{k})")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}"


OP13_SQL = _sql()
