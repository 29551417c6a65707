"""Line dedup: levelled sorted runs of line hashes (DataFrame operations only).

Documents go through in batches of ascending doc_id. What earlier batches have
seen lies in sorted runs, tables bucketed and sorted by the hash of a line with
the smallest doc_id that holds it. Each batch

1. reduces its lines to (hash, smallest doc_id), partly before the shuffle, so
   that a line found in a third of all documents costs a row a task;
2. merge-anti-joins that with each run: the batch is shuffled and sorted once, the
   runs neither, as they have the batch's bucketing and their files' order is used;
3. writes what is left as a new run of level 0. As soon as a level has `fanout`
   runs they are compacted into one of the next level, so a batch meets at
   most (fanout - 1) * log(batches) runs. Compaction is a merge as well, bucket by
   bucket: an outer merge join of two sorted runs that share no hash.

Runs may be kept in a folder: a later call goes on with them, so that its documents
lose what documents of earlier calls have.

A line stays where (hash, doc_id) is in the runs. That last anti-join is on hash
*and* document, so a frequent line is spread over as many tasks as it has
documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, id_and_text, scratch_path, table, written

LAST = 2**63 - 1
HASH = ["h1", "h2"]


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(owner, text_hash, pos, h1, h2) of every line whose key is long enough; 128 bits of hash."""
    lines = docs.select(
        F.coalesce("doc_id", F.lit(LAST)).alias("owner"), F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"),
    )
    keyed = lines.select("owner", "text_hash", "pos", ascii_lower(F.btrim("line", F.lit(SPACES))).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        "owner", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (names with __ for dots) for a while."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, old in before.items():
            if old is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, old)


class SortedRuns:
    """The runs of hashes seen so far: bucketed tables in the shared folder, or in a folder of their own that outlives the session.

    In such a folder `commits` says which runs are current, by a row a run and the
    number of the commit; one that stops before its commit changes nothing. It takes one
    writer at a time. Runs that no commit names any more stay on disk.
    """

    COMMITS = "seq long, level int, path string, buckets int"

    def __init__(self, spark: SparkSession, buckets: int, fanout: int, folder: str | None = None):
        self.spark, self.buckets, self.fanout, self.folder = spark, buckets, fanout, folder
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        self.seq = 0
        for row in self._committed() if folder else []:
            self.seq, self.buckets = row.seq, row.buckets  # runs that meet have the same buckets
            self._list(self._table(row.path), row.level)

    def _committed(self) -> list:
        """The rows of the last commit, one a run."""
        try:
            commits = self.spark.read.schema(self.COMMITS).parquet(f"{self.folder}/commits")
        except Exception as e:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        last = commits.agg(F.max("seq")).first()[0]
        return commits.filter(F.col("seq") == F.lit(last)).orderBy("level", "path").collect()

    def _table(self, path: str) -> str:
        """A name in the catalog for the run at path."""
        name = f"line_run_{uuid.uuid4().hex}"
        quoted = path.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, owner BIGINT) USING parquet "
                       f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{quoted}'")
        self.paths[name] = path
        return name

    def _list(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def settings(self):
        """For what reads or adds runs: a batch is shuffled as runs are bucketed, and runs' order is made use of."""
        return settings(self.spark, spark__sql__shuffle__partitions=str(self.buckets), spark__sql__legacy__bucketedTableScan__outputOrdering="true")

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _stored(self, rows: DataFrame) -> str:
        """rows (h1, h2, owner), of which no bucket lies in two tasks, as a table of one sorted file a bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = f"{self.folder}/run-{uuid.uuid4().hex}" if self.folder else scratch_path(self.spark, "line-run")
        (rows.select(*HASH, "owner").write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self.paths[name]).saveAsTable(name))
        return name

    def unseen(self, seen: DataFrame) -> DataFrame:
        """Of (h1, h2, owner), unique by hash, what no run has.

        An outer join whose matches go: Spark would move a plain anti-join to before the
        aggregation that made seen, where a frequent line has all its rows.
        """
        for run in self.tables():
            known = run.select(*HASH, F.col("h2").alias("known")).hint("merge")
            seen = seen.join(known, HASH, "left").filter("known is null").drop("known")
        return seen

    def merged(self, one: str, other: str) -> DataFrame:
        """The rows of two runs."""
        right = self.spark.table(other).withColumnRenamed("owner", "other")
        both = self.spark.table(one).join(right.hint("merge"), HASH, "full_outer")
        return both.select(*HASH, F.coalesce("owner", "other").alias("owner"))

    def add(self, seen: DataFrame) -> None:
        """Store what of (h1, h2, owner), unique by hash and shuffled by it, no run has yet."""
        self._list(self._stored(self.unseen(seen)), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            first, *rest = self.levels[level]
            self.levels[level] = []
            for name in rest:
                both = self._stored(self.merged(first, name))
                self._drop(first, name)
                first = both
            self._list(first, level + 1)
            level += 1

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            del self.paths[name]

    def commit(self) -> None:
        """Make the runs of now those that the next call finds in the folder."""
        rows = [F.struct(F.lit(self.seq + 1).cast("long").alias("seq"), F.lit(level).alias("level"), F.lit(self.paths[name]).alias("path"), F.lit(self.buckets).alias("buckets"))
                for level, names in enumerate(self.levels) for name in names]
        self.spark.range(1).coalesce(1).select(F.inline(F.array(*rows))).write.mode("append").parquet(f"{self.folder}/commits")
        self.seq += 1

    def forget(self) -> None:
        """Take the runs out of the catalog."""
        self._drop(*list(self.paths))
        self.levels = []

    def all(self) -> DataFrame:
        first, *rest = self.tables()
        for run in rest:
            first = first.unionByName(run)
        return first


def dropped_lines(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = 2, folder: str | None = None,
                  batch_docs: int = 20_000_000) -> DataFrame:
    """(owner, text_hash, dropped): for documents that lose lines, the positions they lose."""
    spark = docs.sparkSession
    if batches is None:
        batches = max(4, -(-docs.count() // batch_docs))
    # approximate cuts suffice: any ascending batches give the same result
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], max(1000, 10 * batches))).first()[0] or []
    cuts = sorted(set(cuts))
    batch = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("owner"))) if cuts else F.lit(0)
    lines, path = line_hashes(docs, min_chars).withColumn("batch", batch), scratch_path(spark, "line-hashes")
    lines.write.partitionBy("batch").parquet(path)  # a batch reads its own lines alone
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = SortedRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout, folder)
    try:
        with runs.settings():
            for n in range(len(cuts) + 1):
                runs.add(lines.filter(F.col("batch") == n).groupBy(*HASH).agg(F.min("owner").alias("owner")))
        gone = lines.join(runs.all(), [*HASH, "owner"], "left_anti")
        dropped = written(gone.groupBy("owner", "text_hash").agg(F.collect_set("pos").alias("dropped")), "dropped-lines")
        if folder:
            runs.commit()
    finally:
        runs.forget()
    return dropped


def with_lines_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                       batches: int | None = None, fanout: int = 2, counts: bool = False, folder: str | None = None) -> DataFrame:
    """docs with every line gone that an earlier document (by id) has too; all columns, a row per input row.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased;
    keys under min_chars code points are never dropped. All lines with a key stay in
    the smallest doc_id that holds it. With counts, two columns are added: n_lines
    (before) and n_dropped. Batches are four, or one for each 20 million documents
    where that is more, unless batches says how many.

    With folder (one that executors share) the runs are kept there, and lines go as well
    that a document of an earlier call with that folder has, whatever its id; a document
    that an earlier call has had already (by id) keeps what it kept.

    A null text is one empty line and comes back empty. A null id counts as the
    largest. Rows that repeat one id are one document: a key stays in all of them. An
    empty table gives an empty table. Documents that lose all lines stay, with an empty
    text. Very long texts are split whole, in one row's task. Of equal lines in one
    document none is dropped for the other.
    """
    own = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"),
        F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("owner"))
    lost = dropped_lines(id_and_text(docs, id_col, text_col), min_chars, batches, fanout, folder)
    both = own.withColumn("text_hash", F.xxhash64("text")).join(lost, ["owner", "text_hash"], "left")
    kept = F.expr("""
        array_join(transform(array(split(text, '\\n', -1)), a ->
            transform(array_except(sequence(0, size(a) - 1), dropped), p -> a[p]))[0], '\\n')""")
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept)
    found = both.select(
        *[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns],
        *([F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
           F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped")] if counts else []))
    return found


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_lines_dropped(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i, ls[i] AS line,
    translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs)),
firsts AS (SELECT key, min(doc_id) AS first_id FROM lines WHERE length(key) >= 10 GROUP BY key),
flagged AS (SELECT l.*, coalesce(f.first_id <> l.doc_id, false) AS gone FROM lines l LEFT JOIN firsts f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
