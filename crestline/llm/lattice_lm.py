"""LM scoring: marginal likelihood over all segmentations of a text into subword pieces.

The pieces are those of an existing vocabulary file; nothing is added to it. A
text's probability is the sum, over all ways to cut it into pieces, of the product
of the pieces' probabilities: a forward recursion over the bytes in log space.
A piece never reaches over a blank, so a text's log probability is the sum over
its words of the word's, and each distinct word is worked on once:

1. one pass over the documents counts words, in all and in training documents,
   partly in each task before the shuffle (so a word in every document costs a row
   a task), into a stored table of words;
2. the vocabulary's own scores (ranks) give every piece a first probability; one
   pass over the table of training words (forward and backward) turns that into
   expected piece counts, 32,000 sums, and so into the probabilities that are used;
3. a pass over the table of words adds each word's log probability;
4. a second pass over the documents adds up what concerns the `head` most frequent
   words, a table bounded by that number, and joins only the other, rarer words.
   Those are spread evenly, for no frequent word is left among them. Here a word of
   over 64 bytes goes by a 128-bit digest, so the head is bounded in bytes as well.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, table, written

LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LN10 = math.log(10)
HEAD = 50_000
MIXER = np.uint64(0x100000001B3)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
BITS = 20


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()


def key_of(word: bytes) -> bytes:
    """A word as it is; a long one's digest after a byte that UTF-8 has not."""
    return word if len(word) <= 64 else b"\xff" + xxhash.xxh3_128_digest(word)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[bytes, ...], np.ndarray]:
    """(pieces as bytes, their prior probabilities). A blank stands for the start of a word.

    The file's scores are ranks (0, -1, -2, ..); their probability falls with the rank
    by Zipf's law. Byte pieces and others without a rank of their own come last.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mass: dict[bytes, float] = {}
    size = model.get_piece_size()
    for i in range(size):
        if model.is_control(i) or model.is_unknown(i):
            continue
        if model.is_byte(i):
            piece, rank = bytes([int(model.id_to_piece(i)[3:5], 16)]), float(size)
        else:
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            rank = min(-model.get_score(i), float(size))
        if b" " not in piece[1:]:
            mass[piece] = mass.get(piece, 0.0) + 1 / (rank + 2.7)
    pieces = tuple(sorted(mass))
    prior = np.array([mass[p] for p in pieces])
    return pieces, prior / prior.sum()


class Lattice:
    """Forward and backward recursions over words, many of one length at a time."""

    def __init__(self, pieces: tuple[bytes, ...], log_p: np.ndarray):
        self.pieces, self.log_p = pieces, log_p
        self.longest = max(map(len, pieces))
        self.index = {p: i for i, p in enumerate(pieces)}
        codes = np.array([self.code(p) for p in pieces], np.uint64)
        order = np.argsort(codes)
        self.codes, self.ids = codes[order], order
        slots = (self.codes >> np.uint64(64 - BITS)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange(1 << BITS)).astype(np.int32)
        self.deepest = int(np.bincount(slots).max())
        self.powers = np.array([pow(int(MIXER), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)

    @staticmethod
    def code(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(MIXER) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h * int(SPREAD) & 0xFFFFFFFFFFFFFFFF

    def edges(self, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, row numbers, piece ids) of the pieces in words of one length, by ascending end."""
        n, length = rows.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for k in range(length):
            prefix[k + 1] = prefix[k] * MIXER + rows[:, k] + np.uint64(1)
        for end in range(1, length + 1):
            for start in range(max(0, end - self.longest), end):
                codes = (prefix[end] - prefix[start] * self.powers[end - start]) * SPREAD
                at = self.first[(codes >> np.uint64(64 - BITS)).astype(np.int64)]
                hit = np.full(n, -1)
                for k in range(self.deepest):
                    spot = np.minimum(at + k, len(self.codes) - 1)
                    hit = np.where(self.codes[spot] == codes, self.ids[spot], hit)
                some = np.flatnonzero(hit >= 0)
                if len(some):
                    yield start, end, some, hit[some]

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, list]:
        edges = list(self.edges(rows))
        alpha = np.full((rows.shape[1] + 1, len(rows)), -np.inf)
        alpha[0] = 0
        for start, end, some, piece in edges:
            alpha[end, some] = np.logaddexp(alpha[end, some], alpha[start, some] + self.log_p[piece])
        return alpha, edges

    def long_forward(self, word: bytes) -> list[float]:
        """The same for a single long word, byte by byte."""
        alpha = [0.0]
        index, log_p = self.index, self.log_p
        for end in range(1, len(word) + 1):
            terms = [alpha[s] + log_p[i] for s in range(max(0, end - self.longest), end) if (i := index.get(word[s:end])) is not None]
            top = max(terms)
            alpha.append(top + math.log(math.fsum(math.exp(t - top) for t in terms)))
        return alpha

    def long_word(self, word: bytes) -> float:
        return self.long_forward(word)[-1]

    def long_counts(self, word: bytes, weight: float, total: np.ndarray) -> None:
        """Adds a single long word's expected pieces to total, byte by byte from its end."""
        alpha, size = self.long_forward(word), len(word)
        index, log_p = self.index, self.log_p
        beta = [-math.inf] * size + [0.0]
        for start in range(size - 1, -1, -1):
            steps = [(i, beta[e] + log_p[i]) for e in range(start + 1, min(size, start + self.longest) + 1) if (i := index.get(word[start:e])) is not None]
            top = max((x for _, x in steps), default=-math.inf)
            if top == -math.inf:
                continue
            beta[start] = top + math.log(math.fsum(math.exp(x - top) for _, x in steps))
            for i, x in steps:
                total[i] += weight * math.exp(alpha[start] + x - alpha[-1])

    def by_length(self, words: list[bytes], block: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(word numbers, bytes as a matrix); a long word comes alone and without."""
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for same in np.split(order, cuts):
            length = sizes[same[0]] if len(same) else 0
            if length > 64:
                for one in same:
                    yield np.array([one]), None
                continue
            for at in range(0, len(same), block):
                part = same[at : at + block]
                joined = b"".join(words[i] for i in part)
                yield part, np.frombuffer(joined, np.uint8).reshape(len(part), length).astype(np.uint64)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability; words begin with their blank."""
        found = np.zeros(len(words))
        for part, rows in self.by_length(words):
            found[part] = [self.long_word(words[part[0]])] if rows is None else self.forward(rows)[0][-1]
        return found

    def expected_counts(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Expected number of each piece in the words, each taken weights times."""
        total = np.zeros(len(self.pieces))
        for part, rows in self.by_length(words):
            if rows is None:
                self.long_counts(words[part[0]], weights[part[0]], total)
                continue
            alpha, edges = self.forward(rows)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0
            for start, end, some, piece in reversed(edges):
                step = beta[end, some] + self.log_p[piece]
                share = np.exp(alpha[start, some] + step - alpha[-1, some]) * weights[part[some]]
                total += np.bincount(piece, share, len(total))
                beta[start, some] = np.logaddexp(beta[start, some], step)
        return total


def count_words(docs: DataFrame, training: F.Column, id_col: str, text_col: str) -> DataFrame:
    """(word, n, n_train): how often each word stands in all and in training documents; the empty word is the end."""
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), training.alias("training"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            every = list(kept[0].keys() | kept[1].keys())
            rest, train = ([c[w] for w in every] for c in kept)
            for c in kept:
                c.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(every, pa.binary()), pa.array(rest, pa.int64()), pa.array(train, pa.int64())], names=["word", "n_rest", "n_train"])

        for batch in batches:
            for text, training in zip(batch.column("text"), batch.column("training").to_pylist(), strict=True):
                counts = kept[bool(training)]
                counts.update(words_of(text.as_py()))
                counts[b""] += 1
                if len(kept[0]) + len(kept[1]) > 400_000:
                    yield out()
        yield out()

    partial = own.mapInArrow(run, "word binary, n_rest long, n_train long")
    return partial.groupBy("word").agg((F.sum("n_rest") + F.sum("n_train")).alias("n"), F.sum("n_train").alias("n_train"))


def piece_weights(words: DataFrame, path: str, strength: float = 1000.0) -> np.ndarray:
    """Log probability of each piece: expected counts in the training words, on top of `strength` counts by the prior."""
    pieces, prior = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first = vocabulary(path)
        lattice, total = Lattice(names, np.log(first)), np.zeros(len(names))
        for batch in batches:
            total += lattice.expected_counts([b" " + w for w in batch.column("word").to_pylist()], batch.column("n_train").to_numpy(zero_copy_only=False))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["piece", "amount"])

    known = words.filter("n_train > 0 and octet_length(word) > 0").select("word", "n_train")
    sums = known.mapInArrow(run, "piece int, amount double").groupBy("piece").agg(F.sum("amount").alias("amount")).toArrow()
    counts = strength * prior
    counts[sums.column("piece").to_numpy()] += sums.column("amount").to_numpy()
    return np.log(counts / counts.sum())


def score(docs: DataFrame, path: str, training: F.Column | None = None, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score each row's whole text; learn from the rows where training holds (None: all).

    Returns doc_id, n_tokens (words and one end), n_known (those that training has),
    train_tokens, base_score (log10, smoothed word counts), score (log10 of the text's
    marginal probability over all segmentations, the end included).

    Null and empty texts are the end alone. Null and repeated ids are carried along:
    rows are scored one by one. Very long texts are scored whole, one at a time, and so
    are very long words, in learning as well. Of equally frequent words the smaller
    comes first. Other columns are ignored. An empty table gives an empty table. Without
    training rows the vocabulary's own weights stand and no word is known.
    """
    spark = docs.sparkSession
    training = F.coalesce(training, F.lit(False)) if training is not None else F.lit(True)
    counts = written(count_words(docs, training, id_col, text_col), "word-counts")
    total, distinct, ends, texts = counts.agg(
        F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0),
        F.coalesce(F.max(F.when(F.octet_length("word") == 0, F.col("n_train"))), F.lit(0)),
        F.coalesce(F.max(F.when(F.octet_length("word") == 0, F.col("n"))), F.lit(0))).first()
    log_p = spark.sparkContext.broadcast(piece_weights(counts, path))
    unit = math.log10(total + 0.5 * (distinct + 1))
    # a text ends after a word, or goes on; as often as in the training documents
    stop = (ends + 1) / (total + 2)
    go_on, stop = math.log10(1 - stop), math.log10(stop)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(path)[0], log_p.value)
        for batch in batches:
            marginal = lattice.log_probabilities([b" " + w for w in batch.column("word").to_pylist()]) / LN10
            keys = pa.array(map(key_of, batch.column("word").to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([keys, batch.column("n"), batch.column("n_train"), pa.array(marginal)], names=["word", "n", "n_train", "marginal"])

    weighed = written(counts.filter("octet_length(word) > 0").mapInArrow(weigh, "word binary, n long, n_train long, marginal double"), "word-scores")
    top = weighed.orderBy(F.desc("n"), "word").limit(head).toArrow()
    frequent = spark.sparkContext.broadcast(dict(zip(
        top.column("word").to_pylist(), zip(top.column("n_train").to_pylist(), top.column("marginal").to_pylist(), strict=True), strict=True)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and one for each of its rarer words."""
        known, number = frequent.value, TaskContext.get().partitionId() << 40
        base_of = {w: (math.log10(c + 0.5) - unit, c > 0, m) for w, (c, m) in known.items()}
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = Counter(words_of(text.as_py()))
                size = sum(words.values())
                n_known, base, marginal = int(ends > 0), math.log10(ends + 0.5) - unit, stop + go_on * size
                rare = []
                for word, n in words.items():
                    word = key_of(word)
                    if (found := base_of.get(word)) is not None:
                        base += n * found[0]
                        n_known += n * found[1]
                        marginal += n * found[2]
                    else:
                        rare.append((number, None, None, word, n, None, None))
                rows.append((number, doc_id, size + 1, None, n_known, base, marginal))
                rows += rare
                number += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["row", "doc_id", "n_tokens", "word", "n", "base", "marginal"])

    parts = id_and_text(docs, id_col, text_col).mapInArrow(split, "row long, doc_id long, n_tokens long, word binary, n long, base double, marginal double")
    parts = written(parts, "text-parts")
    rare = parts.filter("word is not null").select("row", "word", F.col("n").alias("times"))
    joined = rare.join(weighed.select("word", "n_train", F.col("marginal").alias("log_p")), "word")
    tail = joined.select(
        "row", (F.col("times") * (F.log10(F.col("n_train") + 0.5) - unit)).alias("base"), F.when(F.col("n_train") > 0, F.col("times")).otherwise(0).alias("n"),
        (F.col("times") * F.col("log_p")).alias("marginal"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"))
    head_rows = parts.filter("word is null").select("row", "base", "n", "marginal", "doc_id", "n_tokens")
    return head_rows.unionByName(tail).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("marginal").alias("score")).select(
        "doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    found = score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), fold != 1)
    return found.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
