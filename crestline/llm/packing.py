"""Packing: vector bin packing with the dot-product heuristic.

Examples go into sequences under three limits at once: tokens, segments, and
loss-bearing tokens. A sequence is filled from a pool of pieces: of those that
fit, the one with the largest dot product of its needs and what the sequence has
left, both as shares of the limits. When none fits, a piece is cut to fill it.
Sequences that the end of the input or a limit leaves short are cut back to a
power of two tokens, which needs no padding, and the rest goes back to the pool.
A document's prompt (its first tokens) bears no loss: where the loss limit is
below the token limit, sequences full of answers are topped up with prompts.

Each task packs what it reads, so nothing is shuffled. It holds the pool (`pool`
pieces of less than a sequence each) and one batch.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: How the byte-level vocabularies cut a text before merging (a fixed pattern of the vocabulary file).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


END_OF_TEXT = "<|endoftext|>"
#: White space in a row that is cut off before the pattern is applied, whose matcher goes back step by step.
LONG_BLANK = regex.compile(r"\p{White_Space}{1000,}")
#: Loss-bearing tokens in a sequence of 1024: the rest is for prompts.
MAX_LOSS = 992


@lru_cache(maxsize=2)
def byte_bpe(ranks_path: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


@lru_cache(maxsize=2)
def id_sizes(ranks_path: str) -> np.ndarray:
    """How many bytes of text each id stands for."""
    enc = byte_bpe(ranks_path)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)


def encoded(text: str, enc: tiktoken.Encoding) -> list[int]:
    """The ids of a text; the special token's text stands for that token."""
    if len(text) < 100_000 or not LONG_BLANK.search(text):
        return enc.encode(text, allowed_special="all")
    ids: list[int] = []
    for k, part in enumerate(text.split(END_OF_TEXT)):
        if k:
            ids.append(enc.eot_token)
        at = 0
        for m in LONG_BLANK.finditer(part):
            # a pre-token takes all of the run, but for its last character where a word follows
            end = m.end() - (m.end() < len(part))
            ids += enc.encode_ordinary(part[at : m.start()]) + enc._encode_single_piece(part[m.start() : end])
            at = end
        ids += enc.encode_ordinary(part[at:])
    return ids


def tokenized(docs: DataFrame, ranks_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", prompt: Column | None = None) -> DataFrame:
    """(doc_id, ids, loss_start) of each text: ids as little-endian 32-bit integers, end_id last.

    prompt: the part of the text, from its start, that bears no loss (None: all bears
    loss); an id that reaches over its end bears loss. The ranks file is the same
    vocabulary as its JSON form; the special token's text stands for the special token,
    as that form has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = byte_bpe(ranks_path), id_sizes(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, starts = [], []
                for text, free in zip(part.column("text").to_pylist(), part.column("free").to_pylist(), strict=True):
                    row = np.array([*encoded(text, enc), end_id], dtype="<u4")
                    ids.append(row.tobytes())
                    starts.append(int(np.searchsorted(np.cumsum(sizes[row[:-1]]), free, "right")) if free else 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(starts, pa.int64())],
                                                 names=["doc_id", "ids", "loss_start"])

    free = F.lit(0) if prompt is None else F.coalesce(F.octet_length(prompt), F.lit(0))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), free.alias("free"))
    return own.mapInArrow(run, "doc_id long, ids binary, loss_start long")


def first_line(text: Column) -> Column:
    """A text up to its first \\n and with it; of a text of one line nothing."""
    return F.substring(text, F.lit(1), F.locate("\n", text))


class Piece:
    """ids[start:stop] of one example; those from loss_start on bear loss."""

    __slots__ = ("doc_id", "ids", "start", "stop", "loss_start")

    def __init__(self, doc_id: int | None, ids: np.ndarray, start: int, stop: int, loss_start: int):
        self.doc_id, self.ids, self.start, self.stop, self.loss_start = doc_id, ids, start, stop, loss_start

    def __len__(self) -> int:
        return self.stop - self.start

    def loss(self) -> int:
        return max(0, self.stop - max(self.start, self.loss_start))

    def take(self, tokens: int, loss: int) -> Piece | None:
        """Cut off the front: as many as both limits allow."""
        most = min(self.stop, self.start + tokens, max(self.start, self.loss_start) + loss)
        if most <= self.start:
            return None
        front = Piece(self.doc_id, self.ids, self.start, most, self.loss_start)
        self.start = most
        return front

    def give_back(self, tokens: int) -> Piece:
        """Cut off the last tokens."""
        self.stop -= tokens
        return Piece(self.doc_id, self.ids, self.stop, self.stop + tokens, self.loss_start)


class Packer:
    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int):
        self.limits, self.pool_size = (max_tokens, max_segments, max_loss), pool
        self.pieces: list[Piece] = []
        self.needs = np.zeros((2 * pool + 2, 2))  # tokens and loss-bearing tokens of the pooled pieces

    def pooled(self, piece: Piece) -> None:
        if len(piece):
            if len(self.pieces) == len(self.needs):
                self.needs = np.vstack([self.needs, np.zeros_like(self.needs)])
            self.needs[len(self.pieces)] = len(piece), piece.loss()
            self.pieces.append(piece)

    def picked(self, k: int) -> Piece:
        piece, last = self.pieces[k], self.pieces.pop()
        if last is not piece:
            self.pieces[k] = last
            self.needs[k] = self.needs[len(self.pieces)]
        return piece

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Take an example in; sequences that are ready come out."""
        tokens, _, loss = self.limits
        while len(piece) >= tokens:
            front = piece.take(tokens, loss)
            if len(front) == tokens:
                yield [front]
            else:
                self.pooled(front)
                while len(self.pieces) > self.pool_size:
                    yield self.sequence()
        self.pooled(piece)
        while len(self.pieces) > self.pool_size:
            yield self.sequence()

    def flush(self) -> Iterator[list[Piece]]:
        while self.pieces:
            yield self.sequence()

    def sequence(self) -> list[Piece]:
        max_tokens, max_segments, max_loss = self.limits
        tokens, segments, loss, row = max_tokens, max_segments, max_loss, []
        while tokens and segments and self.pieces:
            needs = self.needs[: len(self.pieces)]
            fits = (needs[:, 0] <= tokens) & (needs[:, 1] <= loss)
            if fits.any():
                score = needs[:, 0] * (tokens / max_tokens**2) + needs[:, 1] * (loss / max_loss**2) + segments / max_segments**2
                piece = self.picked(int(np.where(fits, score, -1.0).argmax()))
            else:
                # the one with the longest front that may be used is cut; what bears no loss comes first in a piece
                usable = np.minimum(tokens, needs[:, 0] - needs[:, 1] + loss)
                if usable.max() < 1:
                    break
                whole = self.picked(int(usable.argmax()))
                piece = whole.take(tokens, loss)
                self.pooled(whole)
            row.append(piece)
            tokens, segments, loss = tokens - len(piece), segments - 1, loss - piece.loss()
        used = max_tokens - tokens
        over = used - (1 << (used.bit_length() - 1)) if tokens else 0
        while over:  # back to a power of two
            if len(row[-1]) <= over:
                over -= len(row[-1])
                self.pooled(row.pop())
            else:
                self.pooled(row[-1].give_back(over))
                over = 0
        return row


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("loss_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def pack(examples: DataFrame, max_tokens: int = 1024, max_segments: int = 64, max_loss: int | None = None, pool: int = 512) -> DataFrame:
    """Place examples (doc_id, ids, loss_start) in sequences; a row per piece.

    ids are little-endian 32-bit integers; loss_start (null: 0) is the first token
    that bears loss, as the answer's in instruction data. Returns doc_id, start,
    length, ids of the piece, doc_tokens, loss_tokens, sequence_id, offset. Every
    token lies in exactly one piece; a sequence has at most max_tokens tokens,
    max_segments pieces and max_loss loss-bearing tokens, and, unless full, a power of two tokens.

    Examples of no tokens (or null ids) have no piece. Null and repeated ids are
    carried along: rows are packed one by one; of equal dot products the piece that
    stands first in the pool is taken. A very long example is cut as it comes, so the
    pool stays bounded. Other columns are ignored. An empty table gives an empty table.
    Sequence ids hold the number of the input partition, so a task that is run again
    gives the same rows.
    """
    limit = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, limit) < 1:
        raise ValueError("limits must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(max_tokens, max_segments, limit, pool)
        first = TaskContext.get().partitionId() << 40
        made, rows, size = 0, [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=PIECES.names)

        def sequences() -> Iterator[list[Piece]]:
            for batch in batches:
                for doc_id, ids, start in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "loss_start")), strict=True):
                    row = np.frombuffer(ids or b"", dtype="<u4")
                    yield from packer.add(Piece(doc_id, row, 0, len(row), start or 0))
            yield from packer.flush()

        for row in sequences():
            offset = 0
            for p in row:
                rows.append((p.doc_id, p.start, len(p), p.ids[p.start : p.stop].tobytes(), len(p.ids), p.loss(), first + made, offset))
                offset += len(p)
            made, size = made + 1, size + offset
            if size > 500_000:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return examples.select("doc_id", "ids", "loss_start").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, ranks_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                   prompt: Column | None = None, **limits: int) -> DataFrame:
    """Tokenize and pack documents; null texts count as empty, whose only token is end_id.

    Very long texts are tokenized whole, one at a time, and cut into many pieces.
    """
    return pack(tokenized(docs, ranks_path, end_id, id_col, text_col, prompt), **limits)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed under three limits: 1024 tokens, 64 segments, 992 tokens that bear loss; a document's first line bears none."""
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), prompt=first_line(F.col("text")), max_loss=MAX_LOSS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")
