"""Token counts: edit-aware counting with a segment tree of pre-tokens per document.

Byte-level BPE never merges across pre-tokens, so a document's token count is a sum
over its pre-tokens. They are kept as the leaves of a segment tree whose nodes hold
the characters and tokens below them. An edit replaces a span of characters: the
walk down finds the touched leaves, the text from a little before them is cut into
pre-tokens again until a cut falls together with an old one that the edit did not
touch, only those pre-tokens are encoded, and the sums above them are updated.

Trees can be kept: build_trees() makes a table with a row per document, edit_trees()
applies edits to such a table and gives the next one, and cuts and encodes nothing but
what edits touch. The special token's text counts as that token, as in packing.

A document's edits are applied in order; documents are independent of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, table
from .packing import END_OF_TEXT, PRE_TOKENS, byte_bpe

SPLIT = regex.compile(PRE_TOKENS)
STOP = regex.escape(END_OF_TEXT)
#: The same, for texts that hold the special token: it is cut out first, and what is before it ends there.
SPLIT_SPECIAL = regex.compile(
    STOP + "|" + PRE_TOKENS.replace(r"[^\s\p{L}\p{N}]+", rf"(?:(?!{STOP})[^\s\p{{L}}\p{{N}}])+").replace(r"(?!\S)", rf"(?!(?!{STOP})\S)"))
#: A cut depends on so many characters behind it at most.
LOOK = len(END_OF_TEXT)
MAX_WORDS = 200_000


class Counts(dict):
    """pre-token -> tokens; bounded."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        n = self[piece] = 1 if piece == END_OF_TEXT else len(self.encode(piece))
        return n


class SegmentTree:
    """Pre-tokens of a text as leaves; nodes sum characters and tokens.

    A leaf holds up to `width` pre-tokens of the first text; edits may make it longer,
    and the tree is laid out anew when one has grown eightfold. Node i has the
    children 2i and 2i + 1; the leaves are the last `size` nodes.
    """

    def __init__(self, text: str, counts: Counts, width: int = 16):
        self.counts, self.width = counts, width
        self.encoded = 0  # pre-tokens that edits have had encoded again
        self.lay_out((SPLIT_SPECIAL if END_OF_TEXT in text else SPLIT).findall(text))

    @classmethod
    def kept(cls, text: str, cuts: list[list[int]], tokens: list[int], counts: Counts, width: int = 16) -> SegmentTree:
        """The tree whose leaves have pre-tokens of those lengths and so many tokens: nothing is cut or encoded."""
        tree, at = cls.__new__(cls), 0
        tree.counts, tree.width, tree.encoded, tree.leaves = counts, width, 0, []
        for lengths in cuts:
            row = []
            for n in lengths:
                row.append(text[at : at + n])
                at += n
            tree.leaves.append(row)
        tree.sum_up(tokens)
        return tree

    def lay_out(self, pieces: list[str]) -> None:
        w = self.width
        self.leaves = [pieces[i : i + w] for i in range(0, len(pieces), w)] or [[]]
        self.sum_up(None)

    def sum_up(self, tokens: list[int] | None) -> None:
        """All sums from the leaves; tokens of each leaf, if they are known."""
        self.size = 1
        while self.size < len(self.leaves):
            self.size *= 2
        self.chars, self.tokens, self.pieces = ([0] * (2 * self.size) for _ in range(3))
        for k, row in enumerate(self.leaves):
            if tokens is None:
                self.measure(k)
            else:
                i = self.size + k
                self.chars[i], self.tokens[i], self.pieces[i] = sum(map(len, row)), tokens[k], len(row)
        for i in range(self.size - 1, 0, -1):
            self.total(i)

    def measure(self, leaf: int) -> None:
        i, row = self.size + leaf, self.leaves[leaf]
        self.chars[i], self.tokens[i], self.pieces[i] = sum(map(len, row)), sum(map(self.counts.__getitem__, row)), len(row)

    def total(self, i: int) -> None:
        for sums in (self.chars, self.tokens, self.pieces):
            sums[i] = sums[2 * i] + sums[2 * i + 1]

    def leaf_at(self, at: int) -> tuple[int, int]:
        """(leaf that holds character `at`, characters before that leaf); past the end: the last leaf."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at - before >= self.chars[i] and i - self.size + 1 < len(self.leaves) and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return min(i - self.size, len(self.leaves) - 1), before

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pieces(self) -> int:
        return self.pieces[1]

    def text(self) -> str:
        return "".join("".join(row) for row in self.leaves)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters start..stop (clipped to the text) by new."""
        length = self.chars[1]
        start = min(max(start, 0), length)
        stop = min(max(stop, start), length)
        # context before: a cut may depend on what follows it (white space looks one character ahead, the special token's text is longer)
        near = start - LOOK
        first, before = self.leaf_at(max(near - 1, 0))
        if first and before >= near - 1:
            first -= 1
            while first and not self.leaves[first]:
                first -= 1
            before -= self.chars[self.size + first]
        row: list[str] = []
        last, have = first - 1, before
        while have < stop and last + 1 < len(self.leaves):
            last += 1
            row += self.leaves[last]
            have += self.chars[self.size + last]
        # whole pre-tokens ahead of the touched ones stay
        keep, at = 0, before
        while keep < len(row) and at + len(row[keep]) < near:
            at += len(row[keep])
            keep += 1
        if keep:
            keep -= 1
            at -= len(row[keep])
        old = "".join(row[keep:])
        while True:
            fresh = old[: start - at] + new + old[stop - at :]
            # a little more tells whether the last cut holds with what follows
            after, tail, far = last, [], 0
            while far <= LOOK and after + 1 < len(self.leaves):
                after += 1
                tail += self.leaves[after]
                far += self.chars[self.size + after]
            settled = len(fresh) - (at + len(old) - stop)  # where the edit ends
            cuts = self.cut(fresh, "".join(tail), settled, row[keep:], stop - at)
            if cuts is not None or not tail:
                break
            row += tail
            old += "".join(tail)
            last = after
        again, rest = cuts if cuts is not None else (SPLIT_SPECIAL.findall(fresh), [])
        self.encoded += len(again)
        self.put(first, max(last, first), row[:keep] + again + rest)

    @staticmethod
    def cut(fresh: str, ahead: str, settled: int, old: list[str], old_stop: int) -> tuple[list[str], list[str]] | None:
        """(new pre-tokens, old ones that go on after them), or None if they do not meet within fresh."""
        # old cuts past the edit, as places in the new text
        moved, place = {}, 0
        shift = settled - old_stop
        for k, piece in enumerate(old):
            if place >= old_stop:
                moved[place + shift] = k
            place += len(piece)
        found: list[str] = []
        end = 0
        for m in SPLIT_SPECIAL.finditer(fresh + ahead):
            # at a common cut with a letter or digit behind the edit on its left, both go on alike
            if m.start() > settled and m.start() in moved:
                return found, old[moved[m.start()] :]
            if m.start() >= len(fresh):
                return (found, []) if end == len(fresh) and end > settled else None
            found.append(m.group())
            end = m.end()
        return (found, []) if not ahead and end == len(fresh) else None

    def put(self, first: int, last: int, row: list[str]) -> None:
        """Make row the content of leaves first..last."""
        if len(row) > 8 * self.width * (last - first + 1):
            every = [p for leaf in self.leaves[:first] for p in leaf] + row + [p for leaf in self.leaves[last + 1 :] for p in leaf]
            self.lay_out(every)
            return
        n = last - first + 1
        for k in range(n):
            self.leaves[first + k] = row[len(row) * k // n : len(row) * (k + 1) // n]
            self.measure(first + k)
        low, high = self.size + first, self.size + last
        while low > 1:
            low, high = low // 2, high // 2
            for i in range(low, high + 1):
                self.total(i)


def count_edited(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Token counts of documents before and after their edits.

    docs has an array column of edits (start, stop, new): replace the characters start
    (from 0) to before stop, counted in the text as the edits before it have left it.
    Returns doc_id, n_tokens (before), n_pre_tokens, n_edits, n_reencoded (pre-tokens
    that edits had encoded again), n_tokens_after, edited (the text after).

    Null texts count as empty, null edits as none, a null replacement as empty; places
    beyond the text are its end. Rows are independent; null and repeated ids are carried
    along. Very long texts are counted whole, one at a time; a pre-token of any length
    (white space without end, a single letter repeated) is one leaf entry. Other columns
    are ignored. An empty table gives an empty table.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(edits_col).alias("edits"))
    schema = "doc_id long, n_tokens long, n_pre_tokens long, n_edits long, n_reencoded long, n_tokens_after long, edited string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a pre-token is merged as it is, without the pattern that has made it
        counts = Counts(byte_bpe(ranks_path)._encode_single_piece)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text, edits in zip(part.column("text").to_pylist(), part.column("edits").to_pylist(), strict=True):
                    tree = SegmentTree(text, counts)
                    before, pieces = tree.n_tokens, tree.n_pieces
                    for e in edits or []:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
                    rows.append((before, pieces, len(edits or []), tree.encoded, tree.n_tokens, tree.text()))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())],
                    names=["doc_id", "n_tokens", "n_pre_tokens", "n_edits", "n_reencoded", "n_tokens_after", "edited"])

    return own.mapInArrow(run, schema)


TREES = "doc_id long, text string, cuts array<array<int>>, tokens array<int>, n_tokens long"


def _trees(rows: DataFrame, schema: str, step: Callable[[dict, Counts], tuple[SegmentTree, tuple]], ranks_path: str) -> DataFrame:
    """A row of TREES for each row, and what step returns besides the tree."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(byte_bpe(ranks_path)._encode_single_piece)
        types = [pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32())] + [pa.int64()] * (len(names) - 4)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                made = []
                for row in batch.slice(at, 64).to_pylist():
                    tree, more = step(row, counts)
                    made.append((row["doc_id"], tree.text(), [list(map(len, leaf)) for leaf in tree.leaves],
                                 tree.tokens[tree.size : tree.size + len(tree.leaves)], tree.n_tokens, *more))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def build_trees(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The segment tree of each document as a row (doc_id, text, cuts, tokens, n_tokens), to be stored.

    cuts has the lengths of each leaf's pre-tokens, tokens each leaf's tokens; the sums
    above are made from those. Null texts count as empty; null and repeated ids are
    carried along; other columns are ignored; an empty table gives an empty table.
    """
    return _trees(id_and_text(docs, id_col, text_col), TREES, lambda row, counts: (SegmentTree(row["text"], counts), ()), ranks_path)


def edit_trees(trees: DataFrame, edits: DataFrame, ranks_path: str) -> DataFrame:
    """The table of trees after edits, with n_reencoded: the pre-tokens that were cut and encoded again.

    trees comes from build_trees() or from this; edits is (doc_id, edits), edits being an
    array of (start, stop, new) as in count_edited(). A document without edits stays as
    it is, edits of an unknown or null doc_id go. An id with several rows of edits has
    them in order of their first edit's place; rows that repeat an id are all edited alike.
    """
    asked = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("edits").cast("array<struct<start: int, stop: int, new: string>>").alias("edits"))
    asked = asked.dropna().groupBy("doc_id").agg(F.flatten(F.array_sort(F.collect_list("edits"))).alias("edits"))
    names = [f.split()[0] for f in TREES.replace("array<array", "array").split(", ")]

    def step(row: dict, counts: Counts) -> tuple[SegmentTree, tuple]:
        tree = SegmentTree.kept(row["text"], row["cuts"], row["tokens"], counts)
        for e in row["edits"]:
            tree.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
        return tree, (tree.encoded,)

    own = trees.select(*names).join(asked, "doc_id", "left")
    changed = _trees(own.filter("edits is not null"), f"{TREES}, n_reencoded long", step, ranks_path)
    return changed.unionByName(own.filter("edits is null").select(*names, F.lit(0).cast("long").alias("n_reencoded")))


def derived_edits() -> F.Column:
    """Edits made from a text itself: one for every 4,000 characters and one more.

    By turns a stretch is removed, replaced by the text's first 40 characters, or gets
    its last 20 inserted; the places come from hashes of the text and the edit's number.
    """
    length = F.char_length("text")

    def edit(i: F.Column) -> F.Column:
        start = F.pmod(F.xxhash64(F.substring("text", 1, 200), length, i), length + 1).cast("int")
        kind = i % 3
        stop = start + F.when(kind == 2, 0).otherwise(F.pmod(F.xxhash64(i, length), F.lit(60)).cast("int"))
        new = F.when(kind == 0, "").when(kind == 1, F.substring("text", 1, 40)).otherwise(F.right("text", F.lit(20)))
        return F.struct(start.alias("start"), stop.alias("stop"), new.alias("new"))

    return F.transform(F.sequence(F.lit(0), F.floor(length / 4000).cast("int")), edit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = count_edited(docs.withColumn("edits", derived_edits()), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_tokens", "n_pre_tokens", "n_edits", "n_reencoded", "n_tokens_after", F.sha2("edited", 256).alias("edited_sha256"))
