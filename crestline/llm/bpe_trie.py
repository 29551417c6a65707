"""BPE encoding and decoding by depth-first traversal of a trie of distinct words.

The BPE tokens of a word, cut after any of them, are the BPE tokens of that
prefix. So a prefix is described by its last token alone: the one vocabulary
entry t that ends the prefix and may stand after the last token of what precedes
t. Words with a common prefix share these states. Each batch of documents puts
its distinct new words into a trie, kept as the sorted list of words with what
neighbours have in common; the walk keeps the states of the current path, goes
back to the branching point, and only works on the bytes after it.

Whether token b may follow token a is decided on their merge trees: no merge of a
right-edge part of a with a left-edge part of b may come before the merge that
uses up either part. Answers are kept for each pair.

Documents need no shuffle: every task encodes what it reads, with a bounded
memory of words.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import id_and_text, table

NEVER = 1 << 60
CHUNK_CHARS = 1_000_000
MAX_WORDS = 200_000
#: The first code point that Unicode versions may see differently, and all later ones.
HIGH = regex.compile("[\u0558-\U0010ffff]")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=1)
def newer_letters() -> str:
    """Letters and digits of later Unicode versions than Python's."""
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x40000)]))
    return "".join(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")


class TrieEncoder:
    """Encodes words (byte strings) with a BPE vocabulary whose last symbol carries an end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.names: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.specials.items()}
        self.to_byte = to_byte = byte_alphabet()
        self.library = Tokenizer.from_file(path)
        # (bytes, ends a word) of each entry, inner entries and ending ones apart
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.symbols: dict[int, list[int]] = {}
        for name, i in model["vocab"].items():
            ending = name.endswith(self.end) and name != self.end
            body = name[: len(name) - len(self.end)] if ending else name
            if all(c in to_byte for c in body):
                (self.final if ending else self.inner)[bytes(to_byte[c] for c in body)] = i
        for entries, last in ((self.inner, self.inner), (self.final, self.final)):
            for raw, i in entries.items():
                self.symbols[i] = [self.inner[raw[k : k + 1]] for k in range(len(raw) - 1)] + [last[raw[-1:]]]
        self.size = {i: len(row) for i, row in self.symbols.items()}
        ids = model["vocab"]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.trees: dict[int, tuple[int, int, int] | None] = {}
        self.edges: dict[tuple[int, bool], list[tuple[int, int, int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.strange = regex.compile("[" + newer_letters() + "]")
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")

    # merge trees -----------------------------------------------------------

    def tree(self, token: int) -> tuple[int, int, int] | None:
        """(left part, right part, rank) of the merge that makes a token; (-1, -1, -1) of a symbol; None if merging never ends in it."""
        if token not in self.trees:
            row, last = list(self.symbols[token]), (-1, -1, -1)
            while len(row) > 1:
                found = min(((self.merges[p][0], k) for k, p in enumerate(zip(row, row[1:], strict=False)) if p in self.merges), default=None)
                if found is None:
                    break
                k = found[1]
                last = (row[k], row[k + 1], found[0])
                row[k : k + 2] = [self.merges[row[k], row[k + 1]][1]]
            self.trees[token] = last if row == [token] else None
        return self.trees[token]

    def edge(self, token: int, right: bool) -> list[tuple[int, int, int]]:
        """(part, rank that makes it, rank that uses it up) of the parts on one edge of a token's tree."""
        if (token, right) not in self.edges:
            found, part, used = [], token, NEVER
            while part >= 0 and (t := self.tree(part)) is not None:
                found.append((part, t[2], used))
                part, used = t[1] if right else t[0], t[2]
            self.edges[token, right] = found
        return self.edges[token, right]

    def may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        if key not in self.pairs:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[key] = self.tree(b) is not None and self._may_follow(a, b)
        return self.pairs[key]

    def _may_follow(self, a: int, b: int) -> bool:
        for x, made_x, used_x in self.edge(a, True):
            for y, made_y, used_y in self.edge(b, False):
                if (m := self.merges.get((x, y))) is not None:
                    when = max(m[0], made_x, made_y)
                    # equal ranks go from left to right
                    if when < used_x and when <= used_y:
                        return False
        return True

    # the trie --------------------------------------------------------------

    def last_token(self, word: bytes, end: int, entries: dict[bytes, int], last: list[int]) -> int:
        """The last token of word[:end], from the states of the shorter prefixes."""
        pairs = self.pairs
        for start in range(max(0, end - self.longest), end):
            t = entries.get(word[start:end])
            if t is not None:
                if not start:
                    if self.tree(t) is not None:
                        return t
                elif (ok := pairs.get((last[start], t))) or ok is None and self.may_follow(last[start], t):
                    return t
        raise ValueError(f"no token ends {word[:end]!r}")

    def encode_words(self, words: list[bytes]) -> Iterator[list[int]]:
        """Token ids of each of the distinct, sorted words: a walk through their trie."""
        path, last, inner, final, size = b"", [-1], self.inner, self.final, self.size
        for word in words:
            common = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                common += 1
            del last[common + 1 :]
            path = word
            for end in range(len(last), len(word)):
                last.append(self.last_token(word, end, inner, last))
            ids = [self.last_token(word, len(word), final, last)]
            end = len(word) - size[ids[0]]
            while end:
                ids.append(last[end])
                end -= size[last[end]]
            yield ids[::-1]

    # texts -----------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """The words of a text as the vocabulary wants them, special tokens among them as they are."""
        if "<|" in text and self.special_pattern.search(text):
            found = []
            for part in self.special_pattern.split(text):
                found += [part] if part in self.specials else self.split_plain(part)
            return found
        return self.split_plain(text)

    def split_plain(self, text: str) -> list[str]:
        if not text.isascii():
            if HIGH.search(text) and self.strange.search(text):
                return self.split_by_library(text)
            # letter by letter: a sigma at the end of a word is no special case
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def split_by_library(self, text: str) -> list[str]:
        """For texts with characters younger than Python's Unicode tables: the tokenizer file's own steps."""
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.to_byte[c] for c in piece).decode() for piece, _ in pieces]

    def learn(self, rows: list[list[str]]) -> None:
        """Put what is new in rows into the memory of words."""
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        new = {w for row in rows for w in row} - self.words.keys()
        for w in new & self.specials.keys():
            self.words[w] = (self.specials[w].to_bytes(4, "little"), w.encode())
        raw = sorted((w.encode(), w) for w in new - self.specials.keys())
        for (_, w), ids in zip(raw, self.encode_words([r for r, _ in raw]), strict=True):
            self.words[w] = (b"".join(i.to_bytes(4, "little") for i in ids), " ".join(map(self.names.__getitem__, ids)).encode())

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text in UTF-8) of each text."""
        rows = [self.split(t) for t in texts]
        self.learn(rows)
        pairs = [[self.words[w] for w in row] for row in rows]
        return [(b"".join([p[0] for p in row]), b" ".join([p[1] for p in row])) for row in pairs]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def chunks(texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about so many characters; a longer text is a run of its own."""
    it = iter(texts)
    for first in it:
        run, size = [first], len(first)
        while size < chars and (more := list(islice(it, 1))):
            run += more
            size += len(more[0])
        yield run


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of each row: ids as little-endian unsigned 32-bit integers, decoded as text.

    vocabulary: path of a tokenizer file, readable on every executor. Null and empty
    texts have no ids and decode to an empty text. Rows are independent of each
    other; null and repeated ids are carried along. Very long texts and words are encoded
    whole. Of equal merges the leftmost comes first, as in the library. Other columns are
    ignored. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids = batch.column("doc_id")
            at = 0
            for part in chunks(batch.column("text").to_pylist()):
                coded = enc.encode(part)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(part)), pa.array([c[0] for c in coded], pa.binary()),
                    pa.array([c[1].decode() for c in coded], pa.string())], names=["doc_id", "ids", "decoded"])
                at += len(part)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
