r"""Alignment of two tokenizers over the bytes of each text, and how often their tokens meet over the corpus.

A is a tokenizers file of byte-level BPE, B a sentencepiece model. B adds a space in front, A reads the text with one.
Each byte gets a label: no token ends there, A's does, B's does, or both. A regular expression scans the labels of a
text for spans up to each both-label; a span's labels count the tokens of each side, which are a group. Every labelled
byte ends the overlap of one token of A and one of B, a link.

1. A map encodes the documents, aligns them and keeps each one's distinct linked pairs with their occurrences (a table in
   the shared folder, so nothing is encoded twice).
2. Pairs are counted once a document: in the tasks first, then by the pair.
3. The commonest pairs (``HOT_PAIRS`` at most, those above a power of two that is found from the counts) go to the
   tasks, which look most links up in place; links of all other pairs meet their counts in a join by the pair. A pair in
   all documents is always of the first kind, so no key of the join is hot.

Texts go to the libraries in pieces that they read apart anyway, each distinct piece once: A's by its pattern, B's at
spaces, where the vocabulary has no piece that goes on after a space. Characters that versions of Unicode class in
different ways, and vocabularies with such pieces, are encoded as whole texts.

Defined results: texts that are null or empty, or that one side's tokens don't give back byte for byte, have no tokens:
zeros and an empty groups_sha256. Special tokens' strings are plain text. Repeated rows count as documents each and get
equal results; a null doc_id is carried; of A's links several may be the commonest; texts of any length are aligned
whole; an empty table gives an empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordspans as ws
from .tables import Scratch

HOT_PAIRS = 1_000_000
#: Distinct pairs that a task counts before it passes the counts on.
KEEP_PAIRS = 2_000_000
#: Pieces that a worker keeps, over its tasks, and their longest length.
KEEP = 300_000
LONG = 64
SLAB_CHARS = 1 << 18

# The pattern of byte-level BPE, the same over ASCII, and characters whose class all versions of Unicode agree on.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
AGREED = re.compile(r"[\t\n\r -~ -ɏΑ-ΡΣ-ωЀ-ҁҊ-ӿ‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣\U0001f300-\U0001f64f]*")

SPACED = re.compile(r" +[^ ]+(?: +\Z)?| +\Z")
LABELS = np.frombuffer(b"-ABX", dtype=np.uint8)
SPAN = re.compile(rb"[^X]*X")
_SIDES: dict[tuple[str, str], Sides] = {}

DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
KEPT_FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts by distinct pieces, and the bytes of its tokens."""

    def __init__(self, tokens: list[bytes], encode: Callable[[list[str]], list[list[int]]], split: Callable[[str], list[str]] | None, mark: str) -> None:
        self.tokens, self.library, self.split = tokens, encode, split
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        #: An id as it is written inside its group, and at the end of its side of a group.
        self.inside, self.last = (np.array([f"{i}{c}" for i in range(len(tokens))], dtype=object) for c in f",{mark}")
        self.kept: dict[str, bytes | None] = {}

    def ids(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of each piece as bytes, or None where its tokens aren't its bytes."""
        if not pieces:
            return []
        found = self.library(pieces)
        ids = np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32)
        raws = [p.encode() for p in pieces]
        ends = np.cumsum(list(map(len, found)))
        read = np.concatenate([[0], np.cumsum(self.sizes[ids])])[ends]
        same = b"".join(map(self.tokens.__getitem__, ids.tolist())) == b"".join(raws) and np.array_equal(read, np.cumsum(list(map(len, raws))))
        flat, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        out: list[bytes | None] = [flat[x:y] for x, y in itertools.pairwise(cuts)]
        return out if same else [o if b"".join(map(self.tokens.__getitem__, i)) == r else None for o, i, r in zip(out, found, raws, strict=True)]

    def encode(self, texts: list[str], agreed: list[bool]) -> list[np.ndarray | None]:
        split = [self.split(t) if self.split and ok else [t] for t, ok in zip(texts, agreed, strict=True)]
        new = list(set().union(*split).difference(self.kept))
        if len(self.kept) + len(new) > KEEP:
            self.kept.clear()
            new = list(set().union(*split))
        self.kept.update(zip(new, self.ids(new), strict=True))
        out = []
        for pieces in split:
            try:
                out.append(np.frombuffer(b"".join(map(self.kept.__getitem__, pieces)), dtype=np.uint32))
            except TypeError:
                out.append(None)
        if len(self.kept) > KEEP:
            self.kept.clear()
        for piece in new:
            if len(piece) > LONG:
                self.kept.pop(piece, None)
        return out


class Sides:
    """Both tokenizers. Texts come with a space in front."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        import sentencepiece
        import tokenizers

        a = tokenizers.Tokenizer.from_file(path_a)
        a.encode_special_tokens = True
        back = byte_of_character()
        entries = [a.id_to_token(i) or "" for i in range(a.get_vocab_size())]
        tokens = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in entries]
        self.a = Side(tokens, lambda texts: [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)], lambda t: (PLAIN if t.isascii() else PATTERN).findall(t), "|")
        b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        tokens = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        apart = not any(re.search("[^\u2581]\u2581", p) for p in pieces)
        self.b = Side(tokens, lambda texts: b.encode([t[1:] for t in texts], num_threads=1), SPACED.findall if apart else None, ";")
        # A pair is one number; the smaller kind where it fits.
        self.kind = np.dtype(np.uint32 if len(entries) * len(pieces) < 1 << 32 else np.uint64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        spaced = [" " + t for t in texts]
        agreed = [AGREED.fullmatch(t) is not None for t in texts]
        both = zip(texts, self.a.encode(spaced, agreed), self.b.encode(spaced, agreed), strict=True)
        return [None if not t or a is None or b is None else (a, b) for t, a, b in both]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(self.kind) * self.kind.type(len(self.b.sizes)) + b.astype(self.kind)

    def written(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> str:
        """a1,a2|b1;a3|b2,b3: of_a, of_b: tokens of each group."""
        end_a, end_b = np.cumsum(of_a), np.cumsum(of_b)
        at_a = np.arange(len(a)) + np.repeat(end_b - of_b, of_a)
        at_b = np.arange(len(b)) + np.repeat(end_a, of_b)
        words = np.empty(len(a) + len(b), dtype=object)
        words[at_a] = self.a.inside[a]
        words[at_b] = self.b.inside[b]
        words[at_a[end_a - 1]] = self.a.last[a[end_a - 1]]
        words[at_b[end_b - 1]] = self.b.last[b[end_b - 1]]
        return "".join(words.tolist())[:-1]


def sides(path_a: str, path_b: str) -> Sides:
    """One per worker: the files take a second to read."""
    if (path_a, path_b) not in _SIDES:
        _SIDES[path_a, path_b] = Sides(path_a, path_b)
    return _SIDES[path_a, path_b]


def aligned(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of A and of B in each group, token of A and of B of each link) from the ends of tokens, of which the last are equal."""
    labels = np.zeros(int(end_a[-1]), dtype=np.uint8)
    labels[end_a - 1] = 1
    labels[end_b - 1] += 2
    spans = np.cumsum(list(map(len, SPAN.findall(LABELS[labels].tobytes()))))
    starts = np.concatenate([[0], spans[:-1]])
    is_a, is_b = labels & 1, labels >> 1
    ends = np.flatnonzero(labels)
    link_a, link_b = is_a[ends].astype(np.int64), is_b[ends].astype(np.int64)
    return np.add.reduceat(is_a, starts, dtype=np.int64), np.add.reduceat(is_b, starts, dtype=np.int64), np.cumsum(link_a) - link_a, np.cumsum(link_b) - link_b


def _document(s: Sides, tokens: tuple[np.ndarray, np.ndarray] | None) -> tuple:
    if tokens is None:
        return 0, 0, 0, 0, "", b"", b""
    a, b = tokens
    of_a, of_b, link_a, link_b = aligned(np.cumsum(s.a.sizes[a]), np.cumsum(s.b.sizes[b]))
    pairs, times = np.unique(s.pair(a[link_a], b[link_b]), return_counts=True)
    digest = hashlib.sha256(s.written(a, b, of_a, of_b).encode()).hexdigest()
    return len(a), len(b), len(of_a), len(link_a), digest, pairs.tobytes(), times.astype(np.uint32).tobytes()


def _slabs(texts: list[str | None]) -> Iterator[list[str]]:
    slab, size = [], 0
    for t in texts:
        slab.append(t or "")
        size += len(t or "")
        if size >= SLAB_CHARS:
            yield slab
            slab, size = [], 0
    if slab:
        yield slab


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct linked pairs with their occurrences (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sides(path_a, path_b)
        for batch in batches:
            row = 0
            for slab in _slabs(batch.column("text").to_pylist()):
                columns = list(zip(*(_document(s, tokens) for tokens in s.encode(slab)), strict=True))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(slab)), *arrays], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                row += len(slab)

    return ws.mapped(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {DOCUMENT}")


def _packed(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of packed numbers, and where each row's end."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    return data.view(kind), (offsets[1:] - offsets[0]) // kind.itemsize


def _counted(documents: DataFrame, kind: np.dtype) -> DataFrame:
    """pair, n: documents that hold it linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            gathered.append(_packed(batch.column("pairs"), kind)[0].copy())
            size += len(gathered[-1])
            if size >= KEEP_PAIRS:
                yield from counts(gathered)
                gathered, size = [], 0
        yield from counts(gathered)

    def counts(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if gathered:
            pairs, n = np.unique(np.concatenate(gathered), return_counts=True)
            for k in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + (1 << 16)].astype(np.int64)), pa.array(n[k : k + (1 << 16)].astype(np.int64))], names=["pair", "n"])

    return ws.mapped(documents.select("pairs"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _least_hot(pairs: DataFrame) -> int:
    """The least power of two such that HOT_PAIRS pairs at most have that count."""
    sizes = pairs.groupBy(F.floor(F.log2("n") + 1e-9).alias("e")).agg(F.count("*").alias("m")).collect()
    found = 0
    for e, m in sorted(((r["e"], r["m"]) for r in sizes), reverse=True):
        found += m
        if found > HOT_PAIRS:
            return 1 << (e + 1)
    return 1


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its A token's commonest), count_sum, groups_sha256."""
    s = sides(path_a, path_b)
    kind, width = s.kind, len(s.b.sizes)
    scratch = Scratch()
    documents = scratch.write(align_documents(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    pairs = scratch.write(_counted(documents, kind))
    best = pairs.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n").alias("most"))  # a row for each id of A
    pairs = pairs.join(F.broadcast(best), F.expr(f"pair div {width}") == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    least = _least_hot(pairs)
    hot = ws.collected(pairs.where(F.col("n") >= least))
    by = np.argsort(hot["pair"])
    sent = docs.sparkSession.sparkContext.broadcast((hot["pair"][by].astype(kind), hot["n"][by].astype(np.int64), hot["best"][by].astype(np.int64)))

    def places(column: pa.Array, times: pa.Array) -> tuple[np.ndarray, ...]:
        found, ends = _packed(column, kind)
        known = sent.value[0]
        at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
        here = known[at] == found if len(known) else np.zeros(len(found), dtype=bool)
        return found, ends, at, here, _packed(times, np.dtype(np.uint32))[0].astype(np.int64)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ends, at, here, times = places(batch.column("pairs"), batch.column("times"))
            sums = []
            for values in sent.value[:0:-1]:
                each = np.zeros(len(times) + 1, dtype=np.int64)
                each[1:][here] = values[at[here]] * times[here]
                each = np.cumsum(each)
                sums.append(pa.array(np.diff(each[np.concatenate([[0], ends])])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", *KEPT_FIELDS, "groups_sha256")), *sums], names=["row", *KEPT_FIELDS, "groups_sha256", "n_best", "count_sum"])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends, _, here, times = places(batch.column("pairs"), batch.column("times"))
            rows = np.repeat(batch.column("row").to_numpy(), np.diff(ends, prepend=0))[~here]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(found[~here].astype(np.int64)), pa.array(times[~here])], names=["row", "pair", "times"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.schema if f.name in (*KEPT_FIELDS, "groups_sha256"))
    here = ws.mapped(documents.select("row", *KEPT_FIELDS, "groups_sha256", "pairs", "times"), summed, f"row long, {kinds}, n_best long, count_sum long")
    rest = ws.mapped(documents.select("row", "pairs", "times"), apart, "row long, pair long, times long").join(pairs.where(F.col("n") < least), "pair")
    rest = rest.groupBy("row").agg(F.sum(F.col("best").cast("long") * F.col("times")).alias("best_apart"), F.sum(F.col("n") * F.col("times")).alias("sum_apart"))
    out = here.join(rest, "row", "left")
    return out.select(*KEPT_FIELDS, (F.col("n_best") + F.coalesce("best_apart", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("sum_apart", F.lit(0))).alias("count_sum"), "groups_sha256")
