r"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Every match of the pre-tokenizer's pattern is encoded by itself. Its byte positions are the leaves
of a segment tree; a leaf holds the rank of the pair that starts there (packed with the position, so
that the least value is the leftmost pair of least rank), the root the pair to merge next. A merge
takes the right neighbour out of the list of live positions and makes three point updates, each
logarithmic in the length of the piece.

Pieces of up to ``WIDE`` bytes are encoded together, one numpy row each, in classes of equal tree
size; longer ones one by one in the same tree as a flat list, so a run of a megabyte without a space
still takes n log n steps. Encoded pieces are kept in a bounded dictionary per Python worker.

A plain narrow map: no shuffle; ranks are read on each executor from the vocabulary file that the
``path`` parameter names. Defined results: null text is encoded as the empty text (0 tokens);
texts and pieces of any length are encoded whole; of pairs of equal rank the leftmost is merged first;
repeated rows are encoded one by one; an empty table gives an empty one; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import wordspans as ws

WIDE = 64
KEEP = 60_000
SLAB_CHARS = 1 << 20
_NONE = np.int64(1) << np.int64(60)
_NONE32 = np.int32((1 << 31) - 1)
_TOKENIZERS: dict[tuple[str, str], Tokenizer] = {}


class Tokenizer:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.findall = regex.compile(pattern).findall
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.kept: dict[str, bytes] = {}

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def encode_rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Encodes pieces of 2 to ``size`` bytes; size, the number of leaves, is a power of two up to WIDE."""
        n, bits = len(pieces), size.bit_length() - 1
        length = np.fromiter(map(len, pieces), dtype=np.int32, count=n)
        place = np.arange(size, dtype=np.int32)
        alive = place[None, :] < length[:, None]
        raw = np.zeros((n, size), dtype=np.uint8)
        raw[alive] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        token = self.byte_rank[raw].astype(np.int32)
        after = np.tile(place + 1, (n, 1))  # next live position; length or more: none
        before = np.tile(place - 1, (n, 1))

        def packed(left: np.ndarray, right: np.ndarray, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
            key = left.astype(np.int64) << 20 | right
            i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            return np.where(inside & (self.pair_keys[i] == key), (self.pair_ranks[i] << bits | at).astype(np.int32), _NONE32)

        tree = np.full((n, 2 * size), _NONE32, dtype=np.int32)
        tree[:, size : 2 * size - 1] = packed(token[:, :-1], token[:, 1:], np.tile(place[:-1], (n, 1)), alive[:, 1:])
        for k in range(bits - 1, -1, -1):
            w = 1 << k
            tree[:, w : 2 * w] = np.minimum(tree[:, 2 * w : 4 * w : 2], tree[:, 2 * w + 1 : 4 * w : 2])
        rows = np.flatnonzero(tree[:, 1] < _NONE32)
        trees, tokens, afters, befores, live = (x.reshape(-1) for x in (tree, token, after, before, alive))

        def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray | np.int32) -> None:
            """Point updates, from the leaf up to the root."""
            base, i = rows * (2 * size), at.astype(np.int64) + size
            trees[base + i] = value
            for _ in range(bits):
                value = np.minimum(trees[base + i], trees[base + (i ^ 1)])
                i >>= 1
                trees[base + i] = value

        def leaf(rows: np.ndarray, at: np.ndarray, right: np.ndarray) -> np.ndarray:
            inside = right < length[rows]
            base = rows * size
            return packed(tokens[base + at], tokens[base + np.where(inside, right, at)], at, inside)

        while len(rows):
            root, base = tree[rows, 1], rows * size
            at = root & np.int32(size - 1)
            gone = afters[base + at]
            right = afters[base + gone]
            tokens[base + at] = root >> bits
            live[base + gone] = False
            afters[base + at] = right
            inside = right < length[rows]
            befores[base[inside] + right[inside]] = at[inside]
            update(rows, gone, _NONE32)
            update(rows, at, leaf(rows, at, right))
            left = befores[base + at]
            has = left >= 0
            if has.any():
                r, left = rows[has], left[has]
                update(r, left, leaf(r, left, at[has]))
            rows = rows[tree[rows, 1] < _NONE32]
        ids = token[alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive.sum(axis=1)) * 4).tolist()
        return [ids[a:b] for a, b in itertools.pairwise([0, *ends])]

    def encode_long(self, piece: bytes) -> bytes:
        """The same tree for one long piece, as a flat list."""
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        bits, none = size.bit_length() - 1, int(_NONE)
        token = self.byte_rank[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs.get
        level = np.full(size, none, dtype=np.int64)
        t = np.array(token, dtype=np.int64)
        rank = self._pair(t[:-1], t[1:])
        level[: n - 1] = np.where(rank < _NONE, rank << bits | np.arange(n - 1), _NONE)
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[::2], level[1::2])
            levels.append(level)
        tree = [none, *itertools.chain.from_iterable(x.tolist() for x in reversed(levels))]

        def update(at: int, value: int) -> None:
            i = at + size
            tree[i] = value
            while i > 1:
                other = tree[i ^ 1]
                if other < value:
                    value = other
                i >>= 1
                if tree[i] == value:
                    return
                tree[i] = value

        def leaf(at: int) -> int:
            right = after[at]
            if right >= n:
                return none
            rank = get(token[at] << 20 | token[right])
            return none if rank is None else rank << bits | at

        while tree[1] < none:
            at, merged = tree[1] & (size - 1), tree[1] >> bits
            gone = after[at]
            token[at], token[gone] = merged, -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            update(gone, none)
            update(at, leaf(at))
            if before[at] >= 0:
                update(before[at], leaf(before[at]))
        return np.array([x for x in token if x >= 0], dtype="<u4").tobytes()

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids, as little-endian 32-bit integers, of each piece."""
        names = list(pieces)
        raws = list(map(str.encode, names))
        whole = [self.ranks.get(raw) for raw in raws]
        out = {name: rank.to_bytes(4, "little") for name, rank in zip(names, whole, strict=True) if rank is not None}
        left = [i for i, rank in enumerate(whole) if rank is None]
        sizes = np.fromiter((len(raws[i]) for i in left), dtype=np.int64, count=len(left))
        classes = np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
        order = np.array(left, dtype=np.int64)
        for k in np.unique(classes).tolist():
            own, size = order[classes == k].tolist(), 1 << k
            if size > WIDE:
                out.update((names[i], self.encode_long(raws[i])) for i in own)
                continue
            step = max(1, (1 << 19) // size)
            for i in range(0, len(own), step):
                some = own[i : i + step]
                out.update(zip([names[j] for j in some], self.encode_rows([raws[j] for j in some], size), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.findall(t) for t in texts]
        new = set().union(*split).difference(self.kept)
        if len(self.kept) + len(new) > KEEP:
            self.kept.clear()
            new = set().union(*split)
        self.kept.update(self.encode_pieces(new))
        ids = [b"".join(map(self.kept.__getitem__, pieces)) for pieces in split]
        if len(self.kept) > KEEP:
            self.kept.clear()
        for piece in [p for p in new if len(p) > WIDE]:
            self.kept.pop(piece, None)
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One per worker, as compiling the pair table takes a second."""
    if (path, pattern) not in _TOKENIZERS:
        _TOKENIZERS[path, pattern] = Tokenizer(path, pattern)
    return _TOKENIZERS[path, pattern]


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


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, ids: the encoded document as array<int>."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        try:
            yield from encoded(t, batches)
        finally:
            t.kept.clear()  # workers outlive their tasks

    def encoded(t: Tokenizer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for slab in _slabs(batch.column("text").to_pylist()):
                codes = t.encode(slab)
                columns = [
                    batch.column("doc_id").slice(row, len(slab)),
                    pa.array([len(c) // 4 for c in codes], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in codes], pa.string()),
                    pa.array([hashlib.sha256(t.decode(c)).hexdigest() for c in codes], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    ends = np.cumsum([0, *(len(c) // 4 for c in codes)])
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(codes), dtype="<i4"))))
                    names.append("ids")
                row += len(slab)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return ws.mapped(docs.select("doc_id", "text"), run, schema)
