r"""Token counts from a tokenizer compiled to a finite-state transducer.

The tokenizer is a BPE with word ends over byte symbols; words come from the file's pattern. Its
merges are compiled, transition by transition as texts need them, to a deterministic transducer:

* A state is the tail of the word since the last *settled* boundary, one that every continuation
  keeps. For a prefix x of a word, a token that continues it starts at some s where x[s:] begins a
  token, and all before s is then the encoding of x[:s] alone. So the boundaries that the encodings
  of x[:s] have in common, for every such s, are settled.
* The transition for a byte carries the number of tokens it settles; the one for the end of the word
  carries the tokens of the tail with its last symbol in word-end form, and leads back to the start.

Texts become one stream of bytes with an end symbol after each word, cut into chunks of ``CHUNK``
symbols that numpy runs side by side. A chunk's state map is constant after its first end symbol (or,
without any, the walk of the whole chunk); the maps are composed by a segmented prefix scan, which
gives every chunk its entry state, and the heads are then run from there. A document's count is the
difference of the prefix sums of emitted counts at its ends.

One narrow map, no shuffle; each worker keeps a transducer of at most ``STATES`` states, and starts
afresh beyond that. Defined results: a null text is empty; texts of any length are counted whole; repeated rows are counted one by one;
an empty table gives an empty one; further columns are ignored, whatever their names. Special tokens' strings in a text count one token each, as the file
says; nothing is added, cut or padded.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordspans as ws

CHUNK = 256
STATES = 120_000
_BITS = 18
_NEVER = 1 << 60
SLAB_CHARS = 1 << 20
LIMIT = 2048
END = 255  # no byte of UTF-8
_COMPILED: dict[str, Transducer] = {}


def byte_symbols() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


def normaliser(spec: dict | None) -> Callable[[str], str]:
    """The file's normaliser as a function."""
    kind = spec["type"] if spec else None
    if kind is None:
        return lambda text: text
    if kind == "Sequence":
        steps = [normaliser(x) for x in spec["normalizers"]]
        return lambda text: functools.reduce(lambda t, f: f(t), steps, text)
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return functools.partial(unicodedata.normalize, kind)
    if kind == "Lowercase":
        # Character by character: no final sigma.
        return lambda text: text.replace("Σ", "σ").lower()
    if kind == "Replace":
        pattern = regex.compile(spec["pattern"]["Regex"] if "Regex" in spec["pattern"] else regex.escape(spec["pattern"]["String"]))
        return lambda text: pattern.sub(lambda _: spec["content"], text)
    raise ValueError(f"normaliser {kind} isn't supported")


class Transducer:
    """Lazily compiled transducer of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        symbol = byte_symbols()
        back = {c: b for b, c in symbol.items()}

        def parsed(token: str) -> tuple[bytes, bool]:
            last = token.endswith(suffix) and len(token) > len(suffix)
            return bytes(back[c] for c in (token[: -len(suffix)] if last else token)), last

        self.symbols: dict[tuple[bytes, bool], int] = {(bytes([b]), last): b << 1 | last for b in range(256) for last in (False, True)}
        self.widths = [1] * 512
        names = list(self.symbols)

        def symbol_id(name: tuple[bytes, bool]) -> int:
            if name not in self.symbols:
                self.symbols[name] = len(names)
                names.append(name)
                self.widths.append(len(name[0]))
            return self.symbols[name]

        #: pair of symbols -> rank of its merge and the symbol that it makes
        self.merges: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            x, y = (symbol_id(parsed(t)) for t in (merge if isinstance(merge, list) else merge.split(" ")))
            made = symbol_id((names[x][0] + names[y][0], names[y][1]))
            self.merges.setdefault(x << _BITS | y, rank << _BITS | made)
        tokens = [parsed(t) for t in model["vocab"] if all(c in back for c in t.removesuffix(suffix))]
        self.begins = {t[:k] for t, _ in tokens for k in range(1, len(t))}
        self.finals = {t for t, last in tokens if last}
        added = spec["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take part in the normalisation, or the space around them, aren't supported")
        self.added = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.normalise = normaliser(spec["normalizer"])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.findall = regex.compile(split["pattern"]["Regex"]).findall
        self.column = np.full(256, -1, dtype=np.int64)  # of the table, for each byte seen
        self.bytes: list[int] = []
        self.shift = 7
        self.reset()

    def reset(self) -> None:
        self.state_of, self.tails = {b"": 0}, [b""]
        self.encoded: dict[bytes, list[int]] = {b"": []}
        self.next = np.full((1024, 1 << self.shift), -1, dtype=np.int32)
        self.count = np.zeros((1024, 1 << self.shift), dtype=np.uint16)

    def columns_of(self, stream: np.ndarray) -> np.ndarray:
        """Table columns of the stream's bytes."""
        new = np.flatnonzero(np.bincount(stream, minlength=256).astype(bool) & (self.column < 0))
        if len(new):
            self.column[new] = np.arange(len(self.bytes), len(self.bytes) + len(new))
            self.bytes += new.tolist()
            if len(self.bytes) > 128 and self.shift == 7:
                self.shift = 8
                self.reset()
        return self.column[stream].astype(np.uint8)

    def encode(self, tail: bytes, final: bool) -> list[int]:
        """Ends of the tokens of a byte string; final: its last byte ends a word."""
        if not final and tail in self.encoded:
            return self.encoded[tail]
        parts = [b << 1 for b in tail]
        if final and parts:
            parts[-1] += 1
        get = self.merges.get
        ranks = [get(x << _BITS | y, _NEVER) for x, y in itertools.pairwise(parts)]
        while ranks and (best := min(ranks)) < _NEVER:
            at = ranks.index(best)
            parts[at : at + 2] = [best & ((1 << _BITS) - 1)]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] << _BITS | parts[at], _NEVER)
            if at < len(ranks):
                ranks[at] = get(parts[at] << _BITS | parts[at + 1], _NEVER)
        ends = list(itertools.accumulate(self.widths[p] for p in parts))
        if not final:
            self.encoded[tail] = ends
        return ends

    def step(self, tail: bytes, byte: int) -> tuple[bytes, int]:
        """(next tail, tokens settled)."""
        if byte == END:
            return b"", len(self.encode(tail, True))
        x = tail + bytes([byte])
        if x in self.begins or x in self.finals:
            return x, 0
        shared = self.encode(x, False)
        for s in range(1, len(x)):
            if s == len(x) - 1 or x[s:] in self.begins or x[s:] in self.finals:
                ends = self.encode(x[:s], False)
                n = next((i for i, (a, b) in enumerate(zip(shared, ends, strict=False)) if a != b), min(len(shared), len(ends)))
                shared = shared[:n]
            if not shared:
                return x, 0
        return x[shared[-1] :], len(shared)

    def compile(self, states: np.ndarray, columns: np.ndarray) -> None:
        """Adds the transitions that are missing."""
        for pair in np.unique(states << 8 | columns).tolist():
            s, column = pair >> 8, pair & 255
            tail, count = self.step(self.tails[s], self.bytes[column])
            to = self.state_of.get(tail)
            if to is None:
                to = self.state_of[tail] = len(self.tails)
                self.tails.append(tail)
                if to == len(self.next):
                    self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                    self.count = np.concatenate([self.count, np.zeros_like(self.count)])
            self.next[s, column], self.count[s, column] = to, count

    def run(self, chunks: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit states, counts by position) of chunks of table columns (one row each), side by side."""
        state, columns = entry.astype(np.int64), np.ascontiguousarray(chunks.T)
        out = np.zeros(columns.shape, dtype=np.uint16)
        for j in range(columns.shape[0]):
            at = state << self.shift | columns[j]
            to = self.next.reshape(-1)[at]
            if len(to) and to.min() < 0:
                missing = to < 0
                self.compile(state[missing], columns[j][missing].astype(np.int64))
                to = self.next.reshape(-1)[at]
            out[j] = self.count.reshape(-1)[at]
            state = to.astype(np.int64)
        return state, out.T

    def counts(self, stream: np.ndarray) -> np.ndarray:
        """Tokens emitted at each symbol of the stream, which starts at the beginning of a word and ends with END."""
        n = len(stream)
        padded = np.concatenate([stream, np.full(-n % CHUNK, END, dtype=np.uint8)])
        chunks, ends = self.columns_of(padded).reshape(-1, CHUNK), (padded == END).reshape(-1, CHUNK)
        end = np.uint8(self.column[END])
        resets = ends.any(axis=1)
        first = np.where(resets, ends.argmax(axis=1), CHUNK)
        head = np.arange(CHUNK)[None, :] <= first[:, None]
        # Each chunk after its first end symbol: the entry state doesn't matter there.
        leaves, out = self.run(np.where(head, end, chunks), np.zeros(len(chunks)))
        out = out.copy()
        # Prefix scan: a chunk with an end symbol resets, one without passes its walk on.
        known, entry = resets.copy(), np.zeros(len(chunks), dtype=np.int64)
        todo, width = np.arange(len(chunks)), np.where(resets, first + 1, CHUNK)
        heads = np.where(head, chunks, end)
        while len(todo):
            ready = (todo == 0) | known[todo - 1]
            now, todo = todo[ready], todo[~ready]
            entry[now[now > 0]] = leaves[now[now > 0] - 1]
            w = int(width[now].max())
            exits, counted = self.run(heads[now, :w], entry[now])
            out[now, :w] += counted
            passing = now[~resets[now]]
            leaves[passing] = exits[~resets[now]]
            known[passing] = True
        return out.reshape(-1)[:n]

    def words(self, text: str) -> tuple[list[str], int]:
        """Words of the normalised text, and the number of special tokens in it."""
        parts, specials = [text], 0
        if self.special is not None and any(t in text for t in self.added):
            parts = self.special.split(text)
            specials = len(parts) - 1
        out: list[str] = []
        for part in parts:
            out += self.findall(self.normalise(part))
        return out, specials

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.tails) > STATES:
            self.reset()
        specials, pieces = np.zeros(len(texts), dtype=np.int64), []
        for i, text in enumerate(texts):
            words, specials[i] = self.words(text)
            if words:
                words.append("")
            raw = "\0".join(words).encode() if "\0" not in text else b"\xff".join(w.encode() for w in words)
            pieces.append(raw if "\0" in text else raw.replace(b"\0", b"\xff"))
        stream = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        if not len(stream):
            return specials
        total = np.concatenate([[0], np.cumsum(self.counts(stream), dtype=np.int64)])
        return specials + np.diff(total[np.cumsum([0, *map(len, pieces)])])


def transducer(path: str) -> Transducer:
    """One per worker."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            slab: list[str] = []
            counts, size = [np.zeros(0, np.int64)], 0
            for text in batch.column("text").to_pylist():
                slab.append(text or "")
                size += len(slab[-1])
                if size >= SLAB_CHARS:
                    counts.append(t.count_texts(slab))
                    slab, size = [], 0
            counts.append(t.count_texts(slab))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(np.concatenate(counts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return ws.mapped(rows, run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
