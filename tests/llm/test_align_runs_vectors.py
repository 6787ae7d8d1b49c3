"""Tokenizer alignment, periodic runs and near-duplicate vectors against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers
from conftest import rows_of

from formloom.llm import align, embedding_dedup, runs

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_tokens(texts):
    """[(ids, bytes) of A, of B] of each text, None where it has no tokens."""
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    back = align.byte_of_character()
    out = []
    for t in texts:
        found = None
        if t:
            of_a = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
            of_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
            if all(b"".join(x for _, x in side) == (" " + t).encode() for side in (of_a, of_b)):
                found = of_a, of_b
        out.append(found)
    return out


def brute_alignment(rows):
    kept, links = [], []
    for (i, _), tokens in zip(rows, brute_tokens([t for _, t in rows]), strict=True):
        if tokens is None:
            kept.append((i, 0, 0, 0, ""))
            links.append([])
            continue
        spans = []
        for side in tokens:
            at, found = 0, []
            for token, raw in side:
                found.append((token, at, at + len(raw)))
                at += len(raw)
            spans.append(found)
        a, b = spans
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, last = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(t) for t, s, e in side if s >= last and e <= end) for side in (a, b)))
            last = end
        met, first = [], 0
        for x, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                met.append((x, b[k][0]))
                k += 1
        kept.append((i, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(met)
    n = collections.Counter(p for met in links for p in set(met))
    most = collections.defaultdict(int)
    for (x, _), k in n.items():
        most[x] = max(most[x], k)
    return [(i, na, nb, g, len(met), sum(n[p] == most[p[0]] for p in met), sum(n[p] for p in met), sha) for (i, na, nb, g, sha), met in zip(kept, links, strict=True)]


def sort_rows(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


ODD = ["a  b", "  lead", " ", "   ", "x ", " x  ", "tab\tx\n\n y", "<s> </s> <|endoftext|> <0x41>", "é😀 ▁ q", "ａｂ", "a\xa0b　c", "\0q\x1c \x85 z", "日本語テキスト" * 40, "it's 'S ''s don't ¼²", "c" * 5000 + " " * 300 + "d"]


@pytest.mark.parametrize("hot", [1_000_000, 50, 0])
def test_alignment(spark, clashing, none, corpus, hot, monkeypatch):
    monkeypatch.setattr(align, "HOT_PAIRS", hot)
    monkeypatch.setattr(align, "KEEP_PAIRS", 2000)
    rows = [(i, t) for i, t in corpus if t is None or len(t) < 20000] + [(900 + k, t) for k, t in enumerate(ODD)] + [(905, ODD[5]), (999, "x ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(align.alignment(docs, A, B)) == sort_rows(brute_alignment(rows))
    if hot == 50:
        assert align.alignment(none, A, B).count() == 0
        assert align.alignment(clashing, A, B).count() == len(corpus)


def test_pieces_are_read_as_the_libraries_read_texts(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(align, "KEEP", 40)
    texts = ODD + ["".join(rng.choice(" \n\t\x1c\x85\xa0ab'sé日😀▁​1.́͸") for _ in range(rng.randint(1, 30))) for _ in range(400)]
    for got, want in zip(align.sides(A, B).encode(texts), brute_tokens(texts), strict=True):
        assert (got is None) == (want is None)
        if got is not None:
            assert [g.tolist() for g in got] == [[i for i, _ in side] for side in want]


def brute_runs(words, least, times):
    """(start, length, period) of all runs of words, period by period."""
    n, out = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            smaller = any(p % q == 0 and all(words[k] == words[k + q] for k in range(i, i + length - q)) for q in range(1, p))
            if length >= max(least, times * p) and not smaller:
                out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, kinds = rng.choice([0, 1, 5, 30, 80, 150]), rng.choice([1, 2, 3, 30])
            t = [rng.randint(1, kinds) for _ in range(n)]
            if n and rng.random() < 0.7:
                s = rng.randint(0, n - 1)
                p = rng.randint(1, max(1, (n - s) // 3))
                t = [t[k] if k < s else t[s + (k - s) % p] for k in range(n)] + [rng.randint(1, kinds) for _ in range(rng.choice([0, 0, 9]))]
            texts.append(t)
        least, times = rng.choice([(24, 3), (4, 2), (6, 3), (1, 2), (1, 4)])
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        found = runs.find_runs(np.array([x for t in texts for x in [*t, 0]], dtype=np.int64), starts, least, times)
        assert list(zip(*(x.tolist() for x in found), strict=True)) == [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t, least, times)]


def fibonacci(n):
    a, b = [1], [1, 2]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_of_words_with_many():
    for t in (fibonacci(400), [1] * 300, [1, 2] * 150, list(range(1, 300)), list(range(300, 0, -1)), ([1] * 30 + [2]) * 9):
        found = runs.find_runs(np.array([*t, 0]), np.array([0, len(t) + 1]), 4, 2)
        assert list(zip(*(x.tolist() for x in found[1:]), strict=True)) == brute_runs(t, 4, 2)


def test_suffix_ranks_minima_and_next_smaller():
    rng = random.Random(2)
    texts = [[rng.randint(1, 2) for _ in range(rng.randint(0, 40))] for _ in range(20)] + [[1] * 50]
    codes = [x for t in texts for x in [*t, 0]]
    number = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    s = runs.Suffixes(np.array(codes), number)
    ends = np.cumsum([len(t) + 1 for t in texts])
    suffix = [(int(number[i]), codes[i : ends[number[i]]]) for i in range(len(codes))]
    order = sorted(range(len(codes)), key=lambda i: suffix[i])
    assert s.rank[order].tolist() == list(range(len(codes)))
    for x, y in zip(order, order[1:], strict=False):
        if suffix[x][0] == suffix[y][0]:
            same = next(k for k, (p, q) in enumerate(zip(suffix[x][1], suffix[y][1], strict=False)) if p != q)
            assert s.lcp[s.rank[y]] == same
    values = np.array([rng.randint(0, 99) for _ in range(500)])
    lo = np.array([rng.randint(0, 499) for _ in range(300)])
    hi = np.array([rng.randint(x, 499) for x in lo])
    assert runs.range_minima(values, lo, hi).tolist() == [min(values[x : y + 1]) for x, y in zip(lo, hi, strict=True)]
    for v in (rng.sample(range(400), 400), list(range(400)), list(range(400, 0, -1)), [0, *range(400, 0, -1)]):
        want = [next((j for j in range(i + 1, len(v)) if v[j] < v[i]), len(v)) for i in range(len(v))]
        assert runs.next_smaller(np.array(v)).tolist() == want


def brute_periodic(i, text):
    words = WORDS.findall(text or "")
    n = len(words)
    if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + math.floor((n - a) / (3 + g % 8))
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = brute_runs(words, 24, 3)
    dropped = {k for s, size, q in found for k in range(s + q, s + size)}
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    text = " ".join(w for k, w in enumerate(words) if k not in dropped)
    return (i, len(found), *top, None if top[0] is None else math.floor(1000 * top[1] / top[2]), *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, text)))


def test_periodic_runs(spark, clashing, none, corpus, monkeypatch):
    monkeypatch.setattr(runs, "SLAB_WORDS", 500)
    rows = [(i, t) for i, t in corpus if t is None or len(t) < 10000]
    rows += [(1000 + k, " ".join(f"w{x % 7}" for x in range(40 + k)) + "\x0b\x0cend") for k in range(40)] + [(None, "a b " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sort_rows(brute_periodic(i, t) for i, t in rows)
    assert sum(r[1] > 0 for r in want) > 40
    assert rows_of(runs.periodic_runs(docs, runs.planted, texts=False)) == want
    whole = runs.periodic_runs(docs).collect()
    plain = {r["collapsed"] for r in whole if r["runs"] and r["doc_id"] is None}
    assert plain == {"a b"}
    assert runs.periodic_runs(none).count() == 0
    assert runs.periodic_runs(clashing, runs.planted).count() == len(corpus)


def brute_links(rows, least=0.95):
    x = {}
    for k, (_, v) in enumerate(rows):
        if v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            u = np.array(v, dtype=np.float64)
            u = u / np.abs(u).max()
            x[k] = u / math.sqrt((u * u).sum())
    near = collections.defaultdict(set)
    for a in x:
        for b in x:
            if a != b and len(x[a]) == len(x[b]) and x[a] @ x[b] >= least:
                near[a].add(b)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        least_id = min(ids) if ids else None
        out.append((i, len(near[k]), least_id, i == least_id))
    return sort_rows(out)


def vectors(rng, n, groups, noise):
    """Rows (vec_id, vector): random ones and groups of near copies."""
    rows = [(i, rng.normal(size=24).tolist()) for i in range(n)]
    for size in groups:
        centre = rng.normal(size=24)
        rows += [(len(rows) + k, (centre * rng.uniform(0.1, 9) + rng.normal(size=24) * 0).tolist()) for k in range(2)]
        rows += [(len(rows) + k, (centre + rng.normal(size=24) * noise).tolist()) for k in range(size)]
    return rows


ODD_VECTORS = [(9000, None), (9001, []), (9002, [0.0] * 24), (9003, [float("nan")] + [1.0] * 23), (9004, [float("inf")] * 24), (9005, [None] + [1.0] * 23), (9006, [1.0, 1.0]), (9007, [1.0, 1.001]), (9008, [1e-30] * 24), (9009, [1e30] * 24), (None, [1.0] * 24), (9008, [1.0] * 24), (None, [5.0, -1.0, 2.0] * 8)]


@pytest.mark.parametrize(("kind", "noise", "block"), [("float", 0.05, 1024), ("double", 0.05, 16), ("float", 0.2, 40)])
def test_near_duplicate_vectors(spark, kind, noise, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors(np.random.default_rng(4), 300, [2, 5, 150], noise)
    rows = [(i, np.array(v, dtype=np.float32).astype(float).tolist()) for i, v in rows] + [(i, v if v is None else [c if c is None else float(np.float32(c)) for c in v]) for i, v in ODD_VECTORS]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, row string, cell int").repartition(3)
    exact = rows_of(embedding_dedup.near_duplicates(df, margin=math.sqrt(2 - 2 * 0.95)))
    assert exact == brute_links(rows)
    # Fewer visits: no pair is made up, and hardly one is lost.
    found = embedding_dedup.near_duplicates(df).collect()
    links, want = sum(r["n_links"] for r in found), sum(r[1] for r in exact)
    assert len(found) == len(rows)
    assert 0.98 * want <= links <= want


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert rows_of(embedding_dedup.near_duplicates(df)) == [(1, 0, 1, True), (2, 0, 2, True)]
