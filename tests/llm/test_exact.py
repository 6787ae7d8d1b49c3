"""Operators against brute force on a small corpus with every odd case."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import tokenizers
from conftest import rows_of
from pyspark.sql import functions as F

from formloom.llm import bpe, components, decontaminate, jaccard_join, pii, quality, sharding, suffix_dedup, tables, token_counts
from formloom.llm import wordspans as ws

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BPE = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.fixture(scope="module")
def bench(spark, corpus):
    text = {i: t for i, t in corpus}
    items = [(1, text[3]), (2, text[400]), (10, "one two"), (11, "x"), (12, ""), (13, None), (14, "tie"), (15, text[3])]
    return spark.createDataFrame(items, "item_id long, text string")


def brute_contamination(rows, items, window=10):
    found = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found[tuple(w[k : k + window])].add(i)
    out = []
    for i, t in rows:
        w = ALNUM.findall(lower(t))
        hit, seen = [False] * len(w), set()
        for n in {len(k) for k in found}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in found:
                    seen |= found[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        out.append((i, len(w), sum(hit), len(seen), hashlib.sha256(",".join(sorted(map(str, seen))).encode()).hexdigest(), any(hit)))
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_decontamination(docs, clashing, none, corpus, bench, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    want = brute_contamination(corpus, [tuple(r) for r in bench.collect()])
    for d in (docs, clashing):
        assert rows_of(decontaminate.contamination(d, bench).drop("spans")) == want
    assert decontaminate.contamination(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    clean = decontaminate.decontaminate(clashing, bench)
    assert clean.columns == clashing.columns and clean.count() == len(corpus)
    if block > 40:
        text = {r["doc_id"]: r["text"] for r in clean.collect()}
        assert "tie" not in text[507] and text[5] == dict(corpus)[5] and text[500] is None


def test_items_of_any_id(spark, docs, bench):
    named = bench.withColumn("item_id", F.concat(F.lit("item "), F.col("item_id").cast("string"))).withColumn("spans", F.lit(1))
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, named).where("doc_id is not null").collect()}
    assert got == {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, bench).where("doc_id is not null").collect()}
    items = [(None, "one two"), ("a", "one two"), ("b", "one two")]
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id string, text string"))
    assert {r["items_sha256"] for r in found.where("doc_id = 504").collect()} == {hashlib.sha256(b"a,b").hexdigest()}


def test_cut_text_is_the_same_for_all_block_sizes(spark, docs, bench, monkeypatch):
    """Windows of items in different blocks overlap, and words meet that only a cut brings together."""
    w = [f"w{k}" for k in range(40)]
    text = " ".join(w)
    items = [(1, " ".join(w[:15])), (2, " ".join(w[7:22])), (3, " ".join(w[25:35])), (4, f"{w[22]} {w[23]} {w[24]} {w[35]} {w[36]}")]
    some, b = spark.createDataFrame([(1, text), (2, None), (3, "plain"), (4, f"é {text.upper()}. {text}")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = []
    for size in (decontaminate.BLOCK_WORDS, 40, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", size)
        got.append((rows_of(decontaminate.decontaminate(some, b)), rows_of(decontaminate.decontaminate(docs, bench)), rows_of(decontaminate.scan_documents(some, b, cut=True))))
    assert got[0] == got[1] == got[2]
    left = " ".join(w[22:25]) + "  " + " ".join(w[35:])
    assert {r[0]: r[1] for r in got[0][0]} == {1: " " + left, 2: None, 3: "plain", 4: f"é  {left.upper()}.  {left}"}


def test_fm_index_finds_all():
    rng = np.random.default_rng(2)
    runs = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(60)]
    runs += runs[:10]
    text = np.concatenate([np.append(r, 0) for r in runs]).astype(np.int32)
    index = decontaminate.FMIndex(text, 3)
    for n in (1, 2, 5):
        for w in itertools.islice(itertools.product((1, 2, 3), repeat=n), 60):
            low, high = index.search(np.array([w]), np.array([n]))
            at = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert at == [i for i in range(len(text) - n + 1) if tuple(text[i : i + n]) == w]


def test_byte_bpe(docs, clashing, none, corpus):
    ranks = bpe.tokenizer(*BPE).ranks
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in corpus:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.encode_documents(clashing, *BPE)
    assert rows_of(got.drop("ids")) == sorted(want, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))
    assert all(enc.decode(r["ids"]) == (r["text"] or "") for r in got.join(docs, "doc_id").where("doc_id <> 508").collect())
    assert bpe.encode_documents(none, *BPE).count() == 0


def test_byte_bpe_long_pieces():
    t = bpe.tokenizer(*BPE)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=t.ranks, special_tokens={})
    hard = ["a" * 5000, " " * 999, "é" * 300, "ab" * 2000, "0123456789" * 40, "!" * 65, "the" * 21 + "z"]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in t.encode(hard)] == [enc.encode_ordinary(x) for x in hard]


def test_token_counts(clashing, none, corpus):
    path = P.path("word_bpe_49k.json")
    ref = tokenizers.Tokenizer.from_file(path)
    want = [(i, len((t or "").encode()), n := len(ref.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in corpus]
    assert rows_of(token_counts.token_counts(clashing, path)) == sorted(want, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))
    assert token_counts.token_counts(none, path).count() == 0
    t = token_counts.transducer(path)
    hard = ["a" * 3000, "x<|endoftext|>y", "it's DON'T ΣΑΣ İ", "é", "ab" * 700, "\0", "antidisestablishmentarianism" * 9]
    assert t.count_texts(hard).tolist() == [len(ref.encode(x, add_special_tokens=False).ids) for x in hard]


def test_normalisers():
    spec = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Replace", "pattern": {"String": "."}, "content": "\\1"}, {"type": "Lowercase"}]}
    f = token_counts.normaliser(spec)
    assert f("E\u0301A \t\nB.ΟΔΟΣ") == "éa b\\1οδοσ" and token_counts.normaliser(None)(" A") == " A"
    with pytest.raises(ValueError):
        token_counts.normaliser({"type": "Precompiled"})


def brute_components(corpus):
    sets = []
    for i, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append((i, {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 90 * len(x | y):
            parent[root(a)] = root(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)].append(i)
    return [(i, len(s), min(least[root(k)]) if least[root(k)] else None) if s else (i, 0, i) for k, (i, s) in enumerate(sets)]


def test_jaccard_join(docs, clashing, none, corpus):
    want = sorted(brute_components(corpus), key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))
    assert rows_of(jaccard_join.link_components(clashing)) == want
    assert jaccard_join.link_components(none).count() == 0
    kept = jaccard_join.keep_one(clashing)
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert kept.columns == clashing.columns
    assert ids == sorted({c for i, n, c in want if n and c is not None} | {i for i, n, _ in want if not n and i is not None})


def test_keep_one_loses_no_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (9, c), (9, c + " more"), (None, a), (None, b + " more"), (None, "only here and nowhere else"), (11, None), (11, None), (None, ""), (12, c), (12, c)]
    got = collections.Counter(tuple(r) for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    words = [(i, t) for (i, t), n in got.items() for _ in range(n) if t]
    # Of each component one row, that of its smallest id; of rows equal in id, the text's hash decides.
    assert sorted(i is None for i, _ in words) == [False, False, False, True]
    assert (3, a) in got and (7, b) in got and ((9, c) in got) != ((9, c + " more") in got) and (None, "only here and nowhere else") in got
    assert got[11, None] == 2 and got[None, ""] == 1 and sum(got.values()) == 7


def test_null_ids_bridge_a_component(spark):
    w = [f"w{k}" for k in range(200)]
    far = ["x0", "x1"]
    rows = [(5, " ".join(w)), (None, " ".join([*far, *w[2:]])), (8, " ".join([*far, *w[2:190], *(f"y{k}" for k in range(7)), *w[197:]]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard_join.link_components(d)) == sorted(brute_components(rows), key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))
    assert {r["component_id"] for r in jaccard_join.link_components(d).collect()} == {5}


def test_hot_keys_are_joined_in_place(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_SHARE", 3)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (None, 4), (4, 1)) for i in range(n)], "key long, v long")
    table = spark.createDataFrame([(1, "a", 50), (2, "b", 3), (3, "c", 0)], "key long, name string, n long")
    for how in ("inner", "left", "left_semi"):
        got, want = tables.join_by(rows, table, "key", how=how), rows.join(table, "key", how)
        assert got.columns == want.columns and rows_of(got) == rows_of(want)


@pytest.mark.parametrize("sampled", [16, 1])
def test_near_copies_of_one_text_stay_linked(spark, sampled, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_SAMPLE", sampled)  # with all classes in the sample most blocks are hot
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 160)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.choice(160, rng.integers(0, 9), replace=False):
            w[k] = f"c{i}_{k}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got) == sorted(brute_components(rows), key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


def test_sketch_bounds_difference():
    rng = np.random.default_rng(1)
    for n in (10, 40, 300, 2000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 30 :], rng.integers(0, 2**63, n // 30, dtype=np.uint64)]))
        diff = len(np.setxor1d(a, b))
        assert np.bitwise_count(jaccard_join.sketch(a, 64) ^ jaccard_join.sketch(b, 64)).sum() <= diff
        if 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)):
            assert len(np.intersect1d(jaccard_join.block_keys(a), jaccard_join.block_keys(b))) or n < 19


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(corpus, length=50):
    words = [(i, ALNUM.findall(lower(t))) for i, t in corpus]
    classes = {tuple(w) for _, w in words if len(w) >= length}
    copies = collections.Counter(tuple(w) for _, w in words if len(w) >= length)
    seen = collections.defaultdict(set)
    for c in classes:
        for k in range(len(c) - length + 1):
            seen[c[k : k + length]].add(c)
    out = []
    for i, w in words:
        hit = [False] * len(w)
        for k in range(len(w) - length + 1):
            if len(seen[tuple(w[k : k + length])]) > 1 or copies[tuple(w)] > 1:
                hit[k : k + length] = [True] * length
        if any(hit):
            out.append((i, len(w), sum(hit), copies[tuple(w)]))
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


def test_repeated_passages(clashing, none, corpus):
    got = suffix_dedup.repeated_passages(clashing)
    assert rows_of(got.drop("spans")) == brute_repeats(corpus)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_repeated"] for r in got.collect())
    assert suffix_dedup.repeated_passages(none).count() == 0


def test_repeated_passages_of_hot_groups(spark, monkeypatch):
    """A passage in most documents with other words around it, parts of it, ids that are null, and a repeat in one text only."""
    rng = np.random.default_rng(3)
    passage = [f"p{k}" for k in range(70)]

    def own(i, n):
        return [f"d{i}_{k}" for k in range(n)]

    rows = [(None if i % 3 == 0 else i, " ".join([*own(i, int(rng.integers(0, 40))), *passage, *own(i + 1000, int(rng.integers(0, 40)))])) for i in range(60)]
    rows += [(100 + i, " ".join([*own(2000 + i, 9), *passage[int(rng.integers(0, 30)) : int(rng.integers(40, 71))], *own(3000 + i, 9)])) for i in range(60)]
    # Left and right parts from different documents, and a third that has some of both.
    x = [f"x{k}" for k in range(90)]
    rows += [(300, " ".join(x)), (301, " ".join([*own(1, 5), *x[:55], *own(2, 30)])), (302, " ".join([*own(3, 30), *x[30:], *own(4, 5)])), (303, " ".join([*own(5, 12), *x[14:71], *own(6, 12)]))]
    rows += [(400, " ".join([f"twice{k}" for k in range(60)] * 2)), (401, "tie " * 3000), (402, "tie " * 2000 + "end")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for share, hot in ((1000, False), (3, True)):
        monkeypatch.setattr(tables, "HOT_SHARE", share)
        got = suffix_dedup.repeated_passages(d)
        assert rows_of(got.drop("spans")) == brute_repeats(rows), hot
        assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_repeated"] for r in got.collect())


def test_near_copies_over_many_partitions_open_few_windows(spark, monkeypatch):
    """A partition's ends are met by the next partition's: they don't send all windows of a large group."""
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(160)]
    rows = []
    for i in range(150):
        own = list(words)
        for k in rng.integers(0, 160, 3):
            own[k] = f"own{i}_{k}"
        rows.append((i, " ".join(own)))
    made, sharing = [], suffix_dedup._sharing

    def counted(d, key, *more):
        if key == "window":
            made.append(d.count())
        return sharing(d, key, *more)

    monkeypatch.setattr(suffix_dedup, "_sharing", counted)
    many = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        got = rows_of(suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == brute_repeats(rows)
    assert sum(made) < 2000, made


def test_neighbours_in_batches(monkeypatch):
    """The same verdict however the sorted rows are cut into batches."""
    rng = np.random.default_rng(9)
    n = 300
    right = np.sort(rng.integers(0, 2, (n, suffix_dedup.LENGTH)), axis=0).astype(np.uint64)
    right = right[np.lexsort(right.T[::-1])]
    left = rng.integers(0, 2, (n, suffix_dedup.REACH)).astype(np.uint64)
    names = np.repeat(rng.integers(0, 5, n // 3), 3).astype(np.uint64)[:, None] * np.ones((1, 2), np.uint64)
    ints = lambda v: pa.array(np.full(n, v), pa.int32())
    batch = pa.RecordBatch.from_arrays([ws.binaries(names), pa.array(np.arange(n), pa.int32()), pa.array(np.zeros(n, np.int64)), ws.binaries(left), ws.binaries(right), ints(suffix_dedup.REACH), ints(suffix_dedup.LENGTH)], names=list(suffix_dedup.Suffixes.NAMES))
    got = [pa.Table.from_batches(suffix_dedup._neighbours(batch.slice(i, size) for i in range(0, n, size))).to_pylist() for size in (n, 7, 1)]
    assert got[0] == got[1] == got[2] and len(got[0]) == n and [r["place"] for r in got[0]] == list(range(n))
    assert any(r["mask"] for r in got[0]) and sum(not r["known"] for r in got[0]) < n // 3


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, clashing, none, corpus):
    odd = ["a@b.c_d@e.f", "a@b.c.", "1.2.3.4.5.6.7.8", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "9" * 4000, "a." * 2000 + "@b" + ".c" * 3000, "+5   ", "+12345678.", "4111-1111-1111-1111 4111111111111111", "+1 1.2.3.4 x@y.z"]
    d = clashing.select("doc_id", "text").unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    text = dict(corpus) | {9000 + i: t for i, t in enumerate(odd)}
    for r in pii.find(d).collect():
        want = base_spans(text[r["doc_id"]] if r["doc_id"] is not None else "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), r
        assert [x for x in r["spans"].split(",") if x and not x.startswith("term")] == want
    assert pii.find(none).count() == 0
    clean = pii.sanitise(clashing)
    assert clean.columns == clashing.columns and clean.count() == len(corpus)
    assert not any(base_spans(r["text"]) for r in clean.collect())
    assert {r["text"] for r in clean.where("doc_id < 5").collect()} == {t for i, t in corpus if i is not None and i < 5}


def test_disclosing_terms_are_found(spark):
    rows = [(i, f"filler{i} word{i} Zanzibarov reach me at secret.person@corp.org thanks note{i}") for i in range(6)] + [(50 + i, f"other text number {i} thanks") for i in range(60)]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[0][1].index("Zanzibarov")
    assert f"term:{at}:{at + 10}" in got[0].split(",") and got[50] == ""
    text = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Zanzibarov" not in text[0] and "[EMAIL]" in text[0] and text[50] == rows[6][1]


def brute_terms(rows):
    """Spans of disclosing terms, by counting contexts one by one; ASCII texts with emails only."""
    term, contexts, n_e, n_te, held = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2,}(?![A-Za-z0-9])"), [], collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        for m in re.finditer(BASE["email"], t):
            a, b = max(0, m.start() - pii.REACH), min(len(t), m.end() + pii.REACH)
            while a > 0 and a < len(t) and t[a].isalnum() and t[a - 1].isalnum():
                a += 1
            if a == max(0, m.start() - pii.REACH) and a > 0 and t[a].isalnum():
                while t[a].isalnum():
                    a += 1
            while b < len(t) and t[b - 1].isalnum():
                b -= 1
            found = [(x[0].lower(), a + x.start(), a + x.end()) for x in term.finditer(t[a:b])]
            e = m[0].lower()
            n_e[e] += 1
            n_te.update((w, e) for w, _, _ in found)
            held.update({(w, e) for w, _, _ in found})
            contexts.append((i, e, m.start(), m.end(), found))
    n_t = collections.Counter(w for _, t in rows for w in re.findall("[a-z0-9]+", t.lower()))
    total, out = sum(len(t) for _, t in rows), collections.defaultdict(set)
    for i, e, start, end, found in contexts:
        for w, a, b in found:
            if held[w, e] >= pii.SUPPORT and 1 - math.log(max(n_t[w], n_te[w, e]) / n_te[w, e]) / math.log(max(total / n_e[e], 2)) >= pii.GENERALISE and (b <= start or a >= end):
                out[i].add(f"term:{a}:{b}")
    return out


def test_disclosure_against_counting(spark):
    rng = random.Random(5)
    common = [a + b for a in "ba de fo gi lu ma no re".split() for b in "l n r s t".split()]
    people = [f"{a}{b} {a}.{b}@corp{k % 3}.org" for k, (a, b) in enumerate(itertools.product("Anna Bob Cy Di".split(), "Orr Li Zanzibarov".split()))]
    rows = []
    for i in range(400):
        w = [rng.choice(common) for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randint(0, len(w)), rng.choice(people))
        rows.append((i, " ".join(w)))
    want = brute_terms(rows)
    got = {r["doc_id"]: {x for x in r["spans"].split(",") if x.startswith("term")} for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    base = {i: [tuple(map(int, x.split(":")[1:])) for x in base_spans(t)] for i, t in rows}
    free = {i: {x for x in want[i] if not any(int(x.split(":")[1]) < b and int(x.split(":")[2]) > a for a, b in base[i])} for i, _ in rows}
    assert got == free and sum(map(len, got.values())) > 100


def test_terms_whose_lower_case_is_longer(spark):
    """A capital I with a dot is two characters in lower case; terms that hold it are found like others."""
    rows = [(i, f"note{i} {w} writes from p{k}@corp{k}.org today again") for k, w in enumerate(("Olkay", "İlkay", "Dİlek")) for i in range(10 * k, 10 * k + 4)]
    rows += [(100 + i, "writes from today again " * 9) for i in range(20)]
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows[:12]:
        at = t.index(" ") + 1
        assert f"term:{at}:{at + 5}" in got[i]


def test_terms_are_generalised_to_their_kind(spark):
    d = spark.createDataFrame([("Smith",), ("FBI",), ("blue",), ("Émile",)], "t string")
    assert [r[0] for r in d.select(pii.generalised(F.col("t"))).collect()] == ["[NAME]", "[ACRONYM]", "[WORD]", "[NAME]"]


def test_disclosing_terms_of_copies_are_found(spark):
    """Copies count in all counts or in none: terms that occur only beside their entity stay disclosing."""
    filler = "common words only " * 40
    once = "Quixotesson writes from secret.person@corp.org today"
    rows = [(i, once) for i in range(300)]  # one context in a large group of copies
    rows += [(1000 + i, f"{'left' if i % 2 else 'right'} Zanzibarov other.person@corp.org") for i in range(400)]  # two contexts, 200 copies each
    rows += [(5000 + i, f"Thrice Thrice Thrice third.person{i}@corp.org") for i in range(3)]  # one context of each entity
    rows += [(9000, filler)]
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for i, word in ((0, "Quixotesson"), (299, "Quixotesson"), (1000, "Zanzibarov"), (1399, "Zanzibarov")):
        at = text[i].index(word)
        assert f"term:{at}:{at + len(word)}" in got[i]
    assert not any(x.startswith("term") for x in got[5000])
    assert got[9000] == [""]


def test_quality(clashing, none, corpus):
    got = quality.judge(clashing)
    want = []
    for i, t in corpus:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = collections.Counter(grams)
        hit = [False] * len(w)
        for k, g in enumerate(grams):
            if n[g] > 1:
                hit[k : k + 5] = [True] * 5
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit), len(w) < 10 or 100 * sum(hit) > 20 * len(w)))
    assert rows_of(got.drop("kept", "rejected_by")) == sorted(want, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))
    assert all(not r["kept"] for r in got.collect() if r["base_failed"])
    assert quality.judge(none).count() == 0
    order = list(quality.rules())
    verdicts = [rows_of(quality.measured(clashing).select("doc_id", quality.cascade(quality.rules(), o).isNull())) for o in (order, order[::-1])]
    assert verdicts[0] == verdicts[1]


def test_rules_are_ordered_by_what_earlier_ones_leave(spark, none):
    sets = {frozenset(): 50, frozenset({"wide"}): 10, frozenset({"wide", "same"}): 30, frozenset({"own"}): 10}
    cost = {"never": 0.1, "same": 1.0, "own": 1.0, "wide": 1.0}
    # "same" rejects more rows than "own", but none that "wide" leaves.
    assert quality.ordered(quality.Estimate(cost, sets)) == ["wide", "own", "never", "same"]
    assert quality.ordered(quality.Estimate(cost | {"own": 0.1}, sets)) == ["own", "wide", "never", "same"]
    assert quality.ordered(quality.estimate(quality.measured(none), quality.rules())) == list(quality.rules())


def test_sharding(clashing, none, corpus):
    got = sharding.shard(clashing).collect()
    assert len(got) == len(corpus)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 40 and r["law"] == "key" and (r["grown_shard"] == r["shard"] or r["grown_shard"] == 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in corpus)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard(none).count() == 0


@pytest.mark.parametrize("step", [10_000, 300])
def test_slots_of_a_hot_key(spark, step, monkeypatch):
    """Rows alike, and rows of one key (null), take slots of their own without gaps."""
    monkeypatch.setattr(sharding, "STEP", step)
    rows = [(None, f"text {i % 50}") for i in range(3000)] + [(1, "same")] * 2000 + [(i, None) for i in range(500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert collections.Counter((r["doc_id"], r["text_crc32"]) for r in got) == collections.Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)


def test_sharding_growth_and_balance(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    many = keys.select(*(sharding.descend(F.col("k"), sharding.tree(n)).alias(f"s{n}") for n in (40, 41, 42))).collect()
    for a, b in (("s40", "s41"), ("s41", "s42")):
        assert {r[b] for r in many if r[a] != r[b]} == {int(b[1:]) - 1}
    sizes = collections.Counter(r["s40"] for r in many)
    assert min(sizes.values()) > 380 and max(sizes.values()) < 630


def test_slabs_and_words_cross_no_text():
    texts = pa.array(["ab", None, "", "cd ef", "g"])
    got = []
    for a, b, data, offsets in ws.slabs(texts, 3):
        s, e, first = ws.words(data, offsets, ws.NOT_SPACE)
        got += [[bytes(data[x:y]) for x, y in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]], strict=True)] for i in range(b - a)]
    assert got == [[b"ab"], [], [], [b"cd", b"ef"], [b"g"]]


def complementary(n):
    """A word of n letters a and b, and the one with both swapped: equal sums under any polynomial modulo 2^64 from 1,024 on."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [16, 32, 64, 1024, 2048, 4096])
def test_complementary_words_differ(spark, n):
    a, b = complementary(n)
    data = np.frombuffer((a + b).encode(), dtype=np.uint8)
    x, y = ws.word_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert x != y
    # Runs of two words in the same shape.
    h = np.array([7, 11], dtype=np.uint64)
    runs = [h[np.frombuffer(w.encode(), dtype=np.uint8) - 97] for w in (a, b)]
    assert ws.gram_hashes(runs[0], n)[0] != ws.gram_hashes(runs[1], n)[0]


def test_complementary_words_are_apart(spark, bench):
    a, b = complementary(2048)
    rows = [(1, a), (2, b), (3, f"x {a} y z"), (4, f"x {b} y z")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard_join.link_components(d).select("doc_id", "component_id")) == [(i, i) for i in (1, 2, 3, 4)]
    assert rows_of(jaccard_join.keep_one(d)) == rows
    items = spark.createDataFrame([(9, a)], "item_id long, text string")
    assert rows_of(decontaminate.contamination(d, items).select("doc_id", "contaminated")) == [(1, True), (2, False), (3, True), (4, False)]
    passage = [f"w{k}" for k in range(49)]
    long = spark.createDataFrame([(i, " ".join([*passage[:20], w, *passage[20:]])) for i, w in ((1, a), (2, b), (3, a))], "doc_id long, text string")
    assert [r["doc_id"] for r in suffix_dedup.repeated_passages(long).orderBy("doc_id").collect()] == [1, 3]


def test_gram_hashes_follow_the_words():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 4, 300).astype(np.uint64)
    for n in (1, 2, 3, 10, 25, 50):
        found = ws.gram_hashes(h, n)
        assert len(found) == 300 - n + 1
        seen = collections.defaultdict(set)
        for k, g in enumerate(found.tolist()):
            seen[tuple(h[k : k + n].tolist())].add(g)
        assert all(len(v) == 1 for v in seen.values())
        assert len(set(found.tolist())) == len(seen)
    assert len(ws.gram_hashes(h[:3], 4)) == 0


def test_swept_tables_leave_the_folder(spark, docs, tmp_path, monkeypatch):
    """What operators write goes when their result is saved; what is kept stays readable."""
    monkeypatch.setattr(tables, "shared_folder", lambda spark: str(tmp_path))
    kept = []
    with tables.sweeping(kept):
        kept.append(tables.written(jaccard_join.keep_one(docs)))
        assert len(list(tmp_path.iterdir())) > 1
        with tables.sweeping():
            pii.sanitise(docs).write.format("noop").mode("overwrite").save()
    assert [str(p) for p in tmp_path.iterdir()] == [kept[0].written_to] and kept[0].count() > 0
    with pytest.raises(ZeroDivisionError), tables.sweeping():
        tables.written(docs)
        raise ZeroDivisionError
    assert len(list(tmp_path.iterdir())) == 1
