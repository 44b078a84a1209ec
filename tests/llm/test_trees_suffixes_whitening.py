"""Operators 11 to 13 against brute force, with nulls, ties, repeats, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fadewell.llm import prefixtree, suffixes, whitening

SF = "/root/testdata/sf0.001"


# --- 11 --------------------------------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    own = {c: [v[2] for v in sorted(rows)] for c, rows in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[b] for b in below) if below else 1
        saved[k] = sum(saved[b] for b in below) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids.get(k, [])), leaves[k], saved[k],
                   sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))))) for k, m in members.items())


def tree(spark, df, size):
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefixtree.conversation_tree(spark, df, size).collect())


@pytest.fixture(scope="module")
def talks():
    """Shared beginnings, one conversation copied often, null turns, roles, texts and ids, repeated turns."""
    rng, rows = random.Random(1), []
    for c in [*range(0, 260, 2), 1005, 1100]:
        free = rng.random() < 0.5
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["u", "a", None]) if free else "u", rng.choice(["x", "yy", None, "éa"]) if free else "same"))
    return [*rows, (None, 1, "u", "x"), (5, 0, "u", "x"), (5, 0, "u", "x")]


@pytest.mark.parametrize("size", [100_000, 40, 3])
def test_prefix_tree(spark, talks, size):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").repartition(4)
    extra = df.select("*", *[F.lit(1).alias(n) for n in ("ids", "lens", "digest", "len", "base", "h", "shard", "number", "top")])
    assert tree(spark, extra, size) == brute_tree(talks)


def test_prefix_tree_of_given_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert tree(spark, df, 60) == brute_tree([tuple(r) for r in df.collect()])
    assert prefixtree.conversation_tree(spark, df.limit(0)).count() == 0


def test_deep_rows_and_balance(spark):
    """A row of 20,000 turns needs no recursion; siblings inserted median first form a shallow search tree."""
    ids = list(range(20_000))
    rows = spark.createDataFrame([(1, ids, [1] * len(ids)), (2, ids[:10], [1] * 10), (3, [], [])], "conv_id long, ids array<long>, lens array<long>")
    got = {(r["conv_id"], r["depth"]): r for r in prefixtree.prefix_nodes(spark, rows).collect()}
    assert len(got) == 20_001 and got[1, 0]["n_convs"] == 3 and got[1, 0]["saved_tokens"] == 10 and got[1, 10]["ends_sha256"] == sha("2")
    t = prefixtree.TernaryTree()
    for i in prefixtree.median_first(1023):
        t.insert([i], [1])
    steps, todo = 0, [(t.equal[0], 1)]
    while todo:
        node, deep = todo.pop()
        if node:
            steps = max(steps, deep)
            todo += [(t.low[node], deep + 1), (t.high[node], deep + 1)]
    assert steps == 10


# --- 12 --------------------------------------------------------------------------------------------------

def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(3)
    for case in range(200):
        data = rng.integers(0, int(rng.choice([1, 2, 4, 256])), int(rng.integers(1, 400))).astype(np.uint8)
        data = np.concatenate([data, data[: len(data) // 2], data]) if case % 3 == 0 else np.repeat(data, 3) if case % 5 == 0 else data
        wanted = rng.random(len(data)) < rng.choice([0.3, 1.0])
        order = suffixes.suffix_order(data, wanted, 100)
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        heads = [(data.tobytes()[i:] + bytes(100))[:100] for i in order]
        assert heads == sorted(heads)
        lcp = suffixes.common_prefixes(data, order, 100)
        for x, y, found in zip(heads, heads[1:], lcp[1:].tolist()):
            assert x[:found] == y[:found] and (found == 100 or x[found] != y[found])


def brute_repeats(rows, content):
    seen, out = set(), {}
    for i, _, t in sorted({(i, content[t or ""], t or "") for i, t in rows if i is not None}):
        b = t.encode()
        edge = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                edge[s] += 1
                edge[s + 100] -= 1
            seen.add(w)
        gone = np.cumsum(edge)[:-1] > 0
        kept = bytes(c for c, g in zip(b, gone.tolist()) if not g)
        out[i, t] = (len(b), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)), hashlib.sha256(kept).hexdigest())
    for t in (t or "" for i, t in rows if i is None):
        out[None, t] = (len(t.encode()), 0, 0, sha(t))
    return sorted((-1 if i is None else i, *out[i, t or ""]) for i, t in rows)


def check_repeats(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows], "doc_id long, text string, content long, core int, start int, cells string").repartition(4)
    text = F.coalesce("text", F.lit(""))
    content = {r[0]: r[1] for r in df.select(text, F.xxhash64(text)).collect()}
    got = sorted(tuple(-1 if v is None else v for v in r) for r in suffixes.remove_repeats(spark, df).collect())
    assert got == brute_repeats(rows, content)
    return got


@pytest.fixture(scope="module")
def texts():
    """A shared passage with other borders in every text, edited copies, runs, repeated and null ids."""
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(500)}é" for _ in range(n))
    base, passage = prose(300), prose(30)
    rows = [(i, f"{prose(rng.randrange(60))} {passage[: rng.randrange(90, len(passage))]} {prose(rng.randrange(60))}") for i in range(120)]
    rows += [(300 + i, base.replace("w1", "v1", i)) for i in range(20)]
    return rows + [(400, "x" * 5000), (401, "ab" * 3000), (402, "x" * 150), (403, None), (404, ""), (405, "é" * 50), (407, prose(3000)),
                   (None, base), (None, None), (5, base), (5, base), (5, base + "y"), (-3, base[50:])]


def test_suffix_repeats(spark, texts):
    assert sum(r[2] for r in check_repeats(spark, texts)) > 50_000


@pytest.mark.parametrize("limits", [{"HOT_CELLS": 20}, {"SAMPLE_HITS": 5}, {"EMIT_BYTES": 2000, "_PIECE": 256, "CELLS_PER_BUCKET": 50, "ARRAY_BYTES": 3000}])
def test_suffix_limits_change_no_result(spark, texts, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(suffixes, name, value)
    check_repeats(spark, texts)


def test_suffixes_of_given_and_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_repeats(spark, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert suffixes.remove_repeats(spark, docs.limit(0)).count() == 0


# --- 13 --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("d", [1, 2, 5, 64])
def test_eigen_by_projectors(d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    spectra = [rng.exponential(size=d) * 1e4, np.full(d, 5.0), np.repeat(rng.exponential(size=d), 2)[:d], np.where(np.arange(d) < d // 2, 3.0, 0.0),
               10.0 ** -np.arange(d), np.zeros(d), -np.arange(d, dtype=float)]
    for e in spectra:
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        values, vectors = whitening.eigen_by_projectors(a)
        scale = np.abs(e).max() or 1.0
        assert np.abs(values - np.sort(e)[::-1]).max() <= 1e-13 * d * scale
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-11
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * d * scale


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(20, 20))
    a = a + a.T
    e, v = np.linalg.eigh(a)
    assert np.abs(whitening.polar_factor(a) - (v * np.sign(e)) @ v.T).max() < 1e-12


def whiten_brute(x):
    n = len(x)
    v = np.cov(x.T, bias=True)
    e, u = np.linalg.eigh(v)
    s = x.sum(0).astype(object)
    deviation = [sum(int(g) ** 2 for g in n * row.astype(np.int64).astype(object) - s) for row in x]
    return (x - x.mean(0)) @ u[:, ::-1][:, :8] / np.sqrt(e[::-1][:8]), e[::-1][:8] / np.trace(v), deviation


def test_whitening(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    good = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    nan, inf = float("nan"), float("inf")
    odd = [(9000, None), (9001, []), (9002, [1.0] * 63 + [None]), (9003, [nan] * 64), (9004, [inf] + [0.0] * 63), (9005, [1.0, 2.0]), (None, [0.5] * 64), (0, [0.25] * 64)]
    rows = good + odd
    frame = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, v int, x int, n int").repartition(4)
    kept = good + odd[-2:]
    x = np.floor(1024 * np.array([v for _, v in kept], np.float32).astype(float)) + 100_000
    y, share, deviation = whiten_brute(x)
    got = whitening.whitened(spark, frame).collect()
    assert len(got) == 8 * len(kept) and {r["n"] for r in got} == {len(kept)}
    assert max(r["identity_error"] for r in got) < 1e-10
    for c in range(8):
        mine = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"], r["whitened"], r["explained"]) for r in got if r["component"] == c + 1)
        want = sorted((-1 if i is None else i, d, w) for (i, _), d, w in zip(kept, deviation, y[:, c]))
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        one, two = np.array([m[2] for m in mine]), np.array([w[2] for w in want])
        assert min(np.abs(one - two).max(), np.abs(one + two).max()) < 1e-7 and abs(mine[0][3] / share[c] - 1) < 1e-9


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark, spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark, spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whitened(spark, spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whitened(spark, spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 6)) for r in line) == [(1, 1, 1.414214), (2, 1, 0.707107), (2, 1, 0.707107)]
