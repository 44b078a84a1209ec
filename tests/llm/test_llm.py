"""The corpus operators against brute-force versions on small tables with nulls, ties and repeats."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash

from fadewell.llm import components, decontaminate, embeddings, hamming, html, language, packing, planes, secrets, sharding, simhash, substrings
from fadewell.llm.queries import tokenizer_path
from fadewell.llm.tokens import Encoder, encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, fp long, id long, a string"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "x") for i, t in zip(ids, texts)], SCHEMA).repartition(4)


def words(rng, n, pool=4000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, odd white space, copies, near copies, a long text, null and repeated ids."""
    rng = random.Random(3)
    base = words(rng, 300)
    near = base.replace(" w", " v", 3)
    texts = [None, "", "  \n ", "one", "one two three", base, base, near, base + " " + words(rng, 60), words(rng, 4000), "x" * 5000, " a  b \n\n c ", "token=abcdefghijklmnop", None, base]
    return frame(spark, texts, [*range(len(texts) - 2), None, 6])


@functools.cache
def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def whole_ids(text):
    return whole_tokenizer().encode(text or "", add_special_tokens=False).ids


def test_token_pieces_equal_whole_texts():
    rng = random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "é", "1", "'s", "!", "<|endoftext|>", "中", "​", " b", "Ab12", "\U0001f600", "\r\n", ".", ","]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text, ids in zip(texts, encoder(tokenizer_path()).ids(texts)):
        assert ids == np.array(whole_ids(text), "<u4").tobytes(), repr(text)


def test_literal_added_tokens():
    mark = "<|endoftext|>"
    texts = [mark, f"a {mark} b", f"{mark}{mark}", f"a{mark}", f"{mark} a", f"  {mark}\n", f"{mark}\t{mark}", "<|endoftext", f"é{mark}中"]
    found = [np.frombuffer(raw, "<u4").tolist() for raw in encoder(tokenizer_path()).ids(texts)]
    assert found == [whole_ids(t) for t in texts] and found[1] == [64, 220, 50256, 275]


def test_new_pieces_cost_little(monkeypatch):
    """New words go to the model alone, and a word that meets other marks is not learned again."""
    monkeypatch.setattr("fadewell.llm.tokens.PIECES_KEPT", 40)
    rng, one, asked = random.Random(5), Encoder(tokenizer_path()), []
    whole = one._whole
    monkeypatch.setattr(one, "_whole", lambda texts: asked.extend(texts) or whole(texts))
    texts = ["The" + "".join(rng.choice(" \n") + rng.choice(("the", "Straße", "été", "a1b2", "Ab" + rng.choice("cdefgh") * 3)) + rng.choice((",", "!!", ")...", "")) for _ in range(40)) for _ in range(20)]
    texts += ["a×b ×, ×", "it's, 'll x's!"]
    for text, raw in zip(texts, one.ids(texts, group=4)):
        assert np.frombuffer(raw, "<u4").tolist() == whole_ids(text), text
    assert len("".join(asked)) < 200 < 2000 < len("".join(texts))  # first words of texts and odd ones
    assert {k for k in one.kept | one.former if k.endswith((",", "!", "."))} <= {"×,"}


def test_lookups_are_bounded(monkeypatch):
    """A worker holds the words of few texts at once, and of long texts fewer."""
    one, groups = Encoder(tokenizer_path()), []
    spaced = one._ids_spaced
    monkeypatch.setattr(one, "_ids_spaced", lambda texts: groups.append(texts) or spaced(texts))
    texts = ["ab cd"] * 1000 + ["ab " * 300_000 + "ab"] * 6
    assert [len(raw) for raw in one.ids(texts)] == [len(whole_ids(t)) * 4 for t in texts[:1] * 1000 + texts[-1:] * 6]
    assert max(map(len, groups)) <= 250 and max(sum(map(len, g)) for g in groups) < 2_000_000


# --- 1 ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    for n in (0, 1, 7, 8, 9, 1000):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert (planes.from_planes(planes.to_planes(ids, bits), n) == ids).all()


def test_crc32_joined():
    a, b = b"abc" * 50, b"defg" * 33
    assert planes.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("bits,block", [(False, 65536), (True, 64)])
def test_planes_file(spark, odd, tmp_path, bits, block):
    path = str(tmp_path / "planes")
    planes.write_planes(planes.encode_planes(odd, tokenizer_path(), bits=bits, block_ids=block), path)
    rows = sorted(planes.read_planes(spark, path).collect(), key=lambda r: r["start"])
    want = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in rows] == [w[0] for w in want]
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    crc = lambda t: zlib.crc32(np.array([*whole_ids(t), 0], "<u4").tobytes())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids_crc32"]) for r in rows) == sorted((-1 if i is None else i, crc(t)) for i, t in want)


# --- 2 ---------------------------------------------------------------------------------------------------

BRUTE = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12, 2), (re.compile("AKIA[A-Z0-9]+"), 18, 0), (re.compile("[0-9a-f]+"), 16, 0)]


def brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, n, g) in enumerate(BRUTE) for m in p.finditer(text or "") if len(m[g]) >= n)


def test_secret_automaton_random():
    rng, s = random.Random(2), secrets.scanner(secrets.BASE_RULES + secrets.MORE_RULES)
    parts = ["password", "Token", "SECRET", "api_key", "apikey", "passwd", "AKIA", "AKIAAB", "=", ":", " ", '"', "'", "abcdef0123456789", "0123", "é", "\U0001f600", "ABCDEFGH12345", "x", "F", "-", ".", "\n", "ſ", "K"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [f for f in s.spans(text) if f[1] < 3] == brute_spans(text), text


def test_many_secrets_take_linear_time():
    text = "token = abcdefghijklmnop; " * 20_000
    scan = secrets.Scanner(secrets.BASE_RULES)
    begin = time.time()
    assert len(scan.spans(text)) == 20_000 and time.time() - begin < 20
    assert scan.spans(text[:2600]) == brute_spans(text[:2600])


def test_secret_query(spark, odd, documents):
    for docs in (odd, documents):
        got = {(r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in secrets.secret_spans(docs, more=()).collect()}
        want = set()
        for r in docs.collect():
            b = brute_spans(r["text"])
            digest = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{e}" for a, k, e in b)
            want.add((r["doc_id"], hashlib.sha256(digest.encode()).hexdigest(), *(sum(x[1] == k for x in b) for k in range(3))))
        assert got == want


def test_more_rules_and_minimal():
    text = "ghp_" + "a1B2" * 9 + " eyJhbGci.eyJzdWIi." + "q" * 20 + " -----BEGIN RSA PRIVATE KEY-----"
    s = secrets.scanner(secrets.BASE_RULES + secrets.MORE_RULES)
    assert [s.rules[r].kind for _, r, _ in s.spans(text)] == ["github", "jwt", "private_key"]
    assert len(secrets.compiled([secrets.parsed("(ab|cb)")], False).hits) == 4  # start, after a or c, end, dead


# --- 3 ---------------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    label = list(range(len(fps)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(fps))]


def test_simhash_query(spark, odd, documents):
    for docs in (odd, documents):
        rows = [r for r in docs.collect() if r["doc_id"] is not None]
        fps = [brute_fingerprint(r["text"]) for r in rows]
        label, least = brute_components(fps, 4), {}
        for r, c in zip(rows, label):
            least[c] = min(least.get(c, 1 << 60), r["doc_id"])
        want = sorted((r["doc_id"], f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, label))
        got = sorted(tuple(r) for r in simhash.fingerprint_groups(spark, docs).where("doc_id is not null").collect())
        assert got == want


def test_hot_shards_lose_no_link(spark):
    """Dense groups far beyond a chunk, with bridges between them."""
    rng = random.Random(9)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(250):
            f = centre
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(300)})
    items = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id long, fp long")
    for radius in (2, 4):
        edges = hamming.fingerprint_links(spark, items, radius, chunk=16)
        pairs = [tuple(r) for r in edges.collect()]
        assert len(pairs) < 40 * len(fps)
        got = hamming.flat_components(len(fps), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        assert got.tolist() == brute_components(fps, radius)


def test_tables_guarantee():
    rng = random.Random(4)
    for radius in (1, 4, 7):
        for rows in (10, 10**6, 10**9):
            masks = hamming.tables(radius, rows)
            for _ in range(200):
                x = 0
                for b in rng.sample(range(64), radius):
                    x |= 1 << b
                assert any(x & m == 0 for m in masks)


def test_near_duplicates(spark, odd, documents):
    for docs in (odd, documents):
        rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None), key=lambda r: r[0])
        sets = [set(simhash.shingle_set(t).tolist()) for _, t in rows]
        alike = lambda a, b: (len(a & b) / len(a | b) if a | b else 1.0) >= 0.8
        label = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if rows[i][0] == rows[j][0] or alike(sets[i], sets[j]):
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
        gone = {r[0] for r, x in zip(rows, label) if rows[x][0] != r[0]}
        got = {r["doc_id"] for r in simhash.near_duplicates(spark, docs).collect()}
        assert got <= gone and len(got) >= 0.95 * len(gone)


def exact_families(texts):
    """Least index of the component of each text, over all pairs of a shingle similarity of 0.8."""
    sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return hamming.flat_components(len(texts), np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))


def near_labels(spark, texts):
    kept = {r["doc_id"]: r["kept_id"] for r in simhash.near_duplicates(spark, frame(spark, texts)).collect()}
    return [kept.get(i, i) for i in range(len(texts))]


def test_near_duplicates_of_edited_copies(spark):
    """Appended, cut, with one block replaced, with scattered changes: each pair at 0.8 or just above."""
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        w = words(rng, 400, 20_000).split()
        block = w[:150] + words(rng, 36, 20_000).split() + w[186:]
        scattered = [f"v{i}" if i in (50, 120, 190, 260, 330, 380, 20) else x for i, x in enumerate(w)]
        for copy in (w + words(rng, 80, 20_000).split(), w[:328], block, scattered):
            texts += [" ".join([f"p{len(texts)}", *w[1:]]), " ".join([f"p{len(texts)}", *copy[1:]])]
            w = words(rng, 400, 20_000).split() if copy is scattered else [f"{x}n" for x in w]
    want = exact_families(texts)
    assert near_labels(spark, texts) == want.tolist()


def test_near_duplicates_in_a_loose_family(spark):
    """100 pairs at about 0.85 whose members are at 0.72 or 0.78 to all others."""
    rng = random.Random(12)
    base = words(rng, 400, 20_000).split()
    slots = rng.sample([(p, q) for q in range(1, 24) for p in range(1, q)], 100)
    texts = []
    for p, q in slots + slots:
        w = list(base)
        for s in (p, q):
            w[16 * s + 2 : 16 * s + 14] = words(rng, 12, 20_000).split()
        texts.append(" ".join(w))
    want = exact_families(texts)
    assert want.tolist() == [*range(100), *range(100)]
    assert near_labels(spark, texts) == want.tolist()


def test_components_of_a_long_path(spark):
    rng = random.Random(5)
    names = rng.sample(range(1000), 200)
    edges = spark.createDataFrame([*zip(names, names[1:]), (5000, 5001), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(spark, edges).collect()}
    assert got == {n: min(names) for n in names} | {5000: 5000, 5001: 5000}
    assert components.components(spark, edges.limit(0)).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>no</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li>no<li>menu</ul></nav><div class="cookie-notice">no</div><article><header><h1>Head &amp;  line</h1></header><p>One<b> two<br>three
<p>Four &eacute;<div class="ad">no</div><ul><li>item one<li>item two</ul><form>no</form><table><tr><td>a<td>b</table></article>
<section id="comments"><p>no</p></section><aside>no</aside><footer>no</footer>"""


def test_page_text(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", PAGE), (2, None, None), (3, "http://a.b", ""), (4, "x", "plain <i>text</i>"), (1, "http://a.b/c", PAGE)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(spark, pages).collect()}
    want = "Head & line\n\nOne two three\n\nFour é\n\nitem one\n\nitem two\n\na\n\nb"
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("plain text", 10)}


def test_names_do_not_take_main_text():
    kept = lambda page: [t for _, t, prior in html.blocks(page) if prior >= 0]
    for name in ("layout has-sidebar", "no-sidebar", "sidebar", "page search"):
        assert kept(f"<body><div class='{name}'><article><div class='entry-header'><h1>Head</h1></div><p>Text</article></div>") == ["Head", "Text"]
    anchors = "<article><h2 id='related-work'>A</h2><p>a<section id='search-algorithms'><p>b</section><h2 id='header-compression'>B</h2><section id=comments><p>c</section></article>"
    assert kept(anchors) == ["A", "a", "b", "B", "c"]
    assert kept("<article><p>Text</article><div class='comments'><article>reply</article></div><div class=sidebar><article>card</article></div>") == ["Text"]
    assert kept("<p>Text<div class='ad wide'>no</div><div role=navigation>no</div><div id=cookie-notice>no</div><p hidden>no") == ["Text"]


def test_quotes_and_reader_comments():
    kept = lambda page: [t for _, t, prior in html.blocks(page) if prior >= 0]
    assert kept("<article><p don't>one isn't two</p><p title='a > b' x=\"c > d\">three<p title='open>four</article>") == ["one isn't two", "three", "four"]
    for name in ("comment-section", "user-comments", "reader-comments"):
        assert kept(f"<main><p>Text<div class='{name}'><p>reply</div></main>") == ["Text"]
    begin = time.time()
    html.blocks("<p " + "a='b' " * 50_000)
    assert time.time() - begin < 5


def test_style_tree_removes_what_every_page_repeats(spark):
    rng = random.Random(6)
    page = lambda i: f"<body><div class='x1'>Welcome to our site</div><div class='x2'><p>{words(rng, 30)}</p><p>{words(rng, 20)}</p></div><div class='x3'>All rights</div></body>"
    pages = spark.createDataFrame([(i, "https://u:p@host.example:80/1", page(i)) for i in range(40)] + [(99, "https://other.example/", "<div class='x1'>Welcome to our site</div>")], "page_id long, url string, html string")
    rows = html.extract(spark, pages).collect()
    assert sorted(rows) == sorted(html.extract(spark, pages, broadcast_nodes=0).collect())
    for r in rows:
        assert ("Welcome" in r["text"]) == (r["page_id"] == 99) and "rights" not in r["text"]
        assert r["page_id"] == 99 or r["text"].count("\n\n") == 1


# --- 5 ---------------------------------------------------------------------------------------------------

def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 64))
    near = [x[i] / np.linalg.norm(x[i]) + rng.normal(size=64) * s for i in range(40) for s in (0.01, 0.03, 0.05)]
    hot = [x[0] + rng.normal(size=64) * 0.2 for _ in range(300)]
    x = np.concatenate([x, near, hot, x[:20], x[5:6] * 3]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9001, None, 1), (9002, [0.0] * 64, 1), (9003, [None] * 64, 1), (9004, [float("nan")] * 64, 1), (9005, [1.0, 2.0], 1), (9006, [1.0, 2.0], 1)]
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), chunk=64).collect()}
    assert len(got) == len(rows)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    want = link.sum(1)
    mine = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (mine <= want).all() and mine.sum() >= 0.97 * want.sum()
    label = hamming.flat_components(len(x), *np.nonzero(link))
    assert np.mean([got[i]["component_id"] == label[i] for i in range(len(x))]) > 0.98
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(9001, 9005))
    assert got[9005]["n_links"] == 1 and got[9006]["component_id"] == 9005


def test_quantisation_balances_and_keeps_angles():
    x = np.random.default_rng(1).normal(size=(3000, 32))
    r = embeddings.fit_rotation(x)
    assert np.allclose(r.turn.T @ r.turn, np.eye(32), atol=1e-8)
    bits = (x - r.mean) @ r.turn > 0
    assert abs(bits.mean(0) - 0.5).max() < 0.06


# --- 6 ---------------------------------------------------------------------------------------------------

def test_sharding(spark, odd, documents):
    for docs in (odd, documents):
        got = sharding.shard_records(spark, docs).collect()
        texts = sorted((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
        for s in range(8):
            slots = sorted(r["slot"] for r in got if r["shard"] == s)
            assert slots == list(range(len(slots)))
        assert all(r["grown_shard"] in (r["shard"], 8) and r["law"] == "key" for r in got)
        assert len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})


def test_sharding_weights(spark):
    from pyspark.sql import functions as F

    ids = spark.range(20000)
    got = dict(ids.groupBy(sharding.rendezvous(F.col("id"), [1, 2, 1]).alias("s")).count().collect())
    assert abs(got[1] - 10000) < 400 and abs(got[0] - 5000) < 300
    assert spark.range(0).select(sharding.rendezvous(F.col("id"), [1.0])).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------

def brute_repeats(rows, n=50):
    where = {}
    for i, t in rows:
        if i is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            for s in range(len(w) - n + 1):
                k = tuple(w[s : s + n])
                where[k] = min(where.get(k, i), i)
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for s in range(len(w) - n + 1):
            if i is not None and where[tuple(w[s : s + n])] < i:
                gone |= set(range(s, s + n))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def test_repeats(spark, odd, documents):
    rng = random.Random(7)
    shared = [words(rng, n) for n in (49, 50, 51, 80, 200)]
    mixed = [" ".join(rng.choice([words(rng, rng.randint(1, 60)), rng.choice(shared), "w1 w1", " ".join(["same"] * 70)]) for _ in range(rng.randint(1, 6))) for _ in range(120)]
    for docs in (odd, documents, frame(spark, mixed)):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
        got = [tuple(r)[:4] for r in substrings.remove_repeats(spark, docs).collect()]
        assert sorted(got, key=key) == sorted(brute_repeats(rows), key=key)


# --- 8 ---------------------------------------------------------------------------------------------------

def test_leaks(spark, odd):
    rng = random.Random(10)
    items = [(i, words(rng, rng.randint(8, 70))) for i in range(60)] + [(100, None), (101, ""), (102, "w1 w2")]
    clean = [words(rng, rng.randint(1, 300)) for _ in range(150)]
    leaky = [words(rng, rng.randint(0, 200)) + " " + items[i][1].upper() + " " + words(rng, rng.randint(0, 200)) for i in range(60)]
    changed = []
    for i in range(60):
        w = items[i][1].split()
        if len(w) > 45:
            w[len(w) // 2] = "changed"
            changed.append((i, words(rng, 90) + " " + " ".join(w) + " tail"))
    texts = [None, "", *clean, *leaky, *[t for _, t in changed], words(rng, 70_000) + " " + items[3][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark, frame(spark, texts), bench).collect()}
    at = 2 + len(clean)
    assert {(at + i, i) for i in range(60)} <= got
    assert {(at + 60 + k, i) for k, (i, _) in enumerate(changed)} <= got
    assert (len(texts) - 1, 3) in got and not any(2 <= d < at for d, i in got if i != 102)
    kept = {r["doc_id"] for r in decontaminate.without_leaks(frame(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in got}
    assert decontaminate.contaminated(spark, odd, bench.limit(0)).count() == 0


# --- 9 ---------------------------------------------------------------------------------------------------

def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.selectExpr("doc_id id", "lang"), on=[language.F.col("doc_id") == language.F.col("id")]).where("held_out").collect()
    assert len(got) > 250 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    assert np.mean([r["rejected"] for r in got]) < 0.01


def test_language_clusters(spark):
    for sf in ("sf0.01", "sf0.1"):
        model = language.train(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
        for k, name in enumerate(model.languages):
            mine = model.sizes[model.owner == k]
            assert len(mine) >= 2 and mine.min() >= language.LEAST_SHARE / 2 * mine.sum(), (sf, name, mine)


def test_clusters_find_what_was_mixed():
    rng = np.random.default_rng(4)
    centres = np.eye(4, 200)
    x = np.concatenate([c + rng.normal(0, 0.03, (n, 200)) for c, n in zip(centres, (400, 60, 200, 100))] + [rng.normal(0, 1, (3, 200))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = language._clusters(x, 4)
    assert (np.max(found @ centres.T, axis=0) > 0.97).all()
    assert len(language._clusters(x[:1], 4)) == 1 and len(language._clusters(np.repeat(x[:1], 9, 0), 4)) == 1


def test_language_edges(spark, odd):
    got = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert all(got[i]["lang_pred"] == "und" for i in (0, 1, 2))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(odd.limit(0)).count() == 0
    from pyspark.sql import functions as F

    assert {r["lang_pred"] for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    long = "abc été " * 300_000
    assert language.gram_counts(long).sum() == sum(len(long) - k + 1 for k in language.GRAMS)


# --- 10 --------------------------------------------------------------------------------------------------

def check_packing(rows, docs):
    pieces, room = {}, {}
    for r in rows:
        pieces.setdefault(r["row"], []).append(r)
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], zlib.crc32(np.array([*whole_ids(r["text"]), 2], "<u4").tobytes())) for r in docs)
    assert len(pieces) == len(want)
    for ps in pieces.values():
        ps.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in ps] == list(range(len(ps))) and [p["start"] for p in ps] == [sum(q["length"] for q in ps[:k]) for k in range(len(ps))]
        assert all(p["length"] == 1024 for p in ps[1:]) and 0 < ps[0]["length"] <= 1024
    for at in room.values():
        at.sort()
        assert [o for o, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))] and sum(n for _, n in at) <= 1024
    return len(room), sum(r["length"] for r in rows)


@pytest.mark.parametrize("per_task", [100_000, 60])
def test_packing(spark, odd, documents, per_task):
    for docs in (odd, documents):
        pieces = packing.token_pieces(docs, tokenizer_path())
        n, total = check_packing(packing.pack(spark, pieces, items_per_task=per_task).collect(), docs.collect())
        assert n <= -(-total // 1024) * 1.12 + 1


def test_best_fit():
    sizes = np.array([600, 424, 500, 500, 24, 1, 1024])
    place, offset = packing.best_fit(sizes, 1024)
    assert place.max() + 1 == 4 and np.bincount(place, sizes).max() <= 1024
    assert packing.pack  # empty tables are covered below


def test_packing_hands_up_enough(spark):
    """20 sequences of one fill in one task, a small one that fits in a task of the next, second and third level."""
    from pyspark.sql import functions as F

    at = spark.range(2000).select("id", F.pmod(F.xxhash64("id", F.lit(0)), F.lit(8)).alias("task")).collect()
    rows = {t: [r["id"] for r in at if r["task"] == t] for t in range(8)}
    items = [(i, 700) for i in rows[0][:20]] + [(rows[t][0], 300) for t in (1, 2, 4)]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
    pieces = spark.createDataFrame([(i, 0, 0, n, 0, i) for i, n in items], schema)
    out = packing.pack(spark, pieces, fan_in=2, items_per_task=3).collect()
    assert len(out) == 23 and len({r["sequence_id"] for r in out}) == 20
    assert sum(r["fill"] == 1000 for r in out) == 6


def test_stages_release_kept_tables(spark):
    """A stage without an encoder empties the encoders that an earlier stage left in the worker; a stage of words keeps the word hashes."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from fadewell.llm import shared

    docs = spark.createDataFrame([(i, "plain words here", "en") for i in range(640)], "doc_id long, text string, lang string").repartition(64)
    model = language.train(docs)
    bench = spark.createDataFrame([(1, "one item of six plain words")], "item_id long, text string")

    def left(x):
        return pa.array([[len(shared.KEPT_TABLES[0]), len(shared.KEPT_TABLES[1])]] * len(x), pa.list_(pa.int64()))

    def encode(x):
        return pa.array([len(b) for b in encoder(tokenizer_path()).ids(x.to_pylist())], pa.int64())

    def by_arrow(fn, kind):
        return F.arrow_udf(fn, kind, F.ArrowUDFType.SCALAR)

    stages = {
        "language": lambda d: d.where(language.classified(model, F.col("text"))["lang_pred"] != ""),
        "secrets": lambda d: d.withColumn("text", secrets.redacted(F.col("text"))),
        "leaks": lambda d: decontaminate.without_leaks(d, bench),
    }
    for name, stage in stages.items():
        docs.select(F.sum(by_arrow(encode, "long")("text"))).collect()
        stage(docs).select(F.sum(F.length("text"))).collect()
        held = [r["n"] for r in docs.select(by_arrow(left, "array<long>")("doc_id").alias("n")).collect()]
        assert not any(encoders for _, encoders in held), name
        assert any(words for words, _ in held) == (name == "leaks")


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert packing.pack_documents(spark, none, tokenizer_path()).count() == 0
    assert simhash.fingerprint_groups(spark, none).count() == 0 and simhash.near_duplicates(spark, none).count() == 0
    assert substrings.remove_repeats(spark, none).count() == 0 and secrets.secret_spans(none).count() == 0
    assert sharding.shard_records(spark, none).count() == 0
    assert embeddings.near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html.extract(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.schema.names == docs.schema.names
        kept = spark.createDataFrame(after.collect(), docs.schema)
        assert 0.7 * docs.count() < kept.count() <= docs.count(), name
    rows = kept.collect()
    assert not any(brute_spans(r["text"]) for r in rows)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in rows}


def test_stages_keep_clashing_columns(spark, odd):
    import corpus_pipeline

    extra = ("gone_id", "GONE_ID_", "items", "rejected", "near", "item_id")
    docs = odd.selectExpr("*", *(f"{i} `{c}`" for i, c in enumerate(extra)))
    want = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, odd, SF).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert {r["doc_id"] for r in kept} == want and all(r["gone_id"] == 0 for r in kept)
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() > 0


def test_lone_shingles_bound_the_pairs_of_a_family_and_lose_none(spark):
    import numpy as np

    from fadewell.llm import simhash

    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):  # every copy has its own edits, from none to many
        words = list(base)
        for at in rng.choice(120, i // 6, replace=False):
            words[at] = f"x{i}n{at}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame([*texts, (100, "a b c d e f"), (100, "g h i j k l"), (101, None)], "doc_id long, text string")
    sets = {i: set(simhash.shingle_set(t).tolist()) for i, t in texts}
    found = {r["id"]: r["alone"] for r in simhash.lone_shingles(docs.withColumnRenamed("doc_id", "id"), 5).collect()}
    want = {i: len(s - set().union(*(o for j, o in sets.items() if j != i))) for i, s in sets.items()}
    assert found == {i: n for i, n in want.items() if n}
    label = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    gone = {r["doc_id"]: r["kept_id"] for r in simhash.near_duplicates(spark, docs).collect()}
    assert gone == {i: c for i, c in label.items() if i != c}


def test_edits_that_two_copies_share_make_no_pairs_of_a_family(spark, monkeypatch):
    """30 couples of one family at about 0.55; each couple's edits are its own, so no shingle of them is alone."""
    rng = random.Random(13)
    base = words(rng, 400, 20_000).split()
    texts = []
    for _ in range(30):
        w = list(base)
        for s in rng.sample(range(20), 3):
            w[20 * s + 2 : 20 * s + 18] = words(rng, 16, 20_000).split()
        for n in range(2):
            texts.append(" ".join([*w[:200], f"own{len(texts)}", *w[200:]]) if n else " ".join(w))
    want = exact_families(texts)
    assert want.tolist() == [i - i % 2 for i in range(60)]
    written, plain = {}, simhash.scratch

    def counted(spark, df, name):
        out = plain(spark, df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "scratch", counted)
    assert near_labels(spark, texts) == want.tolist()
    assert written["pairs"] + written.get("stars", 0) <= 60


def test_owner_sets_count_the_shingles_of_few_texts(spark):
    rng = random.Random(14)
    texts = [(i % 11, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))) for i in range(12)]
    docs = spark.createDataFrame([*texts, (50, "a b c d e"), (51, None)], "id long, text string").repartition(5)
    owners = {}
    for i, t in [*texts, (50, "a b c d e")]:
        for h in simhash.shingle_set(t).tolist():
            owners.setdefault(h, []).append(i)
    for most in (1, 2, 3, 8):
        want = {}
        for ids in owners.values():
            if len(ids) <= most:
                key = tuple(sorted(set(ids)))
                want[key] = want.get(key, 0) + 1
        got = {tuple(r["ids"]): r["shingles"] for r in simhash.owner_sets(docs, 5, most).collect()}
        assert got == want and want
        rare = {r["id"]: r["rare"] for r in simhash.rare_shingles(simhash.owner_sets(docs, 5, most), docs).collect()}
        each = {i: sum(n for ids, n in want.items() if i in ids) for i in range(1, 51)}  # id 0 has two texts
        assert rare == {i: n for i, n in each.items() if n}


def test_training_holds_the_wide_vectors_of_one_language_at_a_time(spark):
    import tracemalloc

    words = {"aa": "alpha beta gamma", "bb": "delta epsilon zeta", "cc": "theta iota kappa", "dd": "mu nu xi"}
    docs = spark.createDataFrame([(i, f"{words[lang]} {i * 37 % 101:b} {'abcdefgh'[i % 8]}", lang) for lang in words for i in range(list(words).index(lang) * 300, list(words).index(lang) * 300 + 300)],
                                 "doc_id long, text string, lang string")
    tracemalloc.start()
    try:
        model = language.train(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.languages == tuple(words) and model.sizes.sum() >= 1100
    assert peak < 1200 * language.DIMENSIONS * 16  # all texts as doubles twice


def test_workers_that_wait_hold_no_words(spark):
    """After packing with keep_words=False the encoder stays in each worker without its table; the pieces are the same."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"plain words here {i}") for i in range(640)], "doc_id long, text string").repartition(64)
    where = tokenizer_path()

    def held(x):
        return pa.array([len(encoder(where).kept)] * len(x), pa.int64())

    rows = {}
    for keep in (True, False):
        rows[keep] = {tuple(r)[:5] for r in packing.token_pieces(docs, where, keep_words=keep).collect()}
        words = [r["n"] for r in docs.select(F.arrow_udf(held, "long", F.ArrowUDFType.SCALAR)("doc_id").alias("n")).collect()]
        assert any(words) == keep
    assert rows[True] == rows[False] and len(rows[True]) == 640
