"""The training-data operators against brute force, on small fixtures with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import licenses, minhash, mixing, packing, quality, records, repeats, search, text, toxicity, urls
from orrery.llm import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, n_words string"


def base_text(seed, n):
    rng = np.random.Generator(np.random.PCG64(seed))
    return " ".join("".join(rng.choice(list("abcdeéñ"), rng.integers(2, 8))) for _ in range(n))


def rows():
    a, b = base_text(1, 60), base_text(2, 80)
    w = a.split()
    near = " ".join(w[:30] + ["changed"] + w[31:])
    texts = [(5, a), (9, a), (7, near), (3, None), (4, ""), (6, " \n\t "), (8, b + "\n" + a), (10, "one two"), (11, "One  TWO"), (12, b), (None, a), (2, base_text(3, 3000)), (12, b)]
    texts += [(20 + i, base_text(10 + i, 25)) for i in range(6)]
    return [(i, t, "en", f"src{(i or 0) % 3}" if i != 4 else None, len(t or ""), "x", "y", "z") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(t, n=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(pairs):
    ids = sorted({i for i, _ in pairs if i is not None})
    sets = {}
    for i, t in pairs:
        sets.setdefault(i, shingles(t))
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_minhash_against_all_pairs(docs, empty):
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert minhash.near_duplicates(empty).count() == 0


def exact_components(pairs):
    """Components by an inverted index of all shingles: common shingles of every pair of texts counted in full."""
    sets = {i: shingles(t) for i, t in pairs}
    postings, parent = {}, {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in sorted(sets):
        common = Counter(j for x in sets[i] for j in postings.get(x, ()))
        for j, both in common.items():
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in sets[i]:
            postings.setdefault(x, []).append(i)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_minhash_against_an_exact_join_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    components, sizes = exact_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {i: (components[i], sizes[i]) for i in components}


@pytest.mark.parametrize("block", [1 << 16, 500])
def test_minhash_of_a_large_family(spark, monkeypatch, block):
    """One large family of near copies around the threshold, in one or many blocks and turns."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    rng = np.random.Generator(np.random.PCG64(11))
    base = base_text(77, 70).split()
    pairs = []
    for i in range(120):
        w = list(base)
        for at in rng.choice(70, int(rng.integers(0, 4)), replace=False):
            w[at] = f"x{i}y{at}"
        pairs.append((i, " ".join(w)))
    pairs += [(500 + i, base_text(600 + i, 30) + " " + " ".join(base[:40])) for i in range(60)] + [(900, base_text(12, 12_000))]
    components, _ = exact_components(pairs)
    got = minhash.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == components


def test_minhash_families_at_the_threshold(spark):
    """Copies with edits whose similarities lie around 0.75, many of them linked only in chains."""
    rng = np.random.Generator(np.random.PCG64(7))
    w = base_text(4, 120).split()
    pairs = []
    for i in range(150):
        v = list(w)
        for k in rng.integers(0, len(w), rng.integers(0, 8)):
            v[k] = f"edit{rng.integers(0, 40)}"
        pairs.append((i, " ".join(v)))
    want = brute_components(pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert got == want


def test_sketches_are_mergeable_and_estimate():
    rng = np.random.Generator(np.random.PCG64(5))
    pool = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    a, b = pool[:1000], pool[500:]
    ra, rb = minhash.registers(a), minhash.registers(b)
    assert (np.maximum(ra, rb) == minhash.registers(np.union1d(a, b))).all()
    grid = np.linspace(0, 1, 201)
    ll = minhash.log_likelihoods([1000], [1000], [(ra > rb).sum()], [(ra < rb).sum()], grid)
    assert abs(grid[ll[0].argmax()] - 1 / 3) < 0.15


def test_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"abcabcabc", np.uint8)
    p = text.prefix_hash(data)
    h = text.span_hash(p, np.array([0, 3, 6, 1]), np.array([3, 6, 9, 4]))
    assert h[0] == h[1] == h[2] != h[3]


def brute_repeats(pairs, length):
    seen, out = set(), {}
    for i, t in sorted({(i if i is not None else 2**63, t or "") for i, t in pairs}):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("windows, names", [(500_000, 4_000_000), (1, 4_000_000), (500_000, 0)])
def test_repeats_against_all_windows(docs, empty, monkeypatch, windows, names):
    monkeypatch.setattr(repeats, "MAX_WINDOWS", windows)
    monkeypatch.setattr(repeats, "FILTER_NAMES", names)
    want = brute_repeats([(r.doc_id, r.text) for r in docs.collect()], 100)
    for r in repeats.remove_repeats(docs).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id if r.doc_id is not None else 2**63], r.doc_id
    assert repeats.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("windows", [500_000, 100])
@pytest.mark.parametrize("length", [64, 65, 100, 160, 200, 400, 1000])
def test_repeats_of_any_length(spark, monkeypatch, length, windows):
    """Passages around the length, in changing surroundings, shifted, inside periods and in long texts."""
    monkeypatch.setattr(repeats, "MAX_WINDOWS", windows)
    monkeypatch.setattr(repeats, "FLUSH", 1000)
    rng = np.random.Generator(np.random.PCG64(length))
    passage = base_text(1, length)
    data = passage.encode()[: length + 40].decode(errors="ignore")
    pairs = [(0, base_text(50, 9000))]
    for i in range(1, 14):
        at = int(rng.integers(0, 60))
        size = length + int(rng.integers(-3, 40))
        pairs.append((i, base_text(100 + i, 30) + data[at : at + size] + base_text(200 + i, 20)))
    pairs += [(20, "ab" * length), (21, "x" + "ab" * (length // 2 + 30)), (22, pairs[0][1][5000:9000]), (23, pairs[3][1] + pairs[4][1])]
    want = brute_repeats(pairs, length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(spark.createDataFrame(pairs, "doc_id long, text string"), length).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_ranks_across_ranges(spark, monkeypatch):
    """Pairs that fill several ranges, that end with one and that begin with one."""
    monkeypatch.setattr(repeats, "RANGE_ROWS", 7)
    rng = np.random.Generator(np.random.PCG64(6))
    rows = [(int(r), int(a), i, 0, int(rng.integers(0, 3)), [i]) for i, (r, a) in enumerate(zip(rng.integers(0, 9, 90), rng.integers(0, 4, 90), strict=True))]
    rows += [(3, 3, 1000 + i, 0, i, [7]) for i in range(60)]
    got = repeats._ranked(spark.createDataFrame(rows, "rank long, at long, doc long, th long, s int, next array<long>")).collect()
    groups = {}
    for r, a, *place, _ in rows:
        groups.setdefault((r, a), []).append(tuple(place))
    often = {p: min(many) for many in groups.values() if len(many) > 1 for p in many}
    assert {(r.doc, r.th, r.s): r.later for r in got} == {p: p != first for p, first in often.items()}
    ranks = {}
    for r in got:
        ranks.setdefault(often[r.doc, r.th, r.s], set()).add(r["rank"])
    assert all(len(x) == 1 for x in ranks.values()) and len(set.union(*ranks.values())) == len(ranks)


def test_doubling_rounds():
    assert repeats.schedule(100) == [(32, 64), (36, 100)]
    assert repeats.schedule(64) == [(32, 64)]
    assert repeats.schedule(400) == [(32, 64), (64, 128), (128, 256), (144, 400)]


def test_repeats_inside_one_text_and_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    t = base_text(6, 80)
    pairs = [(1, t + " and " + t), (2, "x" * 500), (3, t[100:400] + "y" * 120)]
    want = brute_repeats(pairs, 100)
    for r in repeats.remove_repeats(spark.createDataFrame(pairs, "doc_id long, text string")).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_repeats_keep_ids_apart(spark):
    t, u = base_text(8, 60), base_text(9, 60)
    got = repeats.remove_repeats(spark.createDataFrame([(1, t), (1, u), (1, t), (2, t + " " + u)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in got if r.doc_id == 1] == [0, 0, 0]
    assert next(r.n_removed for r in got if r.doc_id == 2) >= len(t.encode()) + len(u.encode())


def test_search_against_brute_force(spark):
    rng = np.random.Generator(np.random.PCG64(11))
    x = np.round(rng.normal(size=(300, 8)), 1)
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [0.0] * 8)]
    v = search.quantized(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in search.top_k(v, F.col("vec_id") % 20 == 0, 7).collect()}
    q = np.floor(64 * x.astype(np.float32).astype(float)).astype(int)
    for i in range(0, 300, 20):
        order = sorted(((-int(q[i] @ q[j]), j) for j in range(300) if j != i))[:7]
        assert [got[i, k + 1] for k in range(7)] == [(j, -s) for s, j in order]
    assert len(got) == 15 * 7
    assert search.top_k(v.where("vec_id < 0"), F.lit(True), 7).count() == 0
    assert search.top_k(v.where("vec_id < 3"), F.col("vec_id") == 0, 7).count() == 2


@pytest.mark.parametrize("ranges, block, chunk", [(8192, 512, 2048), (40, 3, 10)])
def test_search_with_repeated_rows_and_ties(spark, monkeypatch, ranges, block, chunk):
    monkeypatch.setattr(search, "RANGE_ROWS", ranges)
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    monkeypatch.setattr(search, "CHUNK", chunk)
    rng = np.random.Generator(np.random.PCG64(13))
    data = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 3.0]), (1, [1.0, 1.0])] + [(int(i), [float(v) for v in rng.integers(-2, 3, 2)]) for i in rng.integers(0, 90, 200)]
    table = spark.createDataFrame([(*d, "x", 1) for d in data], "vec_id long, embedding array<double>, row string, rank int")
    got = Counter(tuple(r) for r in search.top_k(search.quantized(table, scale=1.0), F.col("vec_id") % 20 == 0, 20).collect())
    want = Counter()
    for i, (q, x) in enumerate(data):
        if q % 20 == 0:
            best = sorted((-int(x[0] * y[0] + x[1] * y[1]), c) for j, (c, y) in enumerate(data) if j != i)[:20]
            want.update((q, k + 1, c, -s) for k, (s, c) in enumerate(best))
    assert got == want


def test_search_bounds_hold():
    rng = np.random.Generator(np.random.PCG64(12))
    a, b = rng.normal(size=(20, 16)), rng.normal(size=(30, 16))
    last = np.zeros((20, 30))
    true = ((a[:, None] - b[None]) ** 2).sum(-1)
    for s in search.SEGMENTS[:4]:
        x, y = search.statistics(a, s), search.statistics(b, s)
        low = ((x[:, None] - y[None]) ** 2).sum(-1)
        assert (low <= true + 1e-9).all() and (low >= last - 1e-9).all()
        last = low


def test_url_rules(spark):
    data = [
        (1, "http://A.example.ORG/es/1?x=/en/1"), (2, "https://example.org/en/12#y"), (3, "http://x.org"), (4, "http://x.com/fr/1"), (5, "http://com/de/"),
        (6, None), (7, "no scheme"), (8, "http://notorg/x"), (9, "http://y.net/de/5"), (9, "http://y.net/de/5"), (10, "http://myexample.org/es/"), (11, "a://b://c/d"),
    ]
    data += [(100 + i, f"http://h{i % 5}.com/de/{i}") for i in range(40)] + [(200 + i, f"http://h{i % 5}.org/it/{i}") for i in range(40)]
    df = spark.createDataFrame([(i, u, "z") for i, u in data], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3][:2] == ("x.org", "") and got[3][2] is None
    assert got[4][2:] == ("com/fr/", "allow") and got[5] == ("com", "/de/", "com/de/", "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2] is None and got[10][2:] == ("org/", "allow") and got[11][:2] == ("b:", "//c/d")
    assert got[9][3] == "block"  # learned: de => block
    assert urls.filter_urls(df).count() == len(data) and urls.filter_urls(df.limit(0)).count() == 0
    only = urls.filter_urls(df.where("page_id = 9"))
    assert [r.verdict for r in only.collect()] == ["allow", "allow"]


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_quality_counts(spark, docs, empty):
    more = ["a\na\n a\na", "# * b|c <x>", "w " * 30, " ".join(f"w{i % 9}" for i in range(40)), "\x0bx\x0c y", "a\u00a0b\u2003c"]
    df = docs.select("doc_id", "text", "kept").union(spark.createDataFrame([(900 + i, t, "") for i, t in enumerate(more)], "doc_id long, text string, kept string"))
    for r in quality.judge(df).collect():
        want = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and not r.failed)
    assert quality.judge(empty).count() == 0


def test_licenses(spark, docs, empty):
    mit = licenses.TEMPLATES[0][3]
    w = mit.split()
    edited = " ".join(w[:20] + ["really"] + w[20:35] + w[37:])
    data = [(1, mit.upper()), (2, "intro " * 30 + edited + " tail" * 9), (3, "the MIT license, mit-License and cc by by CC  BY"), (4, None), (5, ""), (6, " ".join(w[:9])), (None, "Apache License"), (1, mit.upper()), (7, "mıt license \u212Akcc by"), (8, "gnu general public licenses")]
    df = spark.createDataFrame([(i, t, "q") for i, t in data], "doc_id long, text string, labels string")
    got = {(r.doc_id): r for r in licenses.scan(df).collect()}
    assert got[1].labels == got[2].labels == "mit" and got[1].base_labels == "" and got[1].score == 1.0 and 0.6 <= got[2].score <= 1
    r = got[3]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (11, 4, 1, 9, "cc-by,mit")
    assert (got[4].n_words, got[4].first_word, got[4].labels, got[4].score) == (0, None, "", 0.0)
    assert got[6].labels == "" and got[None].labels == "apache" and got[7].n_base == 0 and got[8].n_base == 0
    assert licenses.scan(df).count() == len(data) and licenses.scan(empty).count() == 0


PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_records_round_trip(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    out = str(tmp_path / "r")
    got = records.token_records(spark, docs, PATH, out).collect()
    want, at = [], 0
    for i, x in sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    data = (tmp_path / "r").glob("*.rec")
    for f in data:
        offsets = np.frombuffer(f.with_suffix(".idx").read_bytes(), "<u8")
        with f.open("rb") as source:
            every = [records.parse(p) for p in records.frames(source)]
            for k in reversed(range(len(offsets))):
                doc_id, ids = records.read_at(source, int(offsets[k]))
                assert doc_id == every[k][0] and (ids == every[k][1]).all()
        raw = bytearray(f.read_bytes())
        raw[14] ^= 1
        f.write_bytes(raw)
        with f.open("rb") as source, pytest.raises(ValueError, match="checksum"):
            list(records.frames(source))
    assert records.token_records(spark, empty, PATH).count() == 0


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    texts = ["a quick  brown fox\njumps", "", None, base_text(1, 200), " x\t y "]
    whole = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [list(ids) for ids in records.encode(texts, path)] == whole
    assert records.WordEncoder(PATH).apart and records.WordEncoder(PATH).short


def test_a_very_long_text_is_dealt_to_several_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 8)
    table = spark.createDataFrame([(1, "w " * 30_000, "a"), (2, "v " * 100, "b")], "doc_id long, text string, source string")
    got = packing.pack(table, capacity=1000).collect()
    assert len({r.shard for r in got}) == 4 and sum(r["size"] for r in got) == 30_100


def test_word_cache_equals_the_tokenizer(monkeypatch):
    monkeypatch.setattr(records, "CACHED_WORDS", 10)
    e = records.WordEncoder(PATH)
    texts = ["don't WE'LL x'. 12,3. ẞ q", "a bé éa ΣΑΣ İx \t y\x1cz <|endoftext|>", "Über, é́ ǅ 中文 한글. ..", "", None, "A\u0301b a.b ,"]
    for _ in range(2):
        for t, ids in zip(texts, e.encode(texts), strict=True):
            assert ids.tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_packing(docs, empty, spark):
    df = docs.select("doc_id", "text", "source").union(spark.createDataFrame([(500 + i, base_text(50 + i % 7, 5 + i % 40), None if i % 5 == 0 else f"src{i % 4}") for i in range(200)], "doc_id long, text string, source string"))
    got = packing.pack(df, capacity=64).collect()
    bins = {}
    for r in got:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for items in bins.values():
        assert sum(r["size"] for r in items) <= 64
        for key in ("source", "cluster"):
            known = [r[key] for r in items if r[key] is not None]
            assert len(known) == len(set(known))
        spans = sorted((r.offset, r.offset + r["size"]) for r in items)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    want = Counter()
    for r in df.collect():
        want[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    have = Counter()
    for r in got:
        have[r.doc_id] += r["size"]
    assert have == want and packing.pack(empty).count() == 0


def test_packing_is_best_fit():
    """Each item goes to the tightest compatible bin of a plain search."""
    rng = np.random.Generator(np.random.PCG64(3))
    size = np.sort(rng.integers(0, 40, 300))[::-1]
    source, cluster = [f"s{x}" for x in rng.integers(0, 6, 300)], [f"c{x}" for x in rng.integers(0, 200, 300)]
    got, _ = packing.pack_shard(size, source, cluster, 50)
    room, held = [], []
    for i in range(300):
        fit = sorted((room[b], b) for b in range(len(room)) if room[b] > 0 and room[b] >= size[i] and source[i] not in held[b] and cluster[i] not in held[b])
        b = fit[0][1] if fit else len(room)
        if not fit:
            room.append(50)
            held.append(set())
        room[b] -= size[i]
        held[b] |= {source[i], cluster[i]}
        assert got[i] == b


def brute_mix(rows, shards, seed, block):
    """Targets by sharing again, then blocks and draws by their hashes: {(doc_id, text): (size, source_size, target,
    [(copy, words)])}; ids are unique."""
    md5 = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    words = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(words.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * words[s]}
        target |= {s: 2.0 * words[s] for s in full} if full else {s: weight[s] * level for s in open_}
        left -= sum(2.0 * words[s] for s in full)
        open_ = open_ - full if full else set()
    out = {}
    for sid, s in enumerate(names):
        h = {i: int(md5(seed, i, t or "")[:15], 16) for i, t, x in rows if x == s}
        n = max(1, -(-words[s] // block))
        quota, blocks, takes = int(target[s] + 1e-6), {}, {i: [] for i in h}
        for i in sorted(h, key=h.get):
            if size[i]:
                blocks.setdefault(h[i] % n, []).append(i)
        for copy in range(2):
            for b in sorted(blocks, key=lambda b: md5(seed, copy, sid, b)):
                for i in blocks[b]:
                    got = min(size[i], quota)
                    quota -= got
                    if got:
                        takes[i].append((copy, got))
        out |= {i: (size[i], words[s], target[s], takes[i]) for i in h}
    return out


@pytest.mark.parametrize("block", [16, 1024])
def test_mixing_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "LEAF_ROWS", 2)
    rng = np.random.Generator(np.random.PCG64(8))
    rows = [(i, base_text(i, int(rng.integers(0, 60))), f"s{int(rng.integers(0, 5)) // 2}" if i % 11 else None) for i in range(120)] + [(500, None, "s0"), (501, " ", "s1"), (502, base_text(7, 5000), "s2")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(table, shards=7).collect()}
    want = brute_mix(rows, 7, 9, block)
    assert set(got) == set(want)
    for i, (size, source_size, target, takes) in want.items():
        r = got[i]
        assert (r["size"], r.source_size, r.taken) == (size, source_size, sum(w for _, w in takes))
        assert r.target == pytest.approx(target)
        assert [(t["copy"], t.words) for t in r.takes] == takes
    by_seed = mixing.mix(table, shards=7, seed=10).collect()
    assert {(r.doc_id, r.taken) for r in by_seed} != {(i, r.taken) for i, r in got.items()}
    assert {(r.doc_id, r.target) for r in by_seed} == {(i, r.target) for i, r in got.items()}


def test_shards_draw_disjoint_ranges(spark, monkeypatch):
    quotas = {0: 1000, 1: 17, 2: 0, 5000: 333}
    table = spark.createDataFrame(list(quotas.items()), "sid int, n long")
    one = sorted(tuple(r) for r in mixing.shard_draws(table, 37, 3).collect())
    monkeypatch.setattr(mixing, "TREE_TOP", 4)
    assert sorted(tuple(r) for r in mixing.shard_draws(table, 37, 3).collect()) == one
    for sid, n in quotas.items():
        drawn = [d for s, _, first, k in one if s == sid for d in range(first, first + k)]
        assert sorted(drawn) == list(range(n))
    assert {s for _, s, _, _ in one} == set(range(37))
    assert sorted(tuple(r) for r in mixing.shard_draws(table, 37, 4).collect()) != one


def test_mixing(docs, empty, spark):
    got = mixing.mix(docs, shards=4).collect()
    assert len(got) == docs.count()
    assert all(r.taken == sum(t.words for t in r.takes) <= 2 * r["size"] for r in got)
    assert {t.shard for r in got for t in r.takes} <= set(range(4))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.taken, [(t["copy"], t.words, t.shard, t.place) for t in r.takes])
    again = mixing.mix(docs.repartition(3), shards=4).collect()
    assert sorted(map(key, again)) == sorted(map(key, got))
    clash = docs.selectExpr("doc_id", "text", "source", "1 as target", "2 as sid", "3 as block", "4 as h", "5 as draw", "6 as of", "7 as node")
    kept = mixing.mix(clash, shards=4, keep_rows=True)
    assert kept.columns == ["doc_id", "text", "source", "sid", "block", "h", "draw", "of", "node", *mixing.MADE]
    assert sorted((r.doc_id or -1, r.taken) for r in kept.collect()) == sorted((r.doc_id or -1, r.taken) for r in got)
    # rows equal in id and text take equal parts, whatever else they hold
    twins = spark.createDataFrame([(1, "a b c d e f", s, k) for s in ("x", "y") for k in range(8)] + [(2, base_text(1, 500), "z", 0)], "doc_id long, text string, source string, k int")
    got = mixing.mix(twins, keep_rows=True).collect()
    assert all(len({r.taken for r in got if r.source == s}) == 1 for s in ("x", "y"))
    assert mixing.mix(empty).count() == 0 and mixing.mix(empty, keep_rows=True).count() == 0


def test_targets_by_sharing_again(spark):
    data = [("a", 10), ("b", 1000), ("c", 40), ("d", 7), (None, 300), ("e", 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(data, "source string, words long")).collect()}
    order = sorted((s for s, _ in data if s), key=str) + [None]
    size, weight = dict(data), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = dict.fromkeys(size, 0.0), set(size), 1.5 * sum(size.values())
    while rest > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        share, rest = rest, 0.0
        for s in list(open_):
            target[s] += share * weight[s] / w
        for s in list(open_):
            if target[s] > 2 * size[s]:
                rest += target[s] - 2 * size[s]
                target[s] = 2 * size[s]
                open_.discard(s)
    assert all(abs(got[s] - target[s]) < 1e-6 for s in size)


def test_splitting_tree_is_exact():
    q = np.array([100, 7, 0, 993])
    nodes = list(mixing.split_quotas(q, np.zeros(4, np.int64), 0, 8, 1, 1))
    m = np.array([have for _, _, have, _ in nodes])
    assert (m.sum(0) == q).all() and m.sum(1).max() - m.sum(1).min() <= 3 and (m >= 0).all()
    assert [at for at, _, _, _ in nodes] == list(range(8)) and (np.cumsum(m, 0) - m == np.array([first for _, _, _, first in nodes])).all()


def test_levenshtein_trie():
    lex = toxicity.Lexicon({("idiot", False): 2.0, ("rotten", True): 3.0, ("bad", False): 1.0})

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    for w in ["idiot", "idiott", "idot", "1diot", "diot", "ideot", "idoit", "idiotic", "bad", "bat", "rottenest", "rotten", "rotte", "xidiot", ""]:
        found = lex.match(w)
        if w == "idiot" or w == "bad" or w.startswith("rotten"):
            assert found and found[1], w
        else:
            assert bool(found) == (distance(w, "idiot") <= 1), w


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def brute_match(terms, w):
    """The best weight of a term spelled exactly (a stem: the word begins with it), else of one within an edit."""
    exact = [v for (t, is_stem), v in terms.items() if (w.startswith(t) if is_stem else w == t)]
    if exact:
        return max(exact), True
    near = [v for (t, is_stem), v in terms.items() if not is_stem and len(t) >= toxicity.FUZZY_TERM and edits(w, t) <= 1]
    near += [v for (t, is_stem), v in terms.items() if is_stem and len(t) >= toxicity.FUZZY_STEM and any(edits(w[:k], t) <= 1 for k in range(len(w) + 1))]
    return (max(near) * toxicity.FUZZY_WEIGHT, False) if near else None


def brute_features(text, terms):
    lower = text.lower()
    spans = [m.span() for m in re.finditer(r"[^\W_]+", lower)]
    words = [lower[a:b] for a, b in spans]
    hits = [(i, brute_match(terms, w)) for i, w in enumerate(words)]
    weights = {}
    for i, m in hits:
        if m:
            value, around = m[0], words[max(0, i - 8) : i + 9]
            before, after = lower[spans[max(0, i - 8)][0] : spans[i][0]], lower[spans[i][1] : spans[min(len(words) - 1, i + 8)][1] + 1]
            quoted = sum(c in toxicity.OPENING for c in before) % 2 == 1 or before[-1:] and before[-1] in toxicity.OPENING
            value *= 0.4 if quoted and any(c in after for c in toxicity.CLOSING) else 1
            value *= 0.6 if toxicity.REPORTING & set(around) else 1
            value *= 1.2 if toxicity.ADDRESS & set(around) else 1
            weights[i] = value
    total, exact = sum(weights.values()), sum(1 for _, m in hits if m and m[1])
    window = max((sum(v for j, v in weights.items() if i <= j <= i + 16) for i in weights), default=0)
    return [np.log1p(x) for x in (total, window, exact, len(weights) - exact, 100 * total / (len(words) + 50))]


def test_features_against_brute_force():
    terms = {("idio", True): 2.0, ("idiots", False): 6.0, ("scum", False): 3.0, ("pathetic", False): 4.0, ("worthles", True): 2.5, ("trash", False): 1.5}
    lex = toxicity.Lexicon(terms)
    assert lex.match("idiots") == (6.0, True) and lex.match("idiotic") == (2.0, True)
    pool = [*"idiots idiot idiotic 1diots idios scum scums scm pathetic pathetik pathet worthless worhless wortless w0rthlessly trash trach tash you said quote word".split(), *base_text(4, 30).split()]
    for w in pool:
        assert lex.match(w) == brute_match(terms, w), w
    rng = np.random.Generator(np.random.PCG64(5))
    for k in range(300):
        words = [str(rng.choice(pool)) for _ in range(int(rng.integers(1, 70)))]
        text = "".join(w + str(rng.choice([" ", " ", " ", ' "', '" ', " “", "” ", ". ", "_"])) for w in words)
        got = toxicity.features(text, lex)[0]
        assert np.allclose(got, brute_features(text, terms)), (k, text)


def test_copied_words_and_long_texts(spark):
    """A text of many copies counts once; repeated rows, long texts and clashing columns keep their rows."""
    clean = [(i, base_text(2000 + i, 30), 0) for i in range(200)]
    bad = [(1000 + i, base_text(3000 + i, 15) + " grumfel " + base_text(4000 + i, 15), 1) for i in range(60)]
    copies = [(2000 + i, "unlucky bystander words " + clean[0][1], int(i < 20)) for i in range(50)]
    rows = clean + bad + copies
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), labels)
    assert ("grumfel", False) in model.lexicon and not any(t.startswith(("unlucky", "bystander")) for t, _ in model.lexicon)
    long = base_text(9, 20_000) + " grumfel" * 50
    table = spark.createDataFrame([(1, long, "a"), (1, long, "b"), (2, None, "c")], "doc_id long, text string, predicted string")
    got = toxicity.score(table, model).collect()
    assert len(got) == 3 and sorted(r.predicted for r in got) == [0, 1, 1]


def test_context_lowers_quotations():
    lex = toxicity.Lexicon({("idiot", False): 4.0})
    plain = toxicity.features("you are an idiot today", lex)[0]
    quoted = toxicity.features('the term "idiot" was quoted in the report', lex)[0]
    assert plain[0] > quoted[0] > 0 and toxicity.features(None, lex)[0] == [0.0] * 5


def test_toxicity_held_out(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    data, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = base_text(1000 + i, 40).split()
        if bad:
            for k in rng.integers(0, 40, 3):
                w[k] = str(rng.choice(["grumfel", "vexoid", "stupid"]))
        data.append((i, " ".join(w), "en"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*data, (900, None, "en"), (901, "", "en"), (None, "x", "en"), (0, data[0][1], "en")], "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (5000, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    none = toxicity.toxicity(docs, lab.limit(0)).collect()
    assert len(none) == 404 and toxicity.toxicity(docs.limit(0), lab).count() == 0


def test_misspelled_learned_terms_are_toxic(spark):
    data, labels = [], []
    for i in range(400):
        w = base_text(1000 + i, 40).split()
        if i % 4 == 0:
            w[7] = w[21] = ("grumfel", "vexoid")[i // 4 % 2]
        data.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.fit(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd = ["grxmfel", "gumfel", "grummfel", "vexoid", "v3xoid", "vexxoid", "harmless"]
    texts = spark.createDataFrame([(w, f"you are a {w} and a {w} you {w}") for w in odd], "w string, text string")
    got = {r.w: r.predicted for r in toxicity.score(texts, model).collect()}
    assert got == {w: int(w != "harmless") for w in odd}


def test_a_word_beside_its_own_stem_stays_fuzzy():
    lex = toxicity.Lexicon({("grumf", True): 3.0, ("grumf", False): 2.0})
    assert lex.match("grumfen")[1] and lex.match("grxmf") == (2.0 * toxicity.FUZZY_WEIGHT, False) and lex.match("xrxmf") is None


def test_queries_are_registered():
    names = list(Q.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_sha_of_kept_bytes(spark, sf):
    df = Q.op10_repeats(spark, sf)
    r = df.orderBy("doc_id").first()
    t = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text
    assert r.n_removed or r.kept_sha256 == hashlib.sha256(t.encode()).hexdigest()
