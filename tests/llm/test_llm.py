"""The training-data operators against brute force, and their edge cases."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticework.llm import centroids, exact_dedup, fill_in_middle, graph, lm_scoring, media, minhash, mixing, ngram_join, packing, quality, queries, substring_dedup, token_files, tokens, tool_calls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, `__key` string"
#: Nulls in every column, empty and blank texts, ties, repeated rows, odd blanks, columns with clashing names.
ODD = [
    (1, "a b c d e f", "en", "s1", 11, True, "x"), (2, "a b\tc d e f", "en", "s1", 11, False, "x"), (2, "a b\tc d e f", "en", "s1", 11, False, "x"), (3, None, None, None, None, None, None),
    (4, "", "en", "s2", 0, True, ""), (5, " \n\t ", "en", "s2", 4, True, ""), (None, "null id", "en", None, 7, None, "y"), (7, "A B C D E F", "en", "s3", 11, True, "z"),
    (8, "it's　é́ 12 <|endoftext|>\n\n x", "en", "s3", 20, True, "z"), (9, "w " * 3000 + "end", "en", "s3", 6003, True, "z"), (10, "w " * 3000 + "end", "en", "s1", 6003, True, "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def blank_free(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_exact_dedup(odd, none):
    got = exact_dedup.exact_dedup(odd).collect()
    groups = defaultdict(list)
    for r in ODD:
        groups[blank_free(r[1])].append(r)
    assert len(got) == len(ODD)
    for r in got:
        same = next(g for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        best = min(same, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert (r.keep_id, r.group_size) == (best[0], len(same)) and r.kept == (r.doc_id == best[0])
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_keep_first_tells_texts_of_one_id_apart(spark):
    rows = [(3, "same text"), (5, "same  text"), (5, "another"), (5, "another"), (8, "same text"), (None, "last"), (None, "last")]
    kept = exact_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(5, "same  text"), (5, "another"), (None, "last")])


def test_longest_text_of_an_id_stays(spark):
    df = spark.createDataFrame([(5, "a  b"), (5, "ab"), (7, "ab"), (9, "a b"), (9, "a\tb")], "doc_id long, text string")
    got = Counter((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert got == Counter({(5, 5, True): 1, (5, 5, False): 1, (7, 5, False): 1, (9, 5, False): 2})
    assert [tuple(r) for r in exact_dedup.keep_first(df).collect()] == [(5, "a  b")]
    assert [tuple(r) for r in exact_dedup.keep_first(df.where("doc_id = 9")).collect()] == [(9, "a\tb")]


def test_colliding_hashes_stay_apart(odd):
    same = lambda c: F.lit("one hash for all")
    a = sorted(exact_dedup.exact_dedup(odd, content_hash=same).collect(), key=str)
    assert a == sorted(exact_dedup.exact_dedup(odd).collect(), key=str)


@pytest.mark.parametrize("name,end,words_only", [("byte_bpe_50k.json", 2, False), ("word_bpe_49k.json", 1, True)])
def test_tokens_equal_whole_texts(name, end, words_only):
    texts = [r[1] for r in ODD] + [" a", "a  b", "x\r\ny", "Straße ΑΣ. don't stop., 3.5, ok.\n", "\x00a b", "漢字 かな"]
    path = tokens.public(name)
    ids, n = tokens.Encoder(path, end, words_only).encode(pa.array(texts, pa.string()))
    want = [e.ids + [end] for e in tokens.load(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("values", [np.cumsum(np.random.default_rng(3).integers(0, 900, 3000)), np.zeros(700, np.int64), np.array([5]), np.arange(600), np.array([0, 3, 2**63 + 5], np.uint64)])
def test_elias_fano(values):
    e = token_files.EliasFano.of(values)
    again, _ = token_files.EliasFano.unpack(e.n, e.low_bits, memoryview(e.pack()))
    assert again.select(np.arange(len(values))).tolist() == values.tolist()
    for i in {0, 1, 255, 256, 257, 511, len(values) - 1}:
        if i < len(values):
            assert again.select(i).tolist() == [values[i]]
    with pytest.raises(IndexError):
        again.select(len(values))


def test_blob():
    ids = np.array([-(2**63), -7, 9, 9, 2**62])
    blob = token_files.Blob(token_files.write_blob(ids, np.array([2, 3, 1, 1, 1]), np.array([7, 8, 70000, 1, 2, 3, 4, 5], np.uint32)))
    assert blob.doc_ids.tolist() == ids.tolist()
    assert blob.document(0).tolist() == [7, 8] and blob.document(1).tolist() == [70000, 1, 2] and blob.document(4).tolist() == [5]
    dense = np.arange(8000) * 20
    assert len(token_files.write_blob(dense, np.full(8000, 50), np.zeros(400_000, np.uint32))) - 800_000 < 8000 * 64 // 8 / 3  # both sequences in a third of one 64-bit table


def test_token_files(spark, docs, odd, none):
    path = tokens.public("byte_bpe_50k.json")
    for df in (docs, odd):
        out = token_files.read_tokens(spark, token_files.write_tokens(df, token_files.scratch_path(spark), path, 2)).collect()
        rows = sorted(((-(2**63) if r.doc_id is None else r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()))
        start = 0
        for got, (doc_id, text) in zip(sorted(out, key=lambda r: r.start), rows, strict=True):
            ids = tokens.load(path).encode(text, add_special_tokens=False).ids + [2]
            assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert token_files.read_tokens(spark, token_files.write_tokens(none, token_files.scratch_path(spark), path, 2)).count() == 0


def naive_best_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, c in enumerate(left) if c >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(capacity - n)
    return len(left)


def test_plan_is_best_fit_decreasing():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        lengths = rng.integers(1, rng.integers(2, 101), rng.integers(1, 300)).tolist()
        rows = packing.plan(dict(Counter(lengths)), 100)
        used = defaultdict(int)
        for n, first, stop, b, each, base in rows:
            for k in range(first, stop):
                assert used[b + (k - first) // each] == base + (k - first) % each * n
                used[b + (k - first) // each] += n
        assert max(used.values()) <= 100 and sum(used.values()) == sum(lengths) and len(used) == naive_best_fit(lengths, 100)


def test_packing(spark, docs, odd, none):
    path = tokens.public("word_bpe_49k.json")
    for df, capacity in ((docs, 4096), (odd, 50)):
        got = packing.pack_documents(df, path, 1, capacity).collect()
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        want = Counter()
        for r in df.collect():
            ids = [*tokens.load(path).encode(r.text or "", add_special_tokens=False).ids, 1]
            for k in range(0, len(ids), capacity):
                part = ids[k : k + capacity]
                want[r.doc_id, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        total = sum(n * k[3] for k, n in want.items())
        assert naive_best_fit([k[3] for k, n in want.items() for _ in range(n)], capacity) == len(bins)
        assert sum(r.length for r in got) == total and len(bins) <= 1.02 * total / capacity + 1
    assert packing.pack_documents(none, path, 1).count() == 0


def test_media_round_trip(odd, none):
    for text in (b"", b"x", b"y" * 576, bytes(range(256)) * 99):
        payload = media.padded(text)
        image = media.read(media.encode(payload))
        assert media.payload_of(image) == payload.tobytes() and len(payload) % 576 == 0
        assert media.rgb(image).shape == (image.height, image.width, 3)
    got = media.load_media(media.store_texts(odd), tensors=True).collect()
    assert len(got) == len(ODD)
    for r in got:
        text = next(x[1] or "" for x in ODD if x[0] == r.doc_id).encode()
        payload = media.padded(text).tobytes()
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])) and len(r.rgb) == 3 * r.height * r.width
    assert media.load_media(media.store_texts(none)).count() == 0


def test_general_progressive_scans():
    """Zero runs, ends of bands and new coefficients in a refinement, read symbol by symbol."""
    codes = {(8, s): s for s in range(255)}
    put = lambda *pairs: np.packbits(np.array([b for v, n in pairs for b in media.number_bits(v, n)] + [1] * 16, np.uint8)[: None]).tobytes()
    stored = np.zeros((2, 64), np.int32)
    image = media.Image(16, 8, {1: (1, 1)}, {0: np.ones(64)}, {1: 0}, {1: stored})
    # Block 0: two zeros, then 3 (two bits); the rest ends. Block 1: 15 + 1 zeros, then -1.
    first = put((0x22, 8), (3, 2), (0x00, 8), (0xF0, 8), (0x01, 8), (0, 1), (0x00, 8))
    media.scan(image, {0x10: codes}, [(1, 0)], 1, 63, 0, 1, media.Bits(first))
    assert stored[0, 3] == 6 and stored[1, 17] == -2 and np.count_nonzero(stored) == 2
    # Refinement, block 0: a new -1 after one zero, then the correction of place 3 by 1, end. Block 1: correction 1, end.
    second = put((0x11, 8), (0, 1), (0x00, 8), (1, 1), (0x00, 8), (1, 1))
    media.scan(image, {0x10: codes}, [(1, 0)], 1, 63, 1, 0, media.Bits(second))
    assert stored[0, 2] == -1 and stored[0, 3] == 7 and stored[1, 17] == -3


def jpeg(blocks, scans, interval=0, fill=b"", width=16, height=16, quant=None):
    """A one-component progressive file of the given scans (start, end, high, low, segments), each code 8 bits long."""
    out = b"\xff\xd8" + media.segment(0xDB, b"\0" + bytes(quant or [1] * 64))
    for kind in (0x00, 0x10):
        out += media.segment(0xC4, bytes([kind, *[0] * 7, 255, *[0] * 8, *range(255)]))
    out += media.segment(0xC2, bytes([8, 0, height, 0, width, 1, 1, 0x11, 0]))
    out += media.segment(0xDD, bytes([0, interval])) if interval else b""
    for start, end, high, low, parts in scans:
        out += fill + media.segment(0xDA, bytes([1, 1, 0, start, end, high << 4 | low]))
        out += b"".join(media.stuffed(np.array(bits, np.uint8)) + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(parts) else b"") for k, bits in enumerate(parts))
    return out + b"\xff\xd9"


def put(*pairs):
    return [b for v, n in pairs for b in media.number_bits(v, n)]


def magnitude(v):
    v = int(v)
    n = abs(v).bit_length()
    return n, (v if v > 0 else v + (1 << n) - 1, n)


def reference_samples(blocks, quant, across):
    """The inverse transform by its defining sum, place by place."""
    zigzag = media.zigzag()
    rows = len(blocks) // across
    out = np.zeros((8 * rows, 8 * across))
    c = lambda k: np.sqrt(0.5) if k == 0 else 1.0
    for b, block in enumerate(blocks):
        for y in range(8):
            for x in range(8):
                total = sum(c(z // 8) * c(z % 8) * block[k] * quant[k] * np.cos((2 * y + 1) * (z // 8) * np.pi / 16) * np.cos((2 * x + 1) * (z % 8) * np.pi / 16) for k, z in enumerate(zigzag) if block[k])
                out[b // across * 8 + y, b % across * 8 + x] = total / 4 + 128
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("interval,fill", [(0, b""), (1, b""), (3, b"\xff\xff")])
def test_foreign_progressive_files(interval, fill):
    """DC differences and their refinement, AC coefficients, restarts and fill bytes, against the coefficients and the defining sum."""
    rng = np.random.default_rng(13)
    blocks = np.zeros((4, 64), int)
    blocks[:, 0] = rng.integers(-60, 60, 4) * 2 + rng.integers(0, 2, 4)
    blocks[:, 1:] = rng.integers(-9, 10, (4, 63)) * (rng.random((4, 63)) < 0.2)
    quant = [int(q) for q in rng.integers(1, 6, 64)]
    step = interval or 4
    first, refine, ac = [], [], []
    for a in range(0, 4, step):
        last, one, two, three = 0, [], [], []
        for block in blocks[a : a + step]:
            n, bits = magnitude((block[0] >> 1) - last)
            last = block[0] >> 1
            one += put((n, 8), *([bits] if n else []))
            two += [block[0] & 1]
            run = 0
            for v in block[1:]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    three += put((0xF0, 8))
                    run -= 16
                n, bits = magnitude(int(v))
                three += put((run << 4 | n, 8), bits)
                run = 0
            three += put((0x00, 8)) if run else []
        first, refine, ac = [*first, one], [*refine, two], [*ac, three]
    data = jpeg(blocks, [(0, 0, 0, 1, first), (1, 63, 0, 0, ac), (0, 0, 1, 0, refine)], interval, fill, quant=quant)
    image = media.read(data)
    assert image.coefficients[1].tolist() == blocks.tolist() and media.payload_of(image) is None
    got, want = media.rgb(image)[..., 0].astype(int), reference_samples(blocks, quant, 2).astype(int)
    assert np.abs(got - want).max() <= 1 and (got == want).mean() > 0.98


def test_media_that_cannot_be_read(spark):
    whole = media.encode(media.padded(b"text " * 200))
    bad = [None, b"", b"no image", whole[:30], whole[: len(whole) // 2], whole.replace(b"\xff\xc2", b"\xff\xc0"), b"\xff\xd8\xff\xd9"]
    df = spark.createDataFrame([(k, 1, m, "x") for k, m in enumerate([*bad, whole, whole])], "doc_id long, n_bytes long, media binary, status string")
    for tensors in (False, True):
        got = {r.doc_id: r for r in media.load_media(df, tensors=tensors).collect()}
        assert len(got) == 9 and got[0].status == "null" and all(got[k].status not in ("ok", "null") and got[k].feature is None for k in range(1, 7))
        assert got[7].status == got[8].status == "ok" and got[7].payload_bytes == 1152


def brute_components(rows, k, percent):
    sets = {i: frozenset(tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))) if (w := words_of(t)) else frozenset() for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_dedup(docs, k, percent):
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(docs, k=k, percent=percent).collect()}
    assert got == want


def test_near_dedup_crowd_and_odd_rows(spark, odd, none):
    """A crowd just below and above the threshold, where stars alone lose links."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = base[:]
        for at in rng.choice(60, rng.integers(1, 4), replace=False):
            own[at] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)
    out = minhash.near_dedup(odd).collect()
    assert len(out) == len(ODD) and {r.component_id for r in out if r.doc_id in (1, 2, 7)} == {1} and all(r.kept for r in out if r.doc_id in (3, 4, 5, None))
    assert minhash.near_dedup(none).count() == 0 and minhash.keep_one(odd).columns == odd.columns


def test_near_dedup_of_crowds_cell_by_cell(spark, monkeypatch):
    """Buckets of any size through cells of a few sets and few columns: pieces with cells of their own, shared ones, pairs of both."""
    rng = np.random.default_rng(15)
    base = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(90):
        own = base[:]
        for at in rng.choice(50, rng.integers(0, 4), replace=False):
            own[at] = f"x{rng.integers(500)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"y{(i // 6) * 40 + j + i % 6}" for j in range(60))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 3, 85)
    assert 5 < len({root for _, root in want.values()}) < len(rows) - 20
    for small, cell, columns in ((1, 8, 32), (1, 1000, 1 << 14), (4, 3, 16)):
        for name, value in (("SMALL", small), ("CELL", cell), ("COLUMNS", columns)):
            monkeypatch.setattr(minhash, name, value)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(df, k=3, percent=85).collect()}
        assert got == want


def test_compare_counts_all_intersections(monkeypatch):
    rng = np.random.default_rng(16)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64) * np.uint64(2**58 + 7)) for _ in range(40)]
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    left, right = np.arange(0, 25), np.arange(15, 40)
    links = minhash.compare(sets, np.arange(40), left, right, 25)
    linked = lambda x, y: 100 * len(set(x) & set(y)) >= 25 * len(set(x) | set(y))
    edges = [(i, j) for i in left.tolist() for j in right.tolist() if i != j and linked(sets[i].tolist(), sets[j].tolist())]
    assert all((i, j) in edges for i, j in links) and len(links) < len(edges)

    def pieces(pairs):
        up = list(range(40))
        for i, j in pairs:
            a, b = up[i], up[j]
            up = [a if x == b else x for x in up]
        return [up.index(x) for x in up]

    assert pieces(links) == pieces(edges)


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    near = lambda w, x: " ".join([*w[:-1], x])
    rows = [(1, " ".join(a)), (1, " ".join(a)), (2, near(a, "x")), (None, near(a, "y")), (None, " ".join(b)), (None, near(b, "z")), (7, "c d e f g h"), (7, near(a, "w"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_dedup(df).collect())
    assert got == Counter({(1, 1, True): 2, (2, 1, False): 1, (None, 1, False): 1, (None, None, True): 1, (None, None, False): 1, (7, 7, True): 1, (7, 1, False): 1})
    kept = Counter((r.doc_id, r.text) for r in minhash.keep_one(df).collect())
    of_b = [t for i, t in kept if i is None]
    assert len(of_b) == 1 and of_b[0].startswith("b0 ")
    assert kept == Counter({rows[0]: 2, rows[6]: 1, (None, of_b[0]): 1})


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_lm_scoring(docs, odd, none):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        held = lambda r: zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1
        own = lambda r: [*words_of(r.text), " "]
        counts = Counter(w for r in rows if not held(r) for w in own(r))
        total, kinds = sum(counts.values()), len(counts)
        want = sorted((str(r.doc_id), held(r), len(own(r)), sum(w in counts for w in own(r)), total, round(sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own(r)), 6)) for r in rows)
        got = lm_scoring.lm_score(df).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert lm_scoring.lm_score(none).count() == 0


def tiny_model(texts):
    """A model counted and put together here, without Spark."""
    counts = Counter(w for t in texts for w in [*words_of(t), lm_scoring.END])
    kept = {w: c for w, c in counts.items() if c > 1}
    names = list(kept)
    own = np.array(list(kept.values()), np.int64)
    codes = lm_scoring.Codes.of(lm_scoring.hashed(names).view(np.int64), own, own, lm_scoring.beginnings(names).view(np.int64), sum(counts.values()) - sum(kept.values()))
    tables = lm_scoring.Table(1 << 16), lm_scoring.Table(lm_scoring.SPELL_SLOTS)
    distinct, code, n = lm_scoring.tokens_of(pa.array(texts, pa.large_string()))
    h = lm_scoring.hashed(distinct)
    row, h = codes.find(h)[code], h[code]
    tables[0].add(codes.codes[row], codes.lengths[row], lm_scoring.word_contexts(h, row, n, codes))
    joined, _, contexts = lm_scoring.spelling([w for w in counts if w != lm_scoring.END])
    tables[1].add(joined, np.full(len(joined), 8), contexts)
    words, speller = (lm_scoring.Predictors(t.slots, list(t.blocks(0)), 0) for t in tables)
    return lm_scoring.Model(codes, words, speller, sum(counts.values()), len(counts), lm_scoring.first_weights(), lm_scoring.spelling_weights()), tables, names


TINY = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "the mat and the log", "once upon a time " * 30, "the the the cat"]


def test_probabilities_of_the_next_token_sum_to_one():
    model, _, names = tiny_model(TINY)
    tokens = [*names, lm_scoring.ESCAPE]
    for before in ([], ["the"], ["the", "cat"], ["a", "zebra", "sat"], ["once", "upon"] * 20):
        history = lm_scoring.hashed(before)
        total = 0.0
        for t in tokens:
            h = np.append(history, lm_scoring.hashed([t]))
            rows = model.codes.find(h)
            with_, without = model.score(h, rows, np.array([len(h)])), model.score(history, rows[:-1], np.array([len(history)])) if before else np.zeros(1)
            total += 2 ** float(with_[0] - without[0])
        assert abs(total - 1) < 1e-4, (before, total)


def test_spellings_sum_to_one_and_equal_a_plain_speller():
    """Over all bytes that can follow a beginning, the closing one included; and whole words byte by byte."""
    model, _, _ = tiny_model(TINY)
    one = lambda before, byte: plain_bits(byte, 8, [plain_byte_context(before, j) for j in lm_scoring.SPELL_BACK], model.speller, model.spell_weights, False)[0]
    each = [2 ** one([*b"ca"], b) for b in range(256)]
    assert abs(sum(each) - 1) < 1e-4 and max(each) > 0.1
    for word in ("cat", "zebra", "é"):
        letters = [*word.encode(), 0]
        assert abs(model.spell([word])[0] - sum(one(letters[:k], b) for k, b in enumerate(letters))) < 1e-2


def plain_byte_context(before, upto):
    c = 0
    for j in range(1, upto + 1):
        c = ((c ^ (before[-j] + 1 if len(before) >= j else 0)) * int(lm_scoring.C) + j) % 2**64
        c ^= c >> 31
    return c * int(lm_scoring.B) % 2**64 >> 32


def plain_slot(node, context, slots):
    h = node * 0x9E3779B1 % 2**32 ^ (context or 0)
    h = (h ^ h >> 15) * 0x85EBCA77 % 2**32
    return (h ^ h >> 13) * 0xC2B2AE3D % 2**32 >> (32 - (slots - 1).bit_length())


def plain_bits(code, length, contexts, predictors, weights, collect):
    """(log2 probability, [(gate, bit, inputs, p)]) of one symbol, bit by bit."""
    out, seen = 0.0, []
    for depth in range(length):
        bit, node = code >> (length - depth - 1) & 1, code >> (length - depth) | 1 << depth
        at = [k * predictors.slots + plain_slot(node, c, predictors.slots) for k, c in enumerate(contexts)]
        gate = int(predictors.seen[at[1]]) * 4 + int(predictors.seen[at[2]])
        st = [float(predictors.stretch[a]) for a in at]
        x = sum(w * s for w, s in zip(weights[gate], st, strict=True))
        p = 1 / (1 + np.exp(-x))
        out += np.log2(p if bit else 1 - p)
        seen.append((gate, bit, st, p))
    return out, seen if collect else None


def test_scores_equal_a_plain_scorer():
    """Token by token and bit by bit, the weights refined where the model says."""
    model, _, _ = tiny_model(TINY)
    codes = model.codes
    for text in [*TINY, "the zebra sat", ""]:
        tokens = [*words_of(text), lm_scoring.END]
        h = lm_scoring.hashed(tokens)
        rows = codes.find(h)
        got = model.score(h, rows, np.array([len(tokens)]))[0]
        weights = lm_scoring.first_weights().astype(float)
        want, common, before, start, turn, seen = 0.0, 0, 0, 0, 0, []
        for k, row in enumerate(rows.tolist()):
            mix = lambda v: int(minhash.finish(np.array([v % 2**64], np.uint64))[0]) >> 32
            contexts = [None, mix(common + 1), mix(before * int(lm_scoring.B) + 2)]
            bits, own = plain_bits(int(codes.codes[row]), int(codes.lengths[row]), contexts, model.words, weights, True)
            want += bits
            seen += own
            common = int(h[k]) if codes.frequent[row] else common
            before = int(codes.classes[row])
            if k + 1 == start + lm_scoring.REFINE[min(turn, len(lm_scoring.REFINE) - 1)]:
                for gate in range(16):
                    mine = [s for s in seen if s[0] == gate]
                    for j in range(3):
                        weights[gate, j] += lm_scoring.RATE * sum((b - p) * st[j] for _, b, st, p in mine) / (lm_scoring.STEADY + len(mine))
                start, turn, seen = k + 1, turn + 1, []
        assert abs(got - want) < 1e-2 + 1e-4 * abs(want)


def test_blocks_are_summed_in_64_bits(spark):
    import zstandard

    block = zstandard.ZstdCompressor().compress(np.full(8, 3 * 10**9, np.int64).tobytes())
    df = spark.createDataFrame([(5, k % 3, block) for k in range(10)], "block long, part int, counts binary")
    got = lm_scoring.summed(df).collect()
    assert len(got) == 1 and np.frombuffer(zstandard.ZstdDecompressor().decompress(got[0].counts), np.int64).tolist() == [30 * 10**9] * 8


def test_learned_weights_find_the_better_input():
    rng = np.random.default_rng(1)
    bit = rng.integers(0, 2, 5000)
    good, noise = (2 * bit - 1) * 0.7 + rng.normal(0, 0.3, 5000), rng.normal(0, 1, 5000)
    w = lm_scoring.learned(np.full((16, 3), 0.3, np.float32), [([noise, good, noise * 0], np.full(5000, 6), bit)])
    assert w[6, 1] > 1 and abs(w[6, 0]) < 0.2 and (np.delete(w, 6, 0) == np.float32(0.3)).all()


def test_all_training_texts_teach_counts_and_weights(spark):
    texts = [f"{t} and {k}{k} or {k % 5}" for k in range(10) for t in TINY]
    trained, _ = lm_scoring.train(lm_scoring.tokenised(spark.createDataFrame([(k, t, False) for k, t in enumerate(texts)], "doc_id long, text string, held_out boolean")))
    plain, tables, _ = tiny_model(texts)
    for got, want in ((trained.words, plain.words), (trained.speller, plain.speller)):
        assert (got.stretch == want.stretch).all()
    distinct, code, n = lm_scoring.tokens_of(pa.array(texts, pa.large_string()))
    h = lm_scoring.hashed(distinct)
    row, h = plain.codes.find(h)[code], h[code]
    joined, _, contexts = lm_scoring.spelling([w for w in distinct if w != lm_scoring.END])
    symbols = (plain.codes.codes[row], plain.codes.lengths[row], lm_scoring.word_contexts(h, row, n, plain.codes)), (joined, np.full(len(joined), 8), contexts)
    first = lm_scoring.first_weights(), lm_scoring.spelling_weights()
    for table, own, start, got, whole in zip(tables, symbols, first, (trained.word_weights, trained.spell_weights), (True, False), strict=True):
        counts = np.zeros(lm_scoring.TALLY, np.uint32)
        lm_scoring.States(table.slots, list(table.blocks(0)), 0, whole).tally(*own, counts)
        assert counts.sum() == own[1].astype(int).sum()  # every bit
        want = lm_scoring.weights_from(start, list(lm_scoring.pressed(counts, 0)), 0)
        assert np.allclose(got, want, atol=1e-5) and not np.allclose(got, start, atol=1e-2)


def test_states_leave_the_bit_itself_out():
    table = lm_scoring.Table(1 << 16)
    table.counts[:] = np.random.default_rng(4).integers(0, 20, len(table.counts))
    n = table.counts.reshape(lm_scoring.ORDERS, -1, 2).astype(int)
    for whole in (False, True):
        state = lm_scoring.States(table.slots, list(table.blocks(0)), 0, whole).state.reshape(n.shape)
        for k, slot, bit in itertools.product(range(lm_scoring.ORDERS), (0, 7, 70, 65535), (0, 1)):
            left = [max(0, c - (b == bit and not (whole and k == 0))) for b, c in enumerate(n[k, slot].tolist())]
            level, seen = round(np.arcsinh(np.log((left[1] + 0.4) / (left[0] + 0.4))) * lm_scoring.SPREAD) + 16, sum(left)
            assert state[k, slot, bit] == level + 32 * ((seen >= 1) + (seen >= 3) + (seen >= 16))


@pytest.mark.parametrize("spoilt", [False, True])
def test_segments_encoded_together_equal_those_encoded_alone(spoilt, monkeypatch):
    """Also where blanks do not tell the segments apart, and in calls of a few segments."""
    monkeypatch.setattr(tokens, "JOINED", 5)
    monkeypatch.setattr(tokens, "ENCODED", 3)
    own = tokens.Segments(tokens.load(tokens.public("byte_bpe_50k.json")))
    if spoilt:
        own.begins[:] = False
    alone = lambda s: own.tokenizer.encode(s, add_special_tokens=False).ids
    for words in (["", "First", " of", "\nall", " it's", " 12,5", "\n", " ", " \u4e2d\u6587", " <|endoftext|>", " \u00e9\u00e8", "\n\u0120x"], [" more", "\n-", " of", "_", " \U0001f600!"]):
        start, length, mark = own.find(words)
        for w, a, n, m in zip(words, start.tolist(), length.tolist(), mark.tolist(), strict=True):
            assert [*own.ids[a : a + n].tolist(), *[m] * (m >= 0)] == alone(w)


def test_code_is_complete():
    counts = np.sort(np.random.default_rng(2).integers(1, 10000, 500))
    lengths = lm_scoring.code_lengths(counts)
    assert abs(sum(2.0**-n for n in lengths.tolist()) - 1) < 1e-12 and (np.diff(lengths) <= 0).all()


def test_quality_held_out(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    graded = queries.graded(spark, "/root/testdata/sf0.01")
    known, asked = graded.where("id % 3 <> 0"), graded.where("id % 3 = 0")
    got = quality.classify(docs, known).join(asked, F.col("doc_id") == F.col("id")).select("grade", "kept").collect()
    right = [r.kept == (r.grade == 2) for r in got]
    assert len(right) > 50 and np.mean(right) > 0.9
    assert quality.classify(odd, graded.where("id < 0")).where("kept").count() == len(ODD)
    assert quality.classify(odd, known).count() == len(ODD) and quality.classify(none, known).count() == 0
    assert quality.keep_good(odd, known).columns == odd.columns


def plain_grades(model, text):
    """P(grade > j) of one text, word by word."""
    words = [w for w in re.split(r"\s+", text, flags=re.ASCII) if w]
    score = sum(model.words[k] for k in {quality.word_key(w) for w in words})
    kinds, total = Counter(quality.shape(w) for w in words), max(1, len(words))
    for kind in range(quality.SHAPES):
        score += model.shapes[kind * (len(quality.PARTS) + 1) + int(np.digitize(kinds[kind] / total, quality.PARTS))]
    score += model.shapes[quality.SHAPES * (len(quality.PARTS) + 1) + int(np.digitize(len({quality.word_key(w) for w in words}) / total, quality.DISTINCT))]
    return [1 / (1 + np.exp(t - score)) for t in model.thresholds]


def test_quality_against_plain_scorer(spark, docs):
    graded = queries.graded(spark, SF)
    model = quality.train(docs.select(F.col("doc_id").alias("id"), "text"), graded, 3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.classify(docs, graded).collect():
        above = plain_grades(model, texts[r.doc_id] or "")
        assert abs(r.expected_grade - sum(above)) < 1e-6 and abs(r.tail_probability - above[1]) < 1e-6 and r.kept == (r.tail_probability >= 0.5)


def test_quality_fit_is_bounded(spark, monkeypatch):
    rows = [(k % 40, " ".join(f"w{j}" for j in range(k % 40, k % 40 + 30))) for k in range(400)]
    docs = spark.createDataFrame(rows, "id long, text string")
    graded = spark.createDataFrame([(k, k % 3) for k in range(40)], "id long, grade int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda words, n, *rest: seen.append((len(n), len(words))) or fit(words, n, *rest))
    quality.train(docs, graded, 3)
    monkeypatch.setattr(quality, "SAMPLE_ENTRIES", 310)
    quality.train(docs, graded, 3)
    assert seen == [(40, 1200), (10, 300)]


def test_hashed_words_alone_carry_the_grade(monkeypatch):
    """Without the shapes, weights of hashed words and thresholds recover the likelihood's maximum: the gradient is nearly zero."""
    rng = np.random.default_rng(21)
    n = rng.integers(5, 30, 600)
    words = rng.integers(0, 300, n.sum())
    owner = np.repeat(np.arange(600), n)
    true = rng.normal(size=300)
    score = np.bincount(owner, true[words], 600) / np.sqrt(n)
    grades = np.digitize(score + rng.logistic(scale=0.3, size=600), (-0.5, 0.7))
    pairs = np.unique(owner * 300 + words)
    n = np.bincount(pairs // 300, minlength=600)
    monkeypatch.setattr(quality, "LEAST_ERRORS", 0.0)  # each of these words tells little
    model = quality.fit(pairs % 300, n, np.zeros((600, quality.COLUMNS)), grades, 3)
    fitted = np.bincount(np.repeat(np.arange(600), n), model.words[pairs % 300], 600)
    expected = (1 / (1 + np.exp(model.thresholds[None] - fitted[:, None]))).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.9 * np.corrcoef(score, grades)[0, 1]
    above = 1 / (1 + np.exp(model.thresholds[None] - fitted[:, None]))
    assert np.abs(above.mean(axis=0) - [(grades > 0).mean(), (grades > 1).mean()]).max() < 0.03  # the thresholds' score equations


def test_thresholds_are_ordered():
    rng = np.random.default_rng(4)
    grades = rng.integers(0, 4, 200)
    words = np.repeat(grades, 1) + 10
    model = quality.fit(words, np.ones(200, int), np.zeros((200, quality.COLUMNS)), grades, 4)
    # Words near the mean grade tell too little to get a weight.
    assert (np.diff(model.thresholds) > 0).all() and (np.diff(model.words[10:14]) >= 0).all() and model.words[10] < 0 < model.words[13]


CALLS = "conv_id long, turn long, call_id string, name string, parent_id string, arguments map<string,string>, record string, depth int"
RESULTS = "conv_id long, call_id string, turn long, content string, status string"


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", "add", None, {"x": "1", "y": "2.5"}), (1, 2, "b", "add", "a", {"x": "one", "y": "2"}), (1, 4, "c", "say", "b", {"t": 'q"\n\u0001é'}), (2, 0, "d", "say", "e", {"t": "t"}), (2, 1, "e", "say", "d", {"t": "t"}), (2, 2, "f", "say", "e", {"t": "t"}),
         (3, 0, None, "gone", None, None), (1, 9, "a", "add", None, {"x": "9", "y": "9"}), (2, 7, "a", "add", None, {"x": "7", "y": "7"}), (None, None, None, None, None, None), (None, 3, "a", "say", "a", {"t": "self"})],
        CALLS.replace(", record string, depth int", ""),
    ).withColumn("record", F.lit("clash")).withColumn("depth", F.lit(9))
    results = spark.createDataFrame([(1, "a", 1, "3.5", "s"), (1, "a", 8, "later", "s"), (1, "c", 5, None, "s"), (1, "zzz", 0, "stray", "s"), (2, "a", 9, "two", None), (None, None, None, None, None)], RESULTS)
    rows = tool_calls.link_calls(calls, results, {"add": {"x": "integer", "y": "number"}, "say": {"t": "string", "loud": "boolean?"}}).collect()
    got = {(r.conv_id, r.call_id): r for r in rows}
    assert len(rows) == len(got) == 12
    assert [got[1, k].position for k in "abc"] == [1, 2, 3] and [got[1, k].depth for k in "abc"] == [0, 1, 2]
    assert [got[1, k].valid for k in "abc"] == [True, False, True] and got[2, "d"].status == got[2, "e"].status == got[None, "a"].status == "circular" and got[2, "f"].status == "blocked" and got[1, "b"].status == "unanswered"
    assert got[1, "a"].record == '{"arguments":{"x":1,"y":2.5},"call_id":"a","name":"add","result":"3.5","status":"linked"}'
    assert (got[1, "a"].calls, got[1, "a"].results) == (2, 2) and '"result":"two"' in got[2, "a"].record and '"x":7' in got[2, "a"].record
    assert '"t":"q\\"\\n\\u0001é"' in got[1, "c"].record and got[3, "turn:0"].valid is False and got[None, "turn:null"].status == "unanswered"
    assert got[1, "zzz"].status == got[None, None].status == "orphan" and '"result":"stray"' in got[1, "zzz"].record and got[1, "zzz"].position == 4
    assert tool_calls.link_calls(calls.where("false"), results.where("false"), {}).count() == 0
    assert {r.status for r in tool_calls.link_calls(calls.where("false"), results, {}).collect()} == {"orphan"}


def test_long_chains_of_calls(spark):
    rows = [(1, k, f"c{k}", "say", f"c{k - 1}" if k else None, {"t": "t"}) for k in range(300)] + [(2, k, f"c{k}", "say", f"c{(k + 1) % 7}", {"t": "t"}) for k in range(7)] + [(2, 10 + k, f"t{k}", "say", "c3" if not k else f"t{k - 1}", {"t": "t"}) for k in range(9)]
    got = tool_calls.link_calls(spark.createDataFrame(rows, CALLS.replace(", record string, depth int", "")), spark.createDataFrame([], RESULTS), {}).collect()
    assert [r.depth for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)] == list(range(300))
    assert Counter(r.status for r in got) == {"unanswered": 300, "circular": 7, "blocked": 9}


def test_argument_types(spark):
    cases = [("enum:red|green", "red", "blue"), ("array:integer", "[1,-2]", "[1,a]"), ("array:string", '["a\\n",""]', '["a]'), ("null", "null", "nil"), ("boolean", "true", "True"), ("number", "-1.5e3", "1."), ("array:boolean", "[]", "[")]
    for kind, good, bad in cases:
        calls = spark.createDataFrame([(1, k, str(k), "f", None, m) for k, m in enumerate([{"a": good}, {"a": bad}, {}, {"a": good, "b": "1"}, None])], CALLS.replace(", record string, depth int", ""))
        none = spark.createDataFrame([], RESULTS)
        for suffix, empty in (("", False), ("?", True)):
            got = {r.call_id: r.valid for r in tool_calls.link_calls(calls, none, {"f": {"a": kind + suffix}}).collect()}
            assert got == {"0": True, "1": False, "2": empty, "3": False, "4": empty}, kind


def test_mixing(odd, none, docs):
    for df in (odd, docs):
        got = mixing.mix(df).collect()
        sizes = defaultdict(int)
        for r in df.collect():
            sizes[r.source] += len(words_of(r.text))
        total = sum(sizes.values())
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: k % 3 + 1 for k, s in enumerate(names)}
        target, left = {}, set(names)
        while True:  # share, cap, share the excess again
            level = (total - sum(3 * sizes[s] for s in names if s not in left)) / sum(weight[s] for s in left)
            over = {s for s in left if level * weight[s] > 3 * sizes[s]}
            if not over:
                break
            left -= over
        target = {s: level * weight[s] if s in left else 3.0 * sizes[s] for s in names}
        assert len(got) == df.count() and all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
        assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(sizes[s], round(target[s], 6)) for s in names})
        assert sum(r.taken for r in got) <= total and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
        order = mixing.copies_of(df).orderBy("position").collect()
        assert [r.position for r in order] == list(range(len(order))) and [r.finish for r in order] == sorted(r.finish for r in order)
        upto = np.cumsum([r["size"] for r in order])
        assert [r.taken for r in order] == (upto <= total).tolist()
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_rows(odd)
    assert mixed.columns == odd.columns
    # The rows come in the mixed order.
    places = {r.doc_id: r.first_position for r in mixing.mix(docs).collect()}
    first = list(dict.fromkeys(r.doc_id for r in mixing.mixed_rows(docs).collect()))
    assert first == sorted(first, key=places.get)


def test_targets_of_many_sources(spark):
    sizes = np.random.default_rng(9).integers(0, 1000, 500).tolist()
    df = spark.createDataFrame([(f"h{k:03}", s) for k, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, 3).collect()}
    assert abs(sum(got.values()) - sum(sizes)) < 1e-6 * sum(sizes)
    free = {round(got[f"h{k:03}"] / (k % 3 + 1), 6) for k, s in enumerate(sizes) if got[f"h{k:03}"] < 3 * s}
    assert len(free) == 1 and all(got[f"h{k:03}"] <= 3 * s for k, s in enumerate(sizes))
    assert all(3 * s <= free.copy().pop() * (k % 3 + 1) + 1e-6 for k, s in enumerate(sizes) if got[f"h{k:03}"] == 3 * s)


def brute_repeats(rows, length):
    counts = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = []
    for doc_id, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((str(doc_id), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [400, 20])
def test_repeats(odd, docs, length):
    for df in (odd, docs):
        rows = [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]
        got = substring_dedup.remove_repeats(df, length=length, keep_text=True).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, length)
        for r in got:
            assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.removed) == r.n_spans and sum(s.stop - s.start for s in r.removed) == r.n_removed


def test_repeats_in_a_very_long_text(spark):
    """Longer than two pieces, so that it is searched piece by piece; a passage at a piece's edge repeats in another text."""
    rng = np.random.default_rng(12)
    text = bytearray(rng.integers(97, 123, 5_000_000, np.uint8).tobytes())
    for at in (0, substring_dedup.PIECE - 250, 2 * substring_dedup.PIECE - 399, 4_999_000):
        text[at : at + 500] = text[1_000_000:1_000_500]
    df = spark.createDataFrame([(1, text.decode()), (2, text[3_000_000:3_000_450].decode())], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df, keep_text=True).collect()}
    spans = sorted((s.start, s.stop) for s in got[1].removed)
    assert spans == sorted([(a, a + 500) for a in (0, 1_000_000, substring_dedup.PIECE - 250, 2 * substring_dedup.PIECE - 399, 4_999_000)] + [(3_000_000, 3_000_450)])
    assert got[2].n_removed == 450 and got[2].kept == b""


def test_repeats_of_hot_contexts(spark, none, monkeypatch):
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefgh"))
    common = "".join(rng.choice(letters, 90))
    rows = [(i, "".join(rng.choice(letters, rng.integers(0, 60))) + common[rng.integers(0, 20) :] + "".join(rng.choice(letters, 30))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats([(i, t.encode()) for i, t in rows], 40)
    for hot in (5, 50_000):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        got = substring_dedup.remove_repeats(df, length=40).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert substring_dedup.remove_repeats(none).count() == 0


def test_levels_merge_geometrically():
    rng, family, seen = np.random.default_rng(8), substring_dedup.Levels(), Counter()
    found = set()
    for k in range(20):
        keys = rng.integers(0, 3000, 100).astype(np.uint64)
        seen.update(keys.tolist())
        place = np.arange(100) + 100 * k
        rid, at = family.add(keys, keys.astype(np.int64), place)
        found |= set(rid.tolist())
        sizes = [len(level[0]) for level in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert found == {k for k, n in seen.items() if n > 1}


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.when(F.col("doc_id") != 17, F.col("text")))
    rows = lambda df: Counter(map(tuple, df.collect()))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    model = quality.train(docs.select(F.col("doc_id").alias("id"), "text"), queries.graded(spark, SF), 3)
    good = stages["quality"](spark, docs, SF)
    want = {i for i, t in text.items() if plain_grades(model, t)[1] >= 0.5}
    assert rows(good) == rows(docs.where(F.col("doc_id").isin(*want))) and 0 < len(want) < len(text)

    once = stages["exact_dedup"](spark, good, SF)
    groups = defaultdict(list)
    for i in want:
        groups[blank_free(text[i])].append(i)
    want = {min(g, key=lambda i: (-len(text[i]), i)) for g in groups.values()}
    assert rows(once) == rows(docs.where(F.col("doc_id").isin(*want)))

    apart = stages["near_dedup"](spark, once, SF)
    want = {i for i, (_, root) in brute_components([(i, text[i]) for i in want], 5, 80).items() if i == root}
    assert rows(apart) == rows(docs.where(F.col("doc_id").isin(*want)))

    mixed = stages["mix"](spark, apart, SF)
    copies = {r.doc_id: r.copies for r in mixing.mix(apart).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n}) and mixed.columns == docs.columns

    packed = stages["pack"](spark, mixed, SF).collect()
    path = tokens.public("word_bpe_49k.json")
    lengths = Counter()
    for i, n in copies.items():
        m = len(tokens.load(path).encode(text[i], add_special_tokens=False).ids) + 1
        for k in range(0, m, 4096):
            lengths[min(4096, m - k)] += n
    assert Counter(r.length for r in packed) == +lengths and len({r.sequence_id for r in packed}) == naive_best_fit(list(lengths.elements()), 4096)


def test_pipeline_stages_take_odd_rows(spark, odd, none):
    import corpus_pipeline

    kept = {"quality": None, "exact_dedup": 6, "near_dedup": 7, "mix": None, "pack": None}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
        out = stage(spark, odd, SF)
        assert name == "pack" or out.columns == odd.columns
        assert kept[name] is None or out.count() == kept[name], name


def test_lookup_keeps_hot_keys(spark):
    """Broadcast groups and shuffled ones give what a plain join gives, and rows keep their columns."""
    from latticework.llm.shared import lookup

    rows = spark.createDataFrame([(k, "hot" if k % 2 else f"k{k % 7}" if k % 3 else None) for k in range(1000)], "id long, `__key` string")
    groups = rows.where("`__key` is not null").groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    got = sorted(map(tuple, lookup(rows, groups, "__key", "n", 1000, F.col("id")).collect()))
    assert got == sorted(map(tuple, rows.join(groups, "__key", "left").select("id", "__key", "n").collect()))


def test_mix_of_large_sources(spark):
    """Sources large enough to be broadcast come near their targets."""
    docs = spark.createDataFrame([(k, "w " * (k % 9 + 1), f"s{k % 3}") for k in range(3000)], "doc_id long, text string, source string")
    for target, taken in mixing.mix(docs).groupBy("target").agg(F.sum("taken")).collect():
        assert abs(taken - target) <= 20


def test_fill_in_middle(odd, none, docs):
    extra = odd.unionByName(odd.sparkSession.createDataFrame([(20, "has <S> inside", "en", "s", 1, True, ""), (21, "a<", "en", "s", 1, True, ""), (22, "<P" * 40 + "é<" * 30, "en", "s", 1, True, "")], SCHEMA))
    forms = set()
    for df in (extra, docs):
        rows = sorted(df.select("doc_id", "text").collect(), key=str)
        got = fill_in_middle.arrange(df)
        assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        got = got.withColumn("back", fill_in_middle.restored("output", "form")).collect()
        want = []
        for r in rows:
            t, digest = r.text or "", hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
            h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
            a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
            p, m, s = t[:a], t[a:b], t[b:]
            form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
            out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
            want.append((r.doc_id, len(t), form, None if form == "plain" else a, None if form == "plain" else b - a, out, t))
            forms.add(form)
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert forms == {"plain", "psm", "spm"} and fill_in_middle.arrange(none).count() == 0


def test_fill_in_middle_by_words_and_other_sentinels(spark):
    df = spark.createDataFrame([(k, f"word{k}  two three\nfour five six" * (k % 4)) for k in range(60)], "doc_id long, text string")
    marks = ("«p»", "«s»", "«m»")
    got = fill_in_middle.arrange(df, unit=r"(?s)\S+\s*|\s+", sentinels=marks, percent=100, spm_percent=50)
    back = got.withColumn("back", fill_in_middle.restored("output", "form", marks)).join(df, "doc_id").collect()
    assert all(r.back == r.text for r in back) and {r.form for r in back} == {"plain", "psm", "spm"}
    for r in back:
        ends = {0, *(m.end() for m in re.finditer(r"(?s)\S+\s*|\s+", r.text))}
        assert r.form == "plain" or {r.prefix_chars, r.prefix_chars + r.middle_chars} <= ends
    for bad in (("<P>", "<P>", ""), ("aa", "ab", "ba"), ("<P>", "x<P>", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.checked(bad)


def join_classes(rows, k, percent):
    """By brute force over all pairs: (n, component) per row."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            up[top(i)] = top(j)
    least = {}
    for i, (row_id, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), (True, 0)), (row_id is None, row_id or 0))
    return sorted(((row_id, len(sets[i]), None if least[top(i)][0] else least[top(i)][1]) for i, (row_id, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(docs, k, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, ngram_join.join_sets(docs, k=k, percent=percent).collect()), key=str) == join_classes(rows, k, percent)


def test_ngram_join_of_odd_rows_and_crowds(spark, odd, none, monkeypatch):
    assert ngram_join.join_sets(none).count() == 0
    got = sorted(map(tuple, ngram_join.join_sets(odd, k=2, percent=60).collect()), key=str)
    # Rows of one id that are equal are one document; here no id has two texts.
    assert got == join_classes([(r[0], r[1]) for r in ODD], 2, 60)
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 90)]
    rows = []
    for j in range(140):
        own = list(base)
        for at in rng.choice(90, 6 + j % 4, replace=False).tolist():
            own[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((2**63 - 1 - j, " ".join(own)))
    monkeypatch.setattr(minhash, "SMALL", 8)
    monkeypatch.setattr(minhash, "CELL", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.join_sets(df, k=1, percent=85).collect()), key=str) == join_classes(rows, 1, 85)


@pytest.mark.parametrize("percent, rows", [(85, 10**4), (85, 10**10), (60, 10**4), (60, 10**12)])
def test_linked_sets_share_a_key(percent, rows):
    """At the border of a link, over all sizes; at large numbers of rows with one-deletion neighbourhoods."""
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 40)) if rng.random() < 0.5 else int(rng.integers(40, 900))
        m = int(rng.integers(-(-n * percent // 100), n + 1))
        both = -(-percent * (n + m) // (100 + percent))
        if both > m or m == both == n:
            continue
        pool = rng.integers(0, 2**63, n + m - both).astype(np.uint64)
        x, y = np.sort(pool[:n]), np.sort(np.concatenate((pool[:both], pool[n:])))
        assert len(y) == m and 100 * both >= percent * (n + m - both)
        found, counts = ngram_join.keys(np.concatenate((x, y)), np.array([n, m]), percent, rows)
        assert set(found[: counts[0]].tolist()) & set(found[counts[0] :].tolist()), (n, m, both)
    doubles = [ngram_join.allocation(int(a), int(b) - 1, percent, rows)[1] for a, b in zip(ngram_join.starts(900)[:-1], ngram_join.starts(900)[1:], strict=True)]
    assert max(doubles) > 4 or rows < 10**10


def plain_clusters(rows, k=16, rounds=3, size=64, scale=64):
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) and abs(c * scale) < centroids.LARGEST for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        own = [min((far(v, c), j) for j, c in enumerate(middle)) for _, v in kept]
        if turn < rounds:
            for j in range(len(middle)):
                members = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]
                if members:
                    middle[j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    total, per = sum(d for d, _ in own), Counter()
    for d, j in own:
        per[j] += d
    return sorted(((i, j, d, per[j], total, middle[j], hashlib.sha256(",".join(map(str, middle[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own, strict=True)), key=str)


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(k % 5, 0.3, 4).astype(np.float32).tolist()) for k in range(120)]
    rows += [(200, None), (201, [1.0] * 3), (202, [1.0] * 5), (203, [1.0, None, 1.0, 1.0]), (204, [float("nan"), 1.0, 1.0, 1.0]), (205, [float("inf"), 1.0, 1.0, 1.0]), (206, [1e30, 1.0, 1.0, 1.0]), (207, [])]
    rows += [(None, [0.5, -0.5, 0.25, -0.015625])] + [(7, [2.0, 2.0, 2.0, 2.0])] * 5
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string")
    for k in (1, 6, 300):
        got = sorted(map(tuple, centroids.cluster(df, k=k, size=4).collect()), key=str)
        assert got == plain_clusters(rows, k, 3, 4)
    assert centroids.cluster(df.limit(0), size=4).count() == 0
    assert centroids.cluster(df.where("vec_id >= 200"), size=4).count() == 0


def test_scan_by_sorted_centroids_finds_the_nearest():
    rng = np.random.default_rng(6)
    x, middle = rng.integers(-20, 20, (500, 3)), rng.integers(-20, 20, (30, 3))
    middle[7] = middle[3]
    all_ = ((x[:, None, :] - middle[None]) ** 2).sum(axis=2)
    for before in (np.zeros(500, np.int64), rng.integers(0, 30, 500), all_.argmin(axis=1)):
        cluster, distance = centroids.nearest(x, before, middle)
        assert (cluster == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()


def test_near_dedup_tells_the_greatest_id_from_null(spark):
    df = spark.createDataFrame([(2**63 - 1, "a b c d e f g h"), (None, "a b c d e f g h"), (None, "z y x w v u"), (-(2**63), "q q q q q q q q")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_dedup(df).collect()), key=str)
    assert got == sorted([(2**63 - 1, 2**63 - 1, True), (None, 2**63 - 1, False), (None, None, True), (-(2**63), -(2**63), True)], key=str)
