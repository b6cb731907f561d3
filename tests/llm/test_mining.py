"""Hard negatives, fingerprints and collocations against brute force and odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import negatives, order_minhash, phrases

DOCS = "doc_id long, text string, lang string, key string, n long, rank int, range string, own int, next string, head string, words string, copies long"


def documents(spark, rows):
    return spark.createDataFrame([(i, text, lang, "k", 1, 2, "r", 3, "x", "h", "w", 9) for i, text, lang in rows], DOCS)


# hard negatives

VECTORS = "vec_id long, label int, embedding array<float>, chunk string, place int, seed string, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "s", 0.5) for r in rows], VECTORS)


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def brute_negatives(rows, is_anchor, most=5):
    held = {}
    for vec_id, label, vector in rows:
        if vec_id is not None and label is not None and usable(vector):
            held[(vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector))] = None
    found = []
    for anchor in (r for r in held if is_anchor(r[0])):
        score = lambda r: sum(a * b for a, b in zip(anchor[2], r[2], strict=False))
        ranked = sorted({(-score(r), r[0], r[1] == anchor[1]) for r in held if r[0] != anchor[0]})
        for best, positive, _ in [r for r in ranked if r[2]][:most]:
            near = [(s, i) for s, i, same in ranked if not same and -80 * best <= -100 * s <= -100 * best][:most]
            found += [(anchor[0], positive, n, i, -best, -s) for n, (s, i) in enumerate(near, 1)]
    return sorted(found)


def clustered(count, seed=1, width=6, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    return [(i, int(rng.integers(labels)), [float(np.float32(x)) for x in centres[i % 5] + rng.normal(size=width) * 0.2]) for i in range(count)]


@pytest.mark.parametrize("chunk,block", [(2048, 32 << 20), (7, 1000)])
def test_negatives(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", block)
    rows = clustered(400)
    found = negatives.mine(vectors(spark, rows).repartition(3), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_odd_vectors(spark):
    rows = clustered(60, seed=2)
    rows += [(3, *rows[3][1:]), (3, *rows[3][1:]), (10, *rows[10][1:]), (10, 1, [1.0, 2.0])]  # repeated rows, a second anchor 10, short vectors
    rows += [(100 + i, i % 3, rows[i % 7][2]) for i in range(20)]  # ties
    rows += [(200, None, [1.0]), (None, 1, [1.0] * 6), (201, 1, None), (202, 1, [None, 1.0]), (203, 2, [float("nan")] * 6), (204, 1, [float("inf")] * 6), (205, 1, []), (210, 2, [0.0] * 6)]
    rows += [(-20, 1, [-1.0] * 6), (220, 0, [-0.5] * 9)]
    found = negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert negatives.mine(vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(vectors(spark, rows), F.lit(False)).columns == found.columns


def test_large_vectors_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, [rng.uniform(-3e5, 3e5) for _ in range(4)]) for i in range(60)] + [(100, 1, [1e30] * 4)]
    found = negatives.mine(vectors(spark, rows), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows[:-1], lambda i: i % 20 == 0)


def test_bounds_leave_rows_out():
    points = np.floor(256 * np.array([v for _, _, v in clustered(600, width=16)]))
    order, parent, edge = negatives.spanning_tree(points[:120])
    own = points[:120][order]
    block = negatives.Block(np.zeros(120, int), np.arange(120), parent, edge, np.arange(120), np.array([i % 5 for i in order]), [None] * 120, own, [[]] * 120)
    assert all(abs(np.linalg.norm(own[n] - own[p]) - e) < 1e-3 for n, (p, e) in enumerate(zip(parent, edge, strict=True)) if p >= 0)
    search = negatives.Positives(block, 5)
    scored = sum(search.take(np.arange(start, start + 100), np.arange(start, start + 100) % 5, points[start : start + 100]) for start in range(0, 600, 100))
    assert 0 < scored < 120 * 600 / 2
    exact = own @ points.T
    for node in range(120):
        same = [(-int(exact[node, i]), i) for i in range(600) if i % 5 == block.label[node] and i != node]
        assert list(zip((-search.scores[node]).tolist(), search.ids[node].tolist(), strict=True)) == sorted(same)[:5]


# fingerprints


def h64(value, seed=42):
    return xxhash.xxh64_intdigest(value, seed)


def long_hash(value, seed):
    return xxhash.xxh64_intdigest((value % (1 << 64)).to_bytes(8, "little"), seed)


def int_hash(value, seed):
    """Spark's hash of a 32-bit integer: XXH64 of its four bytes."""
    return xxhash.xxh64_intdigest((value % (1 << 32)).to_bytes(4, "little"), seed)


def brute_sketch(text):
    k = order_minhash.K
    runs = [text[i : i + k] for i in range(len(text) - k + 1)] if len(text) >= k else [text] if text else []
    later = 1 << order_minhash.REST_BITS - 1
    placed = sorted(((h64(run.encode()) >> 1) & ~later if run[0] == " " else (h64(run.encode()) >> 1) | later, i) for i, run in enumerate(runs))
    made = []
    for n in range(order_minhash.SKETCHES):
        chosen = [p for p in placed if p[0] >> order_minhash.REST_BITS == n][: order_minhash.TAKEN]
        numbered = [(i, h, sum(g == h for g, _ in chosen[:m])) for m, (h, i) in enumerate(chosen)]
        folded = 42
        for _, h, nth in sorted(numbered):
            folded = int_hash(nth, long_hash(h, folded))
        made.append(folded & 0xFFFFFFFF if chosen else None)
    return made


def brute_fingerprints(rows):
    different = sorted({(i is not None, i or 0, hashlib_key(t or ""), t or "") for i, t, _ in rows}, reverse=True)
    following = {row[:3]: different[(n + 1) % len(different)][3] for n, row in enumerate(different)}
    found = []
    for i, text, _ in rows:
        text = text or ""
        after, third = following[(i is not None, i or 0, hashlib_key(text))], len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, changed, other = map(brute_sketch, (text, edited, after))
        shown = lambda s: "".join("-" if x is None else f"{x:08X}" for x in s)
        found.append((i, len(text), edited, shown(own), shown(changed), alike(own, changed), alike(own, other)))
    return found


def hashlib_key(text):
    return f"{h64(text.encode()):016X}"


def alike(a, b):
    known = [x == y for x, y in zip(a, b, strict=True) if x is not None or y is not None]
    return sum(known) / len(known) if known else 1.0


def fingerprint_rows():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, prose(rng.choice([1, 2, 5, 40, 150, 700])), "en") for i in range(150)]
    rows += [(200, None, None), (201, "", "en"), (202, "short", "en"), (203, "a" * 5000, "en"), (204, "ab" * 4000, "en"), (205, "日本語のテキスト" * 30 + "🙂🙃" * 40, "ja")]
    rows += [(206, rows[7][1], "en"), (3, rows[3][1], "en"), (3, rows[3][1], "en"), (3, "another text", "en"), (None, "no id", "en"), (None, "no id", "en"), (None, None, "en"), (-5, prose(60), "en")]
    rows += [(207, "line one\nline two\r\n" * 60, "en"), (208, prose(9000), "en")]
    return rows


@pytest.mark.parametrize("least", [64, 3])
def test_fingerprints(spark, monkeypatch, least):
    monkeypatch.setattr(order_minhash, "LEAST_ROWS", least)
    rows = fingerprint_rows()
    found = order_minhash.fingerprints(documents(spark, rows).repartition(3))
    got = sorted(map(tuple, found.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=repr)
    assert got == sorted(brute_fingerprints(rows), key=repr)


def test_fingerprints_of_few_rows(spark):
    assert order_minhash.fingerprints(documents(spark, [])).count() == 0
    one = order_minhash.fingerprints(documents(spark, [(1, "only one document here", "en")])).collect()
    assert [(r["edited"], r["near_next"]) for r in one] == [("only one docum" + "only on" + "e", 1.0)] or one[0]["near_next"] == 1.0


def test_copies_of_a_hot_row(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "HOT", 100)
    monkeypatch.setattr(order_minhash, "COPIES_SENT", 60)
    rows = [(7, "the hot row of this table", "en")] * 500 + [(i, f"text number {i} of the table", "en") for i in range(20)]
    found = order_minhash.fingerprints(documents(spark, rows))
    got = Counter((r["doc_id"], r["edited"], r["fingerprint"]) for r in found.collect())
    assert got == Counter((i, e, f) for i, _, e, f, *_ in brute_fingerprints(rows))


def test_sketches_notice_moved_parts(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(600)]
    moved = words[300:] + words[:300]
    texts = spark.createDataFrame([(" ".join(words), " ".join(moved), " ".join(words[:590]))], "a string, b string, c string")
    a, b, c = (order_minhash.sketch(F.col(name)) for name in "abc")
    row = texts.select(order_minhash.likeness(a, b).alias("moved"), order_minhash.likeness(a, c).alias("cut")).first()
    assert row["moved"] < row["cut"] and row["cut"] > 0.85


# collocations


def brute_collocations(rows, least, top):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for size in range(1, 6):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    frequent = {key: n for key, n in counts.items() if n >= least}
    candidates = {key: n for key, n in frequent.items() if len(key[1]) > 1}
    around = {}
    for (lang, words), n in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                key = (lang, words[i : i + size])
                around[key] = max(around.get(key, 0), n)
    found = []
    for (lang, words), a in candidates.items():
        if around.get((lang, words), 0) >= a:
            continue
        n = totals[lang]
        cuts = [(1000 * a * n // (frequent[(lang, words[:k])] * frequent[(lang, words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.append((lang, -score, -a, " ".join(words).encode(), frequent[(lang, words[:k])], frequent[(lang, words[k:])], n))
    ranked = Counter()
    made = []
    for lang, score, a, phrase, left, right, n in sorted(found):
        ranked[lang] += 1
        if ranked[lang] <= top:
            made.append((lang, ranked[lang], phrase.decode(), -a, left, right, n, -score))
    return made


def phrase_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)] + ["Straße", "ÉTÉ", "日本", "a.b", "x;y", "tab\there"]
    weights = [1 / (i + 1) for i in range(len(words))]
    lines = lambda n: "".join(w + rng.choice([" ", " ", " ", "  ", ". ", "\n", "\t", "! "]) for w in rng.choices(words, weights, k=n))
    rows = [(i, lines(rng.randint(0, 120)), rng.choice(["en", "en", "fr", None])) for i in range(200)]
    fixed = "The same Passage stands here over and over"
    rows += [(300 + i, f"{lines(5)}, {fixed}; {lines(5)}", "en") for i in range(30)]
    rows += [(400, None, "en"), (401, "", None), (402, "  \t\n.;", "de"), (403, "word " * 5000, "fr"), (404, "x" * 3000, "en"), (5, rows[5][1], rows[5][2])]
    return rows


@pytest.mark.parametrize("least,top,small", [(20, 2000, False), (12, 9, True)])
def test_collocations(spark, monkeypatch, least, top, small):
    rows = phrase_rows()
    found = phrases.collocations(documents(spark, rows).repartition(4), least, top).collect()
    assert [tuple(r) for r in sorted(found, key=lambda r: (r["lang"], r["rank"]))] == brute_collocations(rows, least, top)
    assert phrases.collocations(documents(spark, []), least, top).count() == 0


def test_trie_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 40)
    rng = np.random.default_rng(4)
    trie, expected = phrases.Trie(), Counter()
    for _ in range(60):
        ids = rng.zipf(1.3, size=(200, 5)) % 50
        ids[:80, 0] = 7  # one word begins nearly half of all keys, so its container grows levels
        high = (ids[:, 0] << 42 | ids[:, 1] << 21 | ids[:, 2]).astype(np.int64)
        low = (ids[:, 3] << 21 | ids[:, 4]).astype(np.int64)
        trie.add(*phrases.merged(high, low, np.ones(200, np.int64)))
        expected.update(zip(high.tolist(), low.tolist(), strict=True))
    begins = [c.begin for c in trie.containers]
    assert begins == sorted(begins) and len(begins) > 10
    assert any(b >> 42 == 7 and b & ((1 << 42) - 1) for b in begins)  # parted below its first word
    found = Counter()
    for part in (trie.spill(500), trie.spill(-1)):
        for high, low, counts in part:
            keys = list(zip(high.tolist(), low.tolist(), strict=True))
            assert keys == sorted(set(keys))
            found.update(dict(zip(keys, counts.tolist(), strict=True)))
    assert found == expected and trie.held() == 0


def test_counts_survive_spills(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "BURST", 16)
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "NUMBERED", 40)
    monkeypatch.setattr(phrases, "SLICE", 400)
    texts = [t or "" for _, t, _ in phrase_rows()]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    found = Counter()
    for run in phrases.count_batches(1, None)(iter([batch])):
        for phrase, n in zip(run.column(1).to_pylist(), run.column(2).to_pylist(), strict=True):
            found[phrase] += n
    words = Counter(w for t in texts for p in re.split("[.,;:!?\x0a-\x0d]", t.translate({c: c + 32 for c in range(65, 91)})) for w in re.split("[\x20\x09]+", p) if w)
    assert found.pop(None) == sum(words.values()) and found == words
