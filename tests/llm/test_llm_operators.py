"""The text operators against brute force, the libraries and odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import decontaminate, exact_dedup, language, near_dup, pieces, sharding, token_counts, token_files, toxicity, url_filter
from tidemark.llm.queries import URL_RULES, vocabulary

MODEL = vocabulary("piece_bpe_32k.model")
JSON = vocabulary("byte_bpe_50k.json")
# Columns that clash with working and result columns of the operators.
SCHEMA = "doc_id long, text string, shard int, kept string, k long, words string, lang string, size long, name string, sha string, node string, row string"
ODD = [None, "", " ", "\n\t", "a", "A  a", "One two three four five six.", "one two three four five six.", "日本語のテキスト", "▁x ▁▁ y", "ﬁ é é\u3000z\u00a0q", "\x00a\tb\r\n\n c", "<s> </s> <0x0A> <|endoftext|> z", "x" * 3000, "word " * 9000, "é" * 500 + " ê"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "no", 2, "w", "en", 3, "n", "s", "o", "r") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = list(enumerate(ODD)) + [(3, "repeated row"), (3, "repeated row"), (None, "no id"), (None, None), (None, "no id")]
    return rows, frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def squeezed(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


# exact dedup


def test_exact_dedup(odd):
    rows, docs = odd
    found = exact_dedup.decisions(docs, capacity=64).collect()
    assert len(found) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(squeezed(t), []).append((-len(t or ""), i is None, i or 0))
    digests = {hashlib.sha256(s.encode()).hexdigest(): (min(g), len(g)) for s, g in groups.items()}
    for row in found:
        (_, unnamed, keep), size = digests[row["sha"]]
        assert row["keep_id"] == (None if unnamed else keep) and row["group_size"] == size
    assert sum(r["kept"] for r in found) == len(groups)
    assert len({r["bucket"] for r in found}) > 1


def test_exact_dedup_rows(odd, empty):
    rows, docs = odd
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted(squeezed(r["text"]) for r in left.collect()) == sorted({squeezed(t) for _, t in rows})
    assert exact_dedup.decisions(empty).count() == 0 == exact_dedup.drop_exact_copies(empty).count()


def test_directory_doubles():
    load = {0: 100, 1: 100, (1 << exact_dedup.MAX_DEPTH) - 1: 5}
    depth, slots = exact_dedup.double_directory(load, 100)
    assert depth == exact_dedup.MAX_DEPTH and len(slots) == 1 << depth
    assert slots[0] != slots[1] and slots == sorted(slots)
    assert slots[-1] == slots[len(slots) // 2]  # the light half was never split
    assert exact_dedup.double_directory({}, 1) == (0, [0])


def test_colliding_keys_are_chained(spark, monkeypatch):
    from pyspark.sql import functions as F

    plain = exact_dedup.keyed
    monkeypatch.setattr(exact_dedup, "keyed", lambda docs: plain(docs).withColumn("k", F.lit(7).cast("long")))
    found = exact_dedup.decisions(frame(spark, [(1, "a"), (2, "b"), (3, "a ")])).collect()
    assert {(r["doc_id"], r["keep_id"], r["chained"]) for r in found} == {(1, 3, 2), (2, 2, 2), (3, 3, 2)}


def test_owners_settle_copies_of_all_readers(spark):
    """Half of the rows are one text, read by many tasks; copies are combined before the exchange to owners, which is the last."""
    from pyspark.sql import functions as F

    docs = spark.range(0, 6_000, 1, 24).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t"), (F.col("id") % 501))).alias("text")
    )
    found = {r["sha"]: r for r in exact_dedup.decisions(docs, capacity=64).where("kept").collect()}
    assert len(found) == len({i % 501 for i in range(1, 6_000, 2)}) + 1
    hot = found[hashlib.sha256(b"hottext").hexdigest()]
    assert (hot["keep_id"], hot["group_size"], hot["chained"]) == (0, 3_000, 1)
    directory = F.broadcast(spark.createDataFrame([(0, 0)], "slot long, bucket int"))
    plan = exact_dedup.owned(exact_dedup.keyed(docs), directory, 0)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line.strip(" +-:") for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2 and "hashpartitioning(bucket" in shuffles[0] and "reader" in shuffles[1]


# shards


def expected_shards(rows, n):
    key = lambda i, t: (hashlib.md5((t or "").encode()).hexdigest(), hashlib.md5(("" if i is None else str(i)).encode()).hexdigest())
    size = lambda t: len((t or "").encode()) + 16
    total, largest = sum(size(t) for _, t in rows), max(size(t) for _, t in rows)
    ordered = sorted(((key(i, t), size(t), i) for i, t in rows), key=lambda r: r[0])
    shards, before, group_start = [], 0, {}
    held = {}
    for k, s, _ in ordered:
        held[k[0]] = held.get(k[0], 0) + s
    for k, s, i in ordered:
        start, own = group_start.setdefault(k[0], before), before
        whole = held[k[0]] * n * sharding.WHOLE <= total or held[k[0]] <= largest
        shards.append((i, n * (start if whole else own) // total))
        before += s
    return sorted(shards, key=repr)


@pytest.mark.parametrize("n", [1, 3, 40])
def test_shards(odd, n):
    rows, docs = odd
    found = sharding.assign(sharding.keyed(docs), n)
    assert collected(found, "doc_id", "shard") == expected_shards(rows, n)
    slots = {}
    for shard, slot in collected(found, "shard", "slot"):
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_repeated_rows_are_parted(spark):
    rows = [(7, "the same row again " * 8)] * 1000 + [(1000 + i, f"text {i} " * 12) for i in range(2000)]
    found = sharding.assign(sharding.keyed(frame(spark, rows).repartition(5)), 40).collect()
    sizes, slots = {}, {}
    for r in found:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    largest = max(r["size"] for r in found)
    assert len(found) == 3000 and len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 4 * largest
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_many_boundaries(spark):
    from tidemark.llm.common import place_in

    bounds = sorted(f"{hashlib.md5(str(n).encode()).hexdigest()}~" for n in range(25_000))
    keys = [hashlib.md5(f"k{n}".encode()).hexdigest() for n in range(200)] + [bounds[0], bounds[-1], bounds[77], "", "~"]
    from bisect import bisect_left

    from pyspark.sql import functions as F

    found = spark.createDataFrame([(k,) for k in keys], "key string").select("key", place_in(bounds, F.col("key")).alias("at")).collect()
    assert [(r["key"], r["at"]) for r in found] == [(k, bisect_left(bounds, k)) for k in keys]


def test_hot_text_is_split_by_id(spark):
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(400)]
    found = sharding.assign(sharding.keyed(frame(spark, rows)), 8).collect()
    sizes = {}
    for r in found:
        sizes.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert len(sizes) == 8
    totals = [sum(s for _, s in v) for v in sizes.values()]
    assert max(totals) - min(totals) <= 4 * 30
    assert all(sorted(slot for slot, _ in v) == list(range(len(v))) for v in sizes.values())


def test_shard_documents(odd, empty):
    rows, docs = odd
    whole = sharding.shard_documents(docs, 5)
    assert whole.columns == [*docs.drop("shard").columns, "shard", "slot"] and whole.count() == len(rows)
    assert sharding.assign(sharding.keyed(empty), 40).count() == 0


# pieces


def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_the_library(odd, empty):
    rows, docs = odd
    theirs = library()
    found = pieces.encoded(docs, MODEL).collect()
    expected = [(i, theirs.encode(t or ""), theirs.decode(theirs.encode(t or ""))) for i, t in rows]
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in found), key=repr) == sorted(expected, key=repr)
    assert pieces.encoded(empty, MODEL).count() == 0


def random_text(rng):
    alphabet = "ab éß日本 \n\t  ▁.,'’-0123\u200b\x00\u2028ñ😀<>s/"
    words = ["the", "Tionn", "können", "\n\n", "   ", "a1b2", "naïve", "日本語", "don't", "x" * 40, "https://a.b/c?d", "<|endoftext|>", "\t\t", "\u3000", "\x1c", "\x85"]
    parts = [rng.choice(words) if rng.random() < 0.5 else "".join(rng.choices(alphabet, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 40))]
    return rng.choice(["", " ", "\n"]).join(parts)


def test_pieces_on_random_texts():
    rng, own, theirs = random.Random(5), pieces.load(MODEL), library()
    for _ in range(1500):
        text = random_text(rng)
        ids = np.frombuffer(own.encode(text), "<i4").tolist()
        assert ids == theirs.encode(text), repr(text)
        assert own.decode(ids) == theirs.decode(ids), repr(text)


def test_other_vocabularies_are_refused():
    own = pieces.Pieces(MODEL)
    own.cost = dict.fromkeys(own.cost, 0.0)  # scores that are not the library's
    texts = ["unbelievable internationalisation"]
    made = [own.encode(t) for t in texts]
    with pytest.raises(ValueError, match="differ"):
        own.check(texts, made, [own.decode(np.frombuffer(m, "<i4").tolist()) for m in made])


# token files


def test_token_files(spark, odd, folder):
    from tokenizers import Tokenizer

    rows, docs = odd
    path = f"{folder}/ids"
    token_files.write_token_files(docs, path, JSON)
    tokenizer = Tokenizer.from_file(JSON)
    encode = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    read = token_files.read_token_files(spark, path).collect()
    assert sorted((repr((r["doc_id"], r["ids"])) for r in read)) == sorted(repr((i, encode(t))) for i, t in rows)
    place = 0
    for r in sorted(read, key=lambda r: r["start"]):
        assert r["start"] == place
        place += len(r["ids"])
    order = [r["doc_id"] for r in sorted(read, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    sums = token_files.checksums(token_files.read_token_files(spark, path)).collect()
    assert {r["start"]: r["ids_crc32"] for r in sums} == {r["start"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in read}
    assert [tuple(r) for r in token_files.look_up(spark, path, [6]).collect()] == [(6, encode(ODD[6]))]


def test_token_files_of_nothing(spark, empty, folder):
    path = f"{folder}/none"
    token_files.write_token_files(empty, path, JSON)
    assert token_files.read_token_files(spark, path).count() == 0


def test_segments_on_random_texts():
    from tokenizers import Tokenizer

    rng, own, tokenizer = random.Random(6), token_files.load(JSON), Tokenizer.from_file(JSON)
    for _ in range(1500):
        text = random_text(rng)
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


# token counts


@pytest.mark.parametrize("chunk", [50, 32_768])
def test_token_counts(odd, empty, chunk):
    rows, docs = odd
    theirs = library()
    found = token_counts.counted(docs, MODEL, chunk=chunk, overlap=8)
    expected = sorted(((i, len((t or "").encode()), len(theirs.encode(t or ""))) for i, t in rows), key=repr)
    assert collected(found, "doc_id", "n_bytes", "n_tokens") == expected
    assert token_counts.counted(empty, MODEL).count() == 0


def test_json_counts(odd):
    from tokenizers import Tokenizer

    rows, docs = odd
    tokenizer = Tokenizer.from_file(JSON)
    expected = sorted(((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)
    assert collected(token_counts.counted(docs, JSON), "doc_id", "n_tokens") == expected


def test_unspaced_texts_widen_their_overlap(spark):
    rng = random.Random(3)
    text = "".join(rng.choices("etaoins", k=5000))
    found = token_counts.counted(frame(spark, [(1, text)]), MODEL, chunk=64, overlap=2).collect()
    assert found[0]["n_tokens"] == len(library().encode(text))


# decontamination


def test_decontamination(spark, empty):
    words = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(words[:20])), (2, "Only Four Words here"), (3, " ".join(words[5:18])), (4, None), (5, "--"), (3, " ".join(words[5:18]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [None, "", "--", " ".join(words[:13]), "x " * 300 + "ONLY four-words, here", " ".join(words[:12]), "y " * 100 + " ".join(words[3:19]), " ".join(words[:20] * 3)]
    rows = [*enumerate(texts), (4, texts[4]), (None, texts[3])]
    found = {(r["doc_id"], r["n_words"]): r for r in decontaminate.judged(frame(spark, rows), bench).collect()}

    runs = []
    for item, text in items:
        own = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
        n = min(13, len(own))
        runs += [(item, own[i : i + n]) for i in range(len(own) - n + 1) if n]
    for i, text in rows:
        own = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        met = [(at, item, run) for item, run in runs for at in range(len(own) - len(run) + 1) if own[at : at + len(run)] == run]
        hit = {at + k for at, _, run in met for k in range(len(run))}
        names = sorted({str(item) for _, item, _ in met})
        row = found[i, len(own)]
        assert (row["n_hit"], row["n_items"], row["items_sha256"]) == (len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest())
        assert row["contaminated"] == (bool(hit) and 20 * len(hit) >= len(own))
    left = decontaminate.drop_contaminated(frame(spark, rows), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 1, 2, 4, 4, 5]
    assert decontaminate.judged(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.judged(frame(spark, rows), bench.limit(0)).collect())


def test_spans_are_cut(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = [(1, "x A-b, c y"), (2, "a b d"), (3, None)]
    assert collected(decontaminate.cut_spans(frame(spark, rows), bench), "doc_id", "text") == [(1, "x y"), (2, "a b d"), (3, None)]


# language


def language_rows(n=60):
    rng = random.Random(1)
    english, german = "the and of with house water think through".split(), "der und nicht mit haus wasser über schön".split()
    return [(i, " ".join(rng.choices(english, k=30)), "en") for i in range(n)] + [(n + i, " ".join(rng.choices(german, k=30)), "de") for i in range(n)] + [(2 * n + i, "привет мир как дела " * 5, "ru") for i in range(n)]


def test_language(spark):
    docs = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    model = language.fit(docs, F.lit(True))
    texts = [(1, "the house of water and the water " * 6 + "der schön und nicht wasser über " * 3), (2, None), (3, ""), (4, "123 !!"), (5, "привет"), (6, "mit wasser"), (6, "mit wasser"), (None, "the the"), (8, "日本語")]
    found = language.labelled(frame(spark, texts), model).collect()
    assert sorted(repr((r["doc_id"], r["lang_pred"])) for r in found) == sorted(map(repr, [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "ru"), (6, "de"), (6, "de"), (None, "en"), (8, model.languages[0])]))
    mixed = next(r for r in found if r["doc_id"] == 1)
    assert [s["lang"] for s in mixed["spans"]] == ["en", "de"] and [s["words"] for s in mixed["spans"]] == [42, 18]
    assert 0.5 < mixed["score"] < 1
    left = language.keep_identified(frame(spark, texts), model)
    assert left.columns == frame(spark, []).columns and sorted(repr(r["doc_id"]) for r in left.collect()) == sorted(map(repr, [1, 5, 6, 6, None]))
    assert language.labelled(frame(spark, []), model).count() == 0
    nothing = language.fit(docs, F.lit(False))
    assert {r["lang_pred"] for r in language.labelled(frame(spark, texts), nothing).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(2)
    lengths = np.array([1, 6, 4])
    loss = rng.random((11, 3)) * 4
    labels = language.viterbi(loss, lengths, penalty=1.5)
    at = 0
    cost = lambda path, own: sum(own[i, p] for i, p in enumerate(path)) + 1.5 * sum(a != b for a, b in itertools.pairwise(path))
    for n in lengths:
        own = loss[at : at + n]
        best = min(cost(path, own) for path in itertools.product(range(3), repeat=int(n)))
        assert cost(labels[at : at + n].tolist(), own) == pytest.approx(best)
        at += n


# toxicity


def test_grammar():
    model = toxicity.Model({"lowei*": 6.0}, 1.0, -1.0, "k")
    tokens = toxicity.Tokens(model)
    score = lambda text: toxicity.evidence(tokens, text)[0]
    assert score("a nice house.") == 0 == score("")
    assert score("what an idiot.") == 4.0
    assert score("you are an idiot.") == 6.0 > score("what an idiot.") > score("he wrote: no. she said you idiot") > score("not an idiot")
    assert score("She said idiot. Idiot!") == 2.0 + 4.0  # a clause's end closes the quotation
    assert score("Loweiig house") == 6.0
    assert toxicity.evidence(tokens, "fine. you idiot! fine")[1] == [(1, 2, 6.0)]


def test_toxicity(spark):
    rng = random.Random(4)
    plain = "house water stone river cloud meadow window paper letter garden".split()
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=40)
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(40), "zorgle" + rng.choice(["n", "st", "ty"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [labels[0], (None, 1), (9_999, None)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows[:300]), table)
    found = {r["doc_id"]: r["score"] for r in toxicity.scored(frame(spark, rows), model).collect()}
    assert all((found[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    odd_rows = [(1, None), (2, ""), (3, "zorglen " * 5000), (3, "zorglen " * 5000), (None, "you zorglen")]
    scores = [r["score"] for r in toxicity.scored(frame(spark, odd_rows), model).orderBy("doc_id").collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores) and scores[3] == scores[4] > 0.5 > scores[1] == scores[2]
    assert toxicity.scored(frame(spark, []), model).count() == 0
    assert toxicity.fit(frame(spark, rows), table.limit(0)).stems == {}


# urls


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?y#z", "http://net/x", "http://net", "http://my-net.org/fr/", "http://org.com/fr/", "https://x.example.com/de/1", "https://x.example.com/de", "a://b://c/d", "http://sub.example.net?/en/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(3, urls[3], None)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in url_filter.verdicts(pages, URL_RULES).collect()}
    assert len(found) == len(urls)
    assert [found[i]["host"] for i in range(len(urls))] == ["", "", "", "a.example.net", "net", "net", "my-net.org", "org.com", "x.example.com", "x.example.com", "b:", "sub.example.net"]
    assert [found[i]["path"] for i in range(len(urls))] == ["", "", "", "/en/x", "/x", "", "/fr/", "/fr/", "/de/1", "/de", "//c/d", ""]
    assert [found[i]["rule"] for i in range(len(urls))] == [None, None, None, "example.net/en/", "net/", None, "org/fr/", None, "example.com/de/", None, None, None]
    assert found[0]["verdict"] == "allow" and found[4]["verdict"] == "block" and found[6]["verdict"] == "allow"
    assert url_filter.verdicts(pages.limit(0), URL_RULES).count() == 0


def brute_rank(edges, seeds, hosts, rounds=url_filter.ROUNDS, damping=url_filter.DAMPING):
    total = sum(seeds.values())
    if not total:
        return dict.fromkeys(hosts, 0.0)
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    rank = {h: seeds[h] / total for h in hosts}
    for _ in range(rounds):
        held = sum(r for h, r in rank.items() if h not in out)
        flow = dict.fromkeys(hosts, 0.0)
        for (a, b), n in edges.items():
            flow[b] += rank[a] * n / out[a]
        rank = {h: seeds[h] / total * (1 - damping + damping * held) + damping * flow[h] for h in hosts}
    return rank


def test_link_graph(spark):
    link = lambda *hosts: "".join(f'<a href="//{h}/x">z</a><a href="/local">l</a>' for h in hosts)
    pages = [
        (1, "http://good.org/fr/1", link("friend.com", "friend.com")), (2, "http://friend.com/", link("other.com")), (3, "http://bad.net/", None),
        (4, "http://spam.com/", link("bad.net")), (5, "http://spam.com/2", link("bad.net", "other.com")), (6, "http://other.com/", ""), (7, "http://www.friend.com/", ""),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in url_filter.verdicts(table, URL_RULES).collect()}
    assert {i: r["verdict"] for i, r in found.items()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow"}
    hosts = ["good.org", "friend.com", "bad.net", "spam.com", "other.com", "www.friend.com"]
    edges = {("good.org", "friend.com"): 2, ("friend.com", "other.com"): 1, ("spam.com", "bad.net"): 2, ("spam.com", "other.com"): 1, ("www.friend.com", "friend.com"): 1, ("friend.com", "www.friend.com"): 1}
    trust = brute_rank(edges, {h: int(h == "good.org") for h in hosts}, hosts)
    distrust = brute_rank({(b, a): n for (a, b), n in edges.items()}, {h: int(h == "bad.net") for h in hosts}, hosts)
    for r in found.values():
        assert r["trust"] == pytest.approx(trust[r["host"]], abs=1e-9) and r["distrust"] == pytest.approx(distrust[r["host"]], abs=1e-9)


# near duplicates


def brute_classes(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = min(5, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        held = least.get(root(i))
        least[root(i)] = doc_id if held is None else held if doc_id is None else min(held, doc_id)
    return sorted(((doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows)), key=repr)


def copies(rng, base, n, edits):
    made = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        made.append(" ".join(words))
    return made


def test_near_duplicates(spark, odd, empty):
    rng = random.Random(8)
    text = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    texts = []
    for _ in range(12):
        texts += copies(rng, text(rng.randint(60, 300)), rng.randint(2, 12), 4)
    texts += copies(rng, text(80), 70, 3)  # a large group whose members link in part only
    texts += [text(100) for _ in range(60)]
    rows = list(enumerate(texts, 100)) + odd[0]
    docs = frame(spark, rows)
    found = near_dup.near_duplicates(docs)
    assert collected(found, "doc_id", "n_shingles", "component_id") == brute_classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())
    left = near_dup.drop_near_copies(docs)
    assert left.columns == docs.columns
    wordless = sum(1 for _, t in rows if not (t or "").split())
    names = found.filter("class is not null").select("class").distinct().count()
    assert left.count() == names + wordless
    assert near_dup.near_duplicates(empty).count() == 0


def test_estimate_is_near(spark):
    rng = np.random.default_rng(1)
    from pyspark.sql import functions as F

    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    rows = []
    for shared in (0, 500, 800, 950, 1000):
        other = np.unique(np.concatenate([base[:shared], rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64)]))
        bits = near_dup.packed(near_dup.minima([np.unique(base), other]))
        rows.append((shared / (2000 - shared), bits[0].tolist(), bits[1].tolist()))
    pairs = spark.createDataFrame(rows, "s double, x array<long>, y array<long>")
    for row in pairs.withColumn("e", near_dup.estimate(F.col("x"), F.col("y"))).collect():
        assert row["e"] == pytest.approx(row["s"], abs=near_dup.MARGIN)


@pytest.mark.parametrize("small", [2, 100])
def test_links_across_classes(spark, small, monkeypatch):
    """Small buckets (join) and large ones (blocks) join the same classes as all pairs do."""
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    rng = random.Random(3)
    sets = []
    for _ in range(4):
        base = rng.sample(range(1 << 60), 60)
        for _ in range(15):
            sets.append(sorted(set(rng.sample(base, 60 - rng.randint(0, 9))) | {rng.randrange(1 << 60) for _ in range(rng.randint(0, 9))}))
    labels = [bytes([n % 25, 0]) for n in range(len(sets))]
    bits = near_dup.packed(near_dup.minima([np.array(x, np.uint64) for x in sets]))
    rows = [(n % 2 + m, bytearray([n, 0]), bytearray(labels[n]), bits[n].tolist()) for n in range(len(sets)) for m in (0, 1)]
    members = spark.createDataFrame(rows, "bucket long, node binary, label binary, bits array<long>")
    held = spark.createDataFrame([(bytearray([n, 0]), x) for n, x in enumerate(sets)], "node binary, shingles array<long>")
    found = [(bytes(r["a"])[0], bytes(r["b"])[0]) for r in near_dup._across(members, held, 85).collect()]

    def near(a, b):
        both = len(set(sets[a]) & set(sets[b]))
        return 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both)

    def joined(pairs):
        parent = {lab: lab for lab in labels}

        def root(n):
            while parent[n] != n:
                n = parent[n]
            return n

        for a, b in pairs:
            parent[root(labels[a])] = root(labels[b])
        return {frozenset(lab for lab in labels if root(lab) == r) for r in map(root, labels)}

    assert all(near(a, b) for a, b in found)
    assert joined(found) == joined([(a, b) for b in range(len(sets)) for a in range(b) if near(a, b)])


def test_classes_of_a_long_chain(spark):
    n = 40
    links = spark.createDataFrame([(bytearray([i]), bytearray([i + 1])) for i in range(n)] + [(bytearray([100]), bytearray([90]))], "a binary, b binary")
    found = {bytes(r["node"])[0]: bytes(r["label"])[0] for r in near_dup.classes(links).collect()}
    assert found == {**dict.fromkeys(range(n + 1), 0), 90: 90, 100: 90}
