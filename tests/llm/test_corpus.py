"""Near duplicates, tokens, packing, fingerprints, toxicity and the pipeline against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from isogrid.llm import fingerprints, ngram_join, packing, token_binary, tokens, toxicity
from isogrid.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


def edit(rng, words, share):
    words = list(words)
    for _ in range(max(1, int(len(words) * share))):
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 1)] = [f"e{rng.randrange(10**6)}"] * rng.randint(0, 2)
    return words


def brute_links(texts, width, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates_match_brute_force(spark, width, percent):
    rng = random.Random(width)
    shared = [f"p{i}" for i in range(60)]
    texts = ["", None, "One Two", "one two", "one", " \n", "a b c", "a b c d"]
    for size in [3, 5, 8, 9, 10, 11, 12, 15, 18, 20, 25, 30, 40, 60, 90, 150, 400]:
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(7):
            texts.append(" ".join(edit(rng, base, rng.choice([0, 0.01, 0.02, 0.04, 0.06]))))
        texts.append(" ".join(shared + base))
        texts.append(" ".join(base).upper())
        texts.append(" ".join(base[:-1]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(docs(spark, texts), width=width, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_links(texts, width, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_keys_meet_for_all_linked_sets(percent):
    """Pigeonhole, on small sets where segments are often empty: any two sets that link share a key."""
    rng = np.random.default_rng(percent)
    for _ in range(4000):
        n = int(rng.integers(1, 60))
        pool = rng.integers(0, 2**63, n + 12, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        a = np.unique(pool[:n])
        drop = int(rng.integers(0, n // 8 + 2))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], pool[n : n + int(rng.integers(0, n // 8 + 2))]]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            assert len(np.intersect1d(ngram_join.keys_of(a, percent), ngram_join.keys_of(b, percent))), (len(a), len(b), both)


@pytest.mark.parametrize("percent", [60, 75, 80, 90])
def test_allotments_in_any_order_meet_and_keep_their_budget(percent):
    """Whatever the order of costs, linked sets share a key; a set with enough segments has just H + 1 keys a band."""
    rng = np.random.default_rng(percent + 1)
    linked = 0
    for round_ in range(1500):
        ranks = {k: rng.permutation(ngram_join.band(k, percent)[3]) for k in range(20)}
        n = int(rng.integers(1, 80))
        pool = rng.integers(0, 2**63, 2 * n + 2, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        a = np.unique(pool[:n])
        drop = int(rng.integers(0, n * (100 - percent) // 90 + 2))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], pool[n : n + int(rng.integers(0, n * (100 - percent) // 90 + 2))]]))
        found = ngram_join.segment_keys(a, percent)
        again = ngram_join.unpacked(ngram_join.packed(found, percent), len(a), percent)
        assert all(x[0] == y[0] and all((p == q).all() for p, q in zip(x[1:], y[1:])) for x, y in zip(found, again)) and len(found) == len(again)
        for one in found:
            if len(one[1]) > ngram_join.band(one[0], percent)[2]:
                assert len(ngram_join.allotted([one], percent, ranks)) == ngram_join.band(one[0], percent)[2] + 1
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            linked += 1
            assert len(np.intersect1d(ngram_join.keys_of(a, percent, ranks), ngram_join.keys_of(b, percent, ranks))), (len(a), len(b), both)
    assert linked > 200


def test_costs_put_hot_segments_last(spark):
    """Sets that all hold the same elements of one segment: that segment comes last, and allotments leave it out."""
    rng, percent, rows = np.random.default_rng(1), 80, []
    k = ngram_join.bands_of(60, percent)[0]
    segments = ngram_join.band(k, percent)[3]
    width = 2**32 // segments + 1
    hot = np.array([(5 * width + 7) << 32], np.uint64)
    for _ in range(50):
        s = rng.integers(0, 2**63, 70, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        s = np.unique(np.concatenate([s[(s >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32) != 5][:59], hot]))
        rows.append((len(s), ngram_join.packed(ngram_join.segment_keys(s, percent), percent)))
    ranks = ngram_join.segment_ranks(spark.createDataFrame(rows, "n long, keys binary"), percent)
    assert ranks[k][5] == segments - 1


def test_one_of_each_group_decides_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    frame = spark.createDataFrame([(7, a, 1), (7, b, 2), (3, b, 3), (None, b, 4), (9, c, 5), (9, c, 5), (None, "", 6), (None, None, 7), (None, "", 6)], "doc_id long, text string, _name int")
    kept = ngram_join.one_of_each_group(frame.withColumn("gone_id", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "_name", "gone_id"]
    assert sorted((r["_name"] for r in kept.collect())) == [1, 3, 5, 6, 6, 7]


def test_near_duplicates_odd_tables(spark):
    frame = docs(spark, ["a b c d", "a b c d", "a b c d", None, "x y z"], [7, 7, None, 3, 7])
    rows = ngram_join.link_documents(frame.withColumn("n", frame.text).withColumn("component_id", frame.text)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == [("3", 0, "3"), ("7", 1, "7"), ("7", 2, "7"), ("7", 2, "7"), ("None", 2, "7")]
    assert ngram_join.link_documents(frame.where("false")).count() == 0
    kept = ngram_join.one_of_each_group(docs(spark, ["a b c d e f"] * 3 + ["other text here", "", None], [4, 2, 2, 9, 1, 5])).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 5, 9]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 560)] + [(100, 90)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got.values()) == {90, 500} and all(got[i] == 90 for i in range(100, 161)) and len(got) == 61 + 59


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", None, "a", "two  spaces\n\n\tand  \n tabs ", "don't we'll 123 45", "é\xa0 b\u3000 c", "日本 語 text", "\x1c x \x1c!", "a\x85 b", "emoji 😀 end", " ".join(f"w{i}" for i in range(9000)), "<|endoftext|> inside", "trail "]


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_stretchwise_encoding_equals_whole_encoding(tokenizer, spark):
    real = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text, blob in zip(TEXTS + real, enc.encode(TEXTS + real)):
        assert np.frombuffer(blob, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_binary, "BLOCK_TOKENS", 500)
    order = list(range(len(TEXTS)))
    random.Random(3).shuffle(order)
    got = {r["doc_id"]: r for r in token_binary.round_trip(docs(spark, [TEXTS[i] for i in order], order)).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = ids_of(tokenizer, t, 0)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc(ids)), i
        start += len(ids)
    assert token_binary.round_trip(docs(spark, [], [])).count() == 0
    assert token_binary.round_trip(docs(spark, ["a", "a", "b"], [1, 1, None])).count() == 3


def test_elias_fano_select():
    rng = np.random.default_rng(0)
    for n, top in ((1, 0), (1, 9), (5, 5), (300, 10**6), (1000, 1200), (64, 1), (129, 2**40)):
        values = np.sort(rng.integers(0, top + 1, n))
        ef = token_binary.EliasFano.of(values)
        assert ef.values().tolist() == values.tolist() and [ef.select(k) for k in range(n)] == values.tolist()
    assert token_binary.EliasFano.of(np.array([], np.int64)).values().tolist() == []


def check_packing(rows, want, window=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == want.keys()
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(want[i])
            assert p["ids_crc32"] == crc(want[i][at : at + p["length"]])
            at += p["length"]
        assert at == len(want[i])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_real_documents(spark, tokenizer):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: ids_of(tokenizer, r["text"], 1) for r in frame.collect()}
    assert check_packing(packing.pack(frame).collect(), want) == 0


def test_packing_odd_tables(spark, tokenizer):
    texts = [*TEXTS, *(["same text again"] * 40)]
    want = {i: ids_of(tokenizer, t, 1) for i, t in enumerate(texts)}
    assert check_packing(packing.pack(docs(spark, texts)).collect(), want) == 0
    assert packing.pack(docs(spark, [], [])).count() == 0
    assert sum(r["length"] for r in packing.pack(docs(spark, ["a", "a", "b"], [1, 1, None])).collect()) == 6


def test_packing_plan_uses_combinations():
    histogram = np.zeros(2048, np.int64)
    histogram[[512, 1536, 1024, 1]] = [50, 50, 31, 7]
    rows, sequences = packing.plan(histogram)
    placed = sum(v * (b - a) for v, a, b, _, _ in rows)
    assert placed == sequences * 2048 and sequences >= 60


def test_fingerprints_match_brute_force_parts(spark):
    texts = ["alpha beta gamma delta " * 3, "beta gamma", "", None, "x", "the quick brown fox jumps", "the quick brown fox jumps"]
    ids = [5, 9, 1, 30, 22, 14, 40]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs(spark, texts, ids)).collect()}
    chain = sorted(zip(ids, texts))
    for n, (i, t) in enumerate(chain):
        t, following = t or "", chain[(n + 1) % len(chain)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[14]["fingerprint"] == got[40]["fingerprint"] and got[1]["near_edited"] == 1.0
    assert fingerprints.fingerprints(docs(spark, [], [])).count() == 0
    assert fingerprints.fingerprints(docs(spark, ["a", "a", "b"], [1, 1, None])).count() == 3


def test_fingerprints_tell_edits_from_other_texts(spark):
    rows = fingerprints.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert np.mean([r["near_edited"] for r in rows]) > 3 * np.mean([r["near_next"] for r in rows])


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == t for p, t in held]) > 0.93
    assert np.mean([p for p, t in held if t]) > 0.6


def test_toxicity_keeps_the_class_rate_where_the_sample_is_bounded(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega"], k=20)) for _ in range(800)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(800)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "MOST_LABELLED", 80)
    scores = [r["score"] for r in toxicity.score(docs(spark, texts), labels).collect()]
    assert 0.05 < np.mean(scores) < 0.2


def test_toxicity_odd_tables(spark):
    frame = docs(spark, ["you idiot moron", "fine text", None, "", "fine text"], [1, 2, 3, None, 2])
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(frame, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(frame, labels.where("false")).count() == 5
    assert toxicity.score(frame.where("false"), labels).count() == 0
