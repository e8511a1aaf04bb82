"""Decontamination, ranked search and source audit against plain forms, and on odd tables; and what earlier operators lacked."""

import base64
import gzip
import hashlib
import math
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from isogrid.llm import decontamination, divergence, lexical_search, ngram_join, quality, secret_scan, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string"
CLASHING = ["row", "term", "pos", "n", "window", "item", "words", "start", "score", "rank", "docs", "held", "part", "value", "Text2", "lang2"]


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def texts(rng, n):
    """Prose of few words with marks between, upper case, other scripts, long words, and passages that are shared."""
    words = ["the", "of", "And", "x1", "Straße", "дом", "tea-pot", "a", "IT", "extraordinarily", "pneumonoultramicroscopic", "ñandú", "７", "e" * 40, "ﬁve", "9"]
    shared = [" ".join(rng.choices(words, k=14)) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.3 else " ".join(rng.choices(words, k=rng.randrange(9))) for _ in range(rng.randrange(7))]
        out.append(rng.choice([" ", ", ", "\n", "\x00", "_"]).join(parts))
    return out, shared


def tables(spark, seed=1, n=120):
    rng = random.Random(seed)
    found, shared = texts(rng, n)
    docs = [(k, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", None, ""])) for k, t in enumerate(found)]
    docs += [docs[5], docs[5], (None, shared[0], "en", "s1"), (None, None, None, None), (900, "", "fr", "s9"), (901, "the of and " * 30_000, "en", "s2"), (902, None, "fr", "s8")]
    items = [(k, t) for k, t in enumerate(shared)] + [(10, "of the"), (11, "the"), (12, None), (13, ""), (14, " ".join(shared[0].split()[:10]).upper()), (10, shared[1]), (None, shared[2]), (15, "nowhere word")]
    frame = spark.createDataFrame(docs, DOCS).repartition(5)
    return docs, items, frame.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING))), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x")).withColumn("term", F.lit(1))


def plain_hits(docs, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for name, text in items:
        ws = word.findall(lowered(text))
        for k in range(max(1, len(ws) - width + 1) if ws else 0):
            windows[tuple(ws[k : k + width])].add("" if name is None else str(name))
    out = []
    for name, text, *_ in docs:
        ws, hit, found = word.findall(lowered(text)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(ws) - n + 1):
                if owners := windows.get(tuple(ws[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= owners
        out.append((name, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def test_decontamination_equals_brute_force(spark):
    docs, items, frame, bench = tables(spark)
    got = decontamination.decontaminate(frame, bench)
    rows = got.collect()
    assert sorted(str(tuple(r)[:6]) for r in rows) == plain_hits(docs, items)
    assert all(r["n_near_items"] >= r["n_items"] for r in rows) and sum(r["n_items"] > 0 for r in rows) > 40


def test_decontamination_by_shuffles_gives_the_same(spark, monkeypatch):
    """With all bounds of broadcasts at nothing, and without the help of any order of partitions."""
    docs, items, frame, bench = tables(spark, seed=2, n=60)
    monkeypatch.setattr(decontamination, "small_broadcast", lambda df, most=0: df)
    assert sorted(str(tuple(r)[:6]) for r in decontamination.decontaminate(frame, bench).collect()) == plain_hits(docs, items)


def test_proximity_matches_by_hand(spark):
    phrase = "one two three four five six seven eight nine ten"
    cases = {1: phrase, 2: phrase.replace("seven ", "").replace("nine", "other"), 3: phrase.replace("five", "five really"), 4: "ten nine eight seven six five four three two one", 5: phrase.replace("two three four", "x y z"), 6: f"{phrase} and {phrase.replace('ten', 'end')}"}
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in cases.items()], DOCS)
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["n_near_items"]) for r in decontamination.decontaminate(docs, spark.createDataFrame([(1, phrase)], "item_id long, text string")).collect()}
    assert got == {1: (10, 1, 1), 2: (0, 0, 1), 3: (0, 0, 1), 4: (0, 0, 0), 5: (0, 0, 0), 6: (10, 1, 1)}


def plain_search(docs, items, most=20):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(name, Counter(word.findall(lowered(text)))) for name, text, *_ in docs]
    bags = [(name, bag, bag.total()) for name, bag in bags if bag]
    total, everything, df = len(bags), sum(n for *_, n in bags), Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for name, text in items:
        scores = []
        for doc, bag, n in bags:
            m = 75 + (25 * n * total) // everything
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in word.findall(lowered(text)) if t in bag)
            if s > 0:
                scores.append((-s, doc is not None, doc or 0, doc))
        out += [(name, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:most])]
    return sorted(map(str, out))


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_search_equals_brute_force(spark, monkeypatch, block_words):
    """In one block of items and in many, and with scores held a few at a time."""
    docs, items, frame, bench = tables(spark)
    monkeypatch.setattr(lexical_search, "BLOCK_SCORES", 60)
    found = lexical_search.search(frame, bench, block_words=block_words).collect()
    assert sorted(str((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in found) == plain_search(docs, items)


def test_heaps_keep_the_best_whatever_the_order():
    rng = np.random.default_rng(4)
    item, score, doc = rng.integers(0, 5, 4000), rng.integers(0, 40, 4000), rng.permutation(4000)
    heaps = lexical_search.Heaps(5, 7)
    for part in np.array_split(np.arange(4000), 61):
        heaps.add(item[part], score[part], doc[part], doc[part] % 11 == 0)
    want = [x for i in range(5) for x in sorted((i, -s, d % 11 != 0, d) for k, s, d in zip(item, score, doc) if k == i and s > 0)[:7]]
    assert sorted(zip(heaps.item.tolist(), (-heaps.score).tolist(), (~heaps.null).tolist(), heaps.doc.tolist())) == sorted(want)


def plain_audit(docs):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in docs:
        lang, source, ws = lang or "", source or "", word.findall(lowered(text))
        groups[lang].add(source)
        counts[lang, source].update(ws)
        df[lang].update(set(ws))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= 3]
        share = lambda c, lang=lang, kept=kept: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(sorted(found)) if part == "pair" or k < 200]
    return sorted(map(str, out))


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_audit_equals_brute_force(spark, monkeypatch, block):
    docs, _, frame, _ = tables(spark)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", block)
    got = sorted(str((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"])) for r in divergence.audit(frame).collect())
    assert got == plain_audit(docs)


def test_audit_cuts_ties_at_the_last_rank(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.choice([1, 3, 8, 9, 16, 17, 30])))
    docs = [(k, " ".join(w for w in {word() for _ in range(300)} for _ in range(2)), "en", f"s{k % 3}") for k in range(9)]
    docs = [*docs, *docs, *docs]
    got = sorted(str((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"])) for r in divergence.audit(spark.createDataFrame(docs, DOCS).repartition(4)).collect())
    assert got == plain_audit(docs)


def test_terms_are_counted_as_a_dictionary_does():
    rng = random.Random(6)
    found, _ = texts(rng, 80)
    groups = [rng.randrange(3) for _ in found]
    word, want = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), defaultdict(lambda: [0, 0])
    for g, t in zip(groups, found):
        for w, n in Counter(word.findall(lowered(t))).items():
            want[g, w][0] += n
            want[g, w][1] += 1
    got = {}
    for terms, group, times, docs in divergence.count_terms(np.array(groups, np.uint32), pa.array([t.encode() for t in found], pa.binary())[0:]):
        for w, g, n, d in zip(terms.to_pylist(), group.tolist(), times.tolist(), docs.tolist()):
            assert (g, w) not in got
            got[g, w] = [n, d]
    assert got == want


def test_shares_are_exact_beyond_floats():
    counts, totals = np.array([0, 7, 10**15 - 1, 10**13]), np.array([3, 10**9 + 7, 10**15 + 1, 9 * 10**15])
    assert divergence.shares(counts, totals).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(counts, totals)]


@pytest.mark.parametrize("call", [lambda d, b: decontamination.decontaminate(d, b), lambda d, b: lexical_search.search(d, b), lambda d, b: divergence.audit(d)])
def test_empty_tables(spark, call):
    _, _, frame, bench = tables(spark, n=8)
    assert call(frame.where("false"), bench).count() == 0
    assert call(frame, bench.where("false")).count() >= 0


def test_nothing_is_hit_without_items(spark):
    _, _, frame, bench = tables(spark, n=20)
    rows = decontamination.decontaminate(frame, bench.where("false")).collect()
    assert len(rows) == 27 and not any(r["contaminated"] or r["n_items"] for r in rows)
    assert lexical_search.search(frame, bench.where("false")).count() == 0


# Earlier operators


def test_form_letters_make_few_pairs(spark, monkeypatch):
    """Sets that share most segments and link with none: pairs within keys grow with the documents, not with their square."""
    seen, plain = [], ngram_join._open_pairs

    def counted(placed, main, brief, percent):
        both = placed.join(main, "key")
        pairs = both.where("c != main").groupBy("key").agg(F.count("*").alias("out")).join(both.groupBy("key").agg(F.count("*").alias("every")), "key").agg(F.sum(F.col("out") * F.col("every"))).first()[0]
        seen.append(pairs or 0)
        return plain(placed, main, brief, percent)

    monkeypatch.setattr(ngram_join, "_open_pairs", counted)
    for n in (1000, 2000):
        rng, form = random.Random(n), [f"w{k}" for k in range(60)]
        docs = [(d, " ".join([*form[:at], *(f"o{rng.randrange(10**9)}" for _ in range(12)), *form[at:]])) for d, at in ((d, rng.randrange(60)) for d in range(n))]
        docs += [(n, docs[0][1] + " more"), (n + 1, docs[1][1] + " more")]
        rows = ngram_join.link_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
        assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] != r["component_id"]} == {n: 0, n + 1: 1}
        assert sum(seen) <= 40 * n
        seen.clear()


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """Every key counts as crowded: all links come by the rarest elements."""
    monkeypatch.setattr(ngram_join, "MOST_OPEN", 1)
    rng = random.Random(12)
    base = [[f"b{k}_{w}" for w in range(rng.randrange(5, 60))] for k in range(12)]
    docs = []
    for d in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(400)}"
        docs.append((d, " ".join(words)))
    sets = {d: set(ngram_join.shingles(t, 3).tolist()) for d, t in docs}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    rows = ngram_join.link_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), percent=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == root and len(set(root.values())) < 140


def test_many_hits_take_time_in_proportion():
    rng = random.Random(1)
    runs = ["".join(rng.choices("0123456789abcdef", k=32)) for _ in range(8000)]
    began = time.perf_counter()
    base, spans = secret_scan.find_secrets("\n".join(runs) + " %41")
    assert len(base) == len(spans) == 8000 and time.perf_counter() - began < 6


def test_covered_stretches_equal_a_search_of_all():
    rng, covered, every = random.Random(2), secret_scan.Covered(), []
    for _ in range(600):
        lo = rng.randrange(200)
        hi = lo + rng.randrange(1, 30)
        assert covered.has(lo, hi) == any(a <= lo and hi <= b for a, b in every)
        covered.add(lo, hi)
        every.append((lo, hi))


def test_an_unbroken_run_is_held_in_windows():
    tracemalloc.start()
    try:
        assert secret_scan.find_secrets("see " + base64.b64encode(gzip.compress(b"x" * 20_000_000)).decode()) == ([], [])
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()


def test_a_payload_longer_than_a_window_is_read_on(monkeypatch):
    monkeypatch.setattr(secret_scan, "WINDOW_CHARS", 4096)
    monkeypatch.setattr(secret_scan, "OVERLAP_CHARS", 256)
    noise = random.Random(3).randbytes(30_000)
    inner = base64.b64encode(gzip.compress(noise + b" token=abcdefgh12 "))
    for outer in (gzip.compress(inner), zstandard.ZstdCompressor().compress(inner)):
        text = "see " + base64.b64encode(outer).decode() + " end"
        assert (4, 0, len(text) - 4) in secret_scan.find_secrets(text)[1]


@pytest.mark.parametrize("escape", [r"\u{74}", r"\U00000074", "%u0074", "\\" + "u0074", r"\x74", "&#116;", "%74"])
def test_escapes(escape):
    text = f"a {escape}oken=abcdefgh1"
    assert secret_scan.find_secrets(text) == ([], [(2, 0, len(text))])


def test_chunks_reject_what_the_whole_text_hides():
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(900)]
    prose = " ".join(rng.choices(words, k=16_000))
    noise = base64.b64encode(rng.randbytes(9_800)).decode()
    packer, at = zstandard.ZstdCompressor(level=quality.LEVEL), len(prose) // 2
    clean, mixed = quality.in_bands(prose.encode(), packer), quality.in_bands(f"{prose[:at]} {noise} {prose[at:]}".encode(), packer)
    assert clean[0] and clean[2] == 0
    assert quality.measured(f"{prose[:at]} {noise} {prose[at:]}".encode(), packer)[0] and not mixed[0] and 0.1 < mixed[2] < 0.3


def test_a_labelled_id_of_many_rows_counts_once(spark):
    docs = spark.createDataFrame([(1, f"text {k % 3}", "en", "s") for k in range(300)] + [(2, "other", "en", "s")], DOCS)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, toxicity.sampled(docs, labels, "doc_id", "text").collect())) == [("other", 0), ("text 0", 1)]


def test_globs_of_a_file(spark, tmp_path):
    rng = random.Random(9)
    names = {"".join(rng.choices("abcdefghij", k=8)) for _ in range(5000)}
    (tmp_path / "globs.txt").write_text("# hosts\n\n" + "\n".join(f"*.{n}.net/*" for n in names) + "\n*.exe \n")
    globs = url_filter.read_globs(spark, str(tmp_path / "globs.txt"))
    assert len(globs) == len(names) + 1
    urls = [f"http://a.{n}.net/x" for n in sorted(names)[:40]] + [f"http://a.{n}x.net/x" for n in sorted(names)[:40]] + ["http://b.net/run.exe"]
    began = time.perf_counter()
    verdicts = [v[3] for v in url_filter.judge(urls, (), globs)]
    assert verdicts == ["block"] * 40 + ["allow"] * 40 + ["block"] and time.perf_counter() - began < 20
    with pytest.raises(ValueError, match="more than 10"):
        url_filter.read_globs(spark, str(tmp_path / "globs.txt"), 10)
