"""Operators that SQL can't express against slow, plain forms of the same definitions; and the whole pipeline."""

import base64
import gzip
import hashlib
import math
import random
import tracemalloc
import urllib.parse
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from isogrid.llm import fingerprints, packing, quality, secret_scan, sharding, token_binary, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Toxicity


def plain_label_model(votes, start, prior, weight, rounds):
    """The same model in lists and loops; the inverse by Gauss-Jordan."""
    n, m = len(votes), len(votes[0])
    post = list(start)
    for _ in range(rounds):
        means, share = [], [[w * (1 - p) for w, p in zip(weight, post)], [w * p for w, p in zip(weight, post)]]
        for s in share:
            means.append([(sum(a * v[k] for a, v in zip(s, votes)) + 1e-9) / (sum(s) + 1e-9) for k in range(m)])
        cov = [[sum(share[c][r] * (votes[r][i] - means[c][i]) * (votes[r][j] - means[c][j]) for c in (0, 1) for r in range(n)) / sum(weight) for j in range(m)] for i in range(m)]
        cov = [[cov[i][j] * (1 if i == j else 1 - toxicity.SHRINK) + (toxicity.OWN_VARIANCE if i == j else 0) for j in range(m)] for i in range(m)]
        rows = [cov[i] + [means[1][i] - means[0][i]] for i in range(m)]
        for i in range(m):
            rows[i] = [x / rows[i][i] for x in rows[i]]
            for j in range(m):
                if j != i:
                    rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i])]
        say = [r[m] for r in rows]
        logits = [sum((v[k] - (means[0][k] + means[1][k]) / 2) * say[k] for k in range(m)) + math.log(prior / (1 - prior)) for v in votes]
        post = [1 / (1 + math.exp(-max(-8, min(8, x)))) for x in logits]
    return means, cov, post


def votes_of(rng, n, truth):
    """Three good voters, one that repeats the first, and one that knows nothing."""
    out = []
    for y in truth:
        a, b, c = (rng.choices([1, 0, -1], [8, 1.5, 0.5] if y else [0.5, 2, 7.5])[0] for _ in range(3))
        out.append([a, b, c, a if rng.random() < 0.95 else 0, rng.choice([-1, 0, 1])])
    return out


def test_label_model_matches_plain_form():
    rng = random.Random(2)
    truth = [i % 4 == 0 for i in range(120)]
    votes, start, weight = votes_of(rng, 120, truth), [0.9 if y else 0.1 for y in truth], [rng.choice([0.5, 1, 2]) for _ in truth]
    got = toxicity.label_model(np.array(votes, float), np.array(start), 0.25, np.array(weight), 3)
    means, cov, post = plain_label_model(votes, start, 0.25, weight, 3)
    assert np.allclose(got.means, means) and np.allclose(got.covariance, cov) and np.allclose(got.posterior, post, atol=1e-6)


def test_label_model_follows_votes_not_labels_and_tells_correlated_voters():
    rng = random.Random(3)
    truth = np.array([i % 4 == 0 for i in range(2000)])
    votes, wrong = np.array(votes_of(rng, 2000, truth), float), np.array([rng.random() < 0.1 for _ in truth])
    model = toxicity.label_model(votes, np.where(truth ^ wrong, 0.9, 0.1), 0.25, np.ones(2000))
    assert np.mean((model.posterior > 0.5) == truth) > 0.9  # rows with a wrong label are put right by their votes
    assert np.mean((model.posterior[wrong] > 0.5) == truth[wrong]) > 0.8
    assert model.correlations[0, 3] > 0.6 and abs(model.correlations[0, 1]) < 0.2
    assert model.means[1][0] > 0.4 and model.means[0][0] < -0.3 and abs(model.means[1][4] - model.means[0][4]) < 0.2


def test_linear_classifier_is_at_the_minimum():
    rng = np.random.default_rng(0)
    x, target, weight = rng.normal(size=(200, 4)), rng.random(200), rng.random(200) + 0.5
    w, b = toxicity.train_linear(x, target, weight)

    def loss(w, b):
        out = sum(0.5 * v * v for v in w) + 0.5e-6 * b * b
        for row, t, k in zip(x, target, weight):
            p = 1 / (1 + math.exp(-(sum(a * c for a, c in zip(row, w)) + b)))
            out -= k * (t * math.log(p) + (1 - t) * math.log(1 - p))
        return out

    least = loss(w, b)
    for k in range(4):
        for step in (-1e-2, 1e-2):
            moved = np.array(w)
            moved[k] += step
            assert loss(moved, b) > least
    assert loss(w, b + 1e-2) > least and loss(w, b - 1e-2) > least


# Sharding


@pytest.mark.parametrize(("n", "size"), [(1, 7), (3, 101), (10, 1009)])
def test_lookup_table_matches_turns_taken_one_by_one(n, size):
    names = sharding.shard_names(n)
    prefer = []
    for name in names:
        h = int(hashlib.md5(name.encode()).hexdigest(), 16)
        prefer.append([(h % size + k * (1 + (h >> 64) % (size - 1))) % size for k in range(size)])
    owner, turn = {}, 0
    while len(owner) < size:
        owner[next(s for s in prefer[turn % n] if s not in owner)] = turn % n
        turn += 1
    assert sharding.lookup_table(names, size) == [owner[s] for s in range(size)]


@pytest.mark.parametrize(("shards", "size"), [([], 7), (["a"], 8), (["a"], 1), (["a"], 49)])
def test_lookup_table_refuses_what_would_never_end(shards, size):
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(shards, size)


# Fingerprints


def test_fingerprints_match_plain_form(spark):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect()]
    words = [{w.lower() for w in t.encode().split()} for t in texts]
    count = Counter(w for ws in words for w in ws)
    band = {w for w, n in count.items() if max(2, len(texts) / 2000) <= n <= max(2, len(texts) / 5)}

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    seeds = [0, *np.random.default_rng(20_240_607).integers(0, 2**63, 64, dtype=np.int64).tolist()]
    masks = [0, *(2 ** (3 + k // 8) - 1 for k in range(64))]

    def plain(ws):
        hashes = sorted(xxhash.xxh3_64_intdigest(w) for w in (ws & band or ws))
        out = ""
        for seed, mask in zip(seeds, masks):
            mine = [h for h in hashes if mixed(h ^ seed) & mask == 0]
            out += xxhash.xxh3_64_hexdigest(b"".join(h.to_bytes(8, "little") for h in mine))[:8] if mine else "--------"
        return out

    def like(a, b):
        parts = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
        told = [x == y for x, y in parts if x + y != "-" * 16]
        return sum(told) / len(told) if told else 1.0

    got = fingerprints.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).orderBy("doc_id").collect()
    own = [plain(ws) for ws in words]
    for k, r in enumerate(got):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        new = plain({w.lower() for w in (text[: len(text) - half] + following[:half]).encode().split()})
        assert r["fingerprint"] == own[k] and r["edited_fingerprint"] == new
        assert abs(r["near_edited"] - like(own[k], new)) < 1e-12 and abs(r["near_next"] - like(own[k], own[(k + 1) % len(texts)])) < 1e-12


def test_different_short_texts_have_different_fingerprints():
    terms = np.sort(np.concatenate([fingerprints.terms_of(f"term{i}") for i in range(200)]))
    prints = {fingerprints.fingerprint(f"term{i}", terms) for i in range(200)}
    assert len(prints) == 200 and fingerprints.fingerprint("", terms) not in prints


# Secrets

SECRET = "password: hunter2hunter2"
WRAPPERS = {
    "url": urllib.parse.quote,
    "every byte": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "base64": lambda t: base64.b64encode(t.encode()).decode(),
    "gzip": lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode(),
    "zstd": lambda t: base64.b64encode(zstandard.ZstdCompressor().compress(t.encode())).decode(),
}


@pytest.mark.parametrize("outer", ["base64", "every byte", "unicode", "gzip", "zstd"])
@pytest.mark.parametrize("inner", WRAPPERS)
def test_wrapped_secrets_map_to_the_stretch_they_came_from(inner, outer):
    wrapped = WRAPPERS[outer](WRAPPERS[inner](f"some text before {SECRET} and after"))
    text = f"é plain words, then ({wrapped}) and the end"
    base, spans = secret_scan.find_secrets(text)
    assert base == []
    lo, hi = text.index("(") + 1, text.index(")")
    found = [(s, e) for s, kind, e in spans if kind == 0]
    assert found and all(lo <= s < e <= hi for s, e in found)
    if outer in ("base64", "gzip", "zstd"):
        assert found == [(lo, hi)]
    assert secret_scan.redact(text).startswith("é plain words, then (") and secret_scan.redact(text).endswith(") and the end")


def test_secret_after_much_unprintable_data_is_found():
    raw = bytes(random.Random(1).choices(range(1, 9), k=5000)) + b"token=abcdefgh12345 " + bytes(5000)
    assert secret_scan.find_secrets("x " + base64.b64encode(gzip.compress(raw, mtime=0)).decode())[1]


def test_memory_does_not_grow_with_decompressed_size():
    line = f"{'no secret in this line of text. ' * 30}\n".encode()
    text = base64.b64encode(gzip.compress(line * 20_000 + b"\n" + SECRET.encode(), mtime=0)).decode()  # about 19 MB
    tracemalloc.start()
    spans = secret_scan.find_secrets(text)[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert spans == [(0, 0, len(text))] and peak < 40 << 20


# Quality


def test_quality_verdicts_match_plain_form(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    packer = zstandard.ZstdCompressor(level=3)

    def within(raw):
        kind = sum(len(raw) > end for end in quality.LENGTH_ENDS)
        size = len(packer.compress(raw))
        if not quality.LEAST_RATIO[kind] <= size / len(raw) <= quality.MOST_RATIO[kind]:
            return False
        bare = " ".join("".join(c for c in raw.decode("latin-1") if not (33 <= ord(c) < 127 and not c.isalnum())).encode("latin-1").decode("latin-1").replace("\x0b", " ").replace("\x0c", " ").split(" ")).encode("latin-1")
        bare = b" ".join(bare.split())
        least = quality.LEAST_DILUTION[kind]
        return least == 0 or (len(bare) > 0 and size / len(raw) / (len(packer.compress(bare)) / len(bare)) >= least - 1e-12)

    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    for r in quality.assess(frame).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        words = raw.split()
        threes = Counter(zip(words, words[1:], words[2:]))
        again = {k + d for k in range(len(words) - 2) if threes[words[k], words[k + 1], words[k + 2]] > 1 for d in range(3)}
        want = len(words) >= 50 and 100 * len(again) <= 50 * len(words) and within(raw)
        if want and len(raw) > 4096:
            chunks = [raw[k : k + 4096] for k in range(0, len(raw), 4096)]
            want = sum(len(c) for c in chunks if not within(c)) <= 0.5 * len(raw)
        assert r["kept"] == want, r["doc_id"]


def test_noise_at_the_end_and_in_short_texts_is_seen():
    rng = random.Random(0)
    clean = " ".join(rng.choice(["river", "stone", "walks", "under", "morning", "light", "before", "people", "small", "house", "garden", "winter"]) + rng.choice(["", "s", "ly", "er"]) for _ in range(900))
    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(4000))
    assert quality.in_bands((clean[:4096] + noise).encode(), packer)[2] > 0.4
    assert not quality.in_bands(noise.encode(), packer)[0]


# Packing


def test_best_fit_fills_windows_exactly_before_anything_is_cut():
    rng = np.random.default_rng(5)
    histogram = np.bincount(rng.integers(1, 2048, 9000), minlength=2048)
    fitted, n_fitted, left = packing.by_combinations(histogram)
    more, n_all, rest = packing.by_best_fit(histogram, left, n_fitted)
    windows, ranks = Counter(), set()
    for v, a, b, sequence, _ in fitted + more:
        for k in range(b - a):
            windows[sequence + k] += v
            assert (v, a + k) not in ranks
            ranks.add((v, a + k))
    assert set(windows.values()) == {2048} and len(windows) == n_all
    assert all((v, r) in ranks for v in range(2048) for r in range(histogram[v] - rest[v])) and len(ranks) + rest.sum() == histogram.sum()
    assert n_fitted > 0 and rest.sum() < 0.15 * histogram.sum()  # long ones that no short one is left for


# Token files


def test_reader_takes_offsets_and_names_from_select(monkeypatch):
    calls = []
    real = token_binary.EliasFano.select
    monkeypatch.setattr(token_binary.EliasFano, "select", lambda self, k: calls.append(k) or real(self, k))
    ends, names = token_binary.EliasFano.of(np.array([3, 3, 9])), token_binary.EliasFano.of(np.array([0, 2**40]))
    assert list(token_binary.documents_of(3, ends, 1, -7, names)) == [(None, 0, 3), (-7, 3, 3), (2**40 - 7, 3, 9)]
    assert calls == [0, 1, 0, 2, 1]


# The whole pipeline


def test_pipeline_matches_its_stages_done_by_hand(spark, tmp_path):
    from test_corpus import brute_links

    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(60, 400)))
        rows.append((i, text + (f" {SECRET} end" if i % 9 == 0 else ""), "en", rng.choice(["a", "b", None]), None))
    rows += [(100 + i, rows[i][1] + " one more word", "en", "a", None) for i in range(0, 30, 3)]
    rows += [(200, "short", "en", "a", 5), (201, None, None, None, None), (202, "spam " * 300, "en", "b", None), (None, rows[7][1], "en", "b", None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))

    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    kept = [r for r in rows if quality.judge(r[1], packer)[6]]
    assert 40 < len(kept) < len(rows)
    groups = {}
    for r, (_, root) in zip(kept, brute_links([r[1] for r in kept], 5, 80)):
        groups.setdefault(root, []).append(r)
    kept = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    kept = [(r[0], secret_scan.redact(r[1]), r[3]) for r in kept]
    assert not any(SECRET in r[1] for r in kept)

    sizes = Counter()
    for _, text, source in kept:
        sizes[source] += len(text.split())
    from test_texts import brute_targets

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    uses = Counter()
    for source, target in brute_targets(sizes).items():
        left = round(target)
        queue = sorted((r for r in kept if r[2] == source), key=lambda r: hashlib.md5(f"mix{r[0]}".encode()).hexdigest())
        for _ in range(3):
            for i, text, _ in queue:
                words = text.split(" ")[:left] if left < len(text.split(" ")) else text.split(" ")
                cut = " ".join(words) + (" " if len(words) < len(text.split(" ")) else "")
                if words:
                    want[i, uses[i]] = [*tokenizer.encode(cut, add_special_tokens=False).ids, 1]
                    uses[i] += 1
                left -= len(words)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == uses
    assert sum(r["length"] for r in got) == sum(map(len, want.values()))
    whole = Counter((k[0], len(v)) for k, v in want.items())
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == whole
