"""Hot keys, long texts and clashing columns; whole results by plain code."""

import itertools
import re
import time
from collections import Counter

import numpy as np
import zstandard
from test_first_five import WORD, base, classic_best_fit
from test_last_five import plain_shingles

from cloneloom.llm import exact_dedup, langid, mixing, ngram_join, packing, pii, quality, sharding, token_io

DOCS = "doc_id long, text string, source string"


# -- mixing


def test_mix_of_repeated_rows(spark):
    """A document that a third of all rows repeat, and one with many rows that
    a task lists in parts."""
    many = spark.range(120_000).selectExpr("7L as doc_id", "'one two three' as text", "'a' as source")
    rest = spark.range(2000).selectExpr("id + 100 as doc_id", "repeat('w ', int(id % 30) + 1) as text", "if(id % 3 = 0, 'a', 'b') as source")
    docs = many.unionByName(rest)
    began = time.perf_counter()
    got = mixing.mix(docs).groupBy("doc_id", "size", "source_size", "target", "copies").count().collect()
    assert time.perf_counter() - began < 60
    assert sum(r["count"] for r in got) == 122_000
    own = [r for r in got if r.doc_id == 7]
    assert sum(r["count"] for r in own) == 120_000
    # both numbers of copies differ by one, and share out the expected ones
    per = own[0].target / own[0].source_size
    assert {r.copies for r in own} <= {int(per), int(per) + 1}
    assert abs(sum(r.copies * r["count"] for r in own) - 120_000 * per) <= 1
    taken = sum(r.copies * r["size"] * r["count"] for r in got if r.source_size == own[0].source_size)
    assert abs(taken - own[0].target) <= 31


def test_mixed_takes_what_mix_says(spark, edge):
    docs = edge.unionByName(edge.limit(3)).unionByName(edge.limit(3))
    counts = Counter()
    for r in mixing.mix(docs).collect():
        counts[r.doc_id, r["size"]] += r.copies
    clash = docs.selectExpr("*", "'u' as k", "'v' as row", "'w' as copy", "'x' as nth", "1 as n_rows", "'y' as _h", "'z' as _copy")
    out = mixing.mixed(clash)
    assert out.columns == clash.columns
    got = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in out.collect())
    assert got == +counts
    assert all((r.k, r.row, r.copy, r.nth, r._h, r._copy) == ("u", "v", "w", "x", "y", "z") for r in out.collect())


# -- packing, dedup, quality: the rows that the pipeline's stages give


def test_clashing_columns_stay(edge):
    clash = edge.selectExpr("*", "'u' as _sha", "'v' as row", "'w' as id", "'x' as sha", "'y' as _id", "'z' as _text", "1 as bucket")
    for stage in (exact_dedup.deduplicated, quality.accepted, ngram_join.one_per_class):
        out = stage(clash)
        assert out.columns == clash.columns
        assert all((r._sha, r.row, r.id, r.sha, r._id, r._text, r.bucket) == ("u", "v", "w", "x", "y", "z", 1) for r in out.collect())
    assert packing.pack_documents(clash).count() == packing.pack_documents(edge).count()


def test_accepted_rows_are_those_kept(edge):
    kept = Counter((r.doc_id, r.kept) for r in quality.quality(edge).collect())
    assert Counter((r.doc_id, True) for r in quality.accepted(edge).collect()) == Counter({k: n for k, n in kept.items() if k[1]})


def test_deduplicated_keeps_one_of_each(edge):
    got = Counter(r.text or "" for r in exact_dedup.deduplicated(edge.unionByName(edge)).collect())
    assert got == Counter({r.text or "" for r in edge.collect()})


def test_verdicts_by_plain_code(documents, texts):
    """Ratios and bands of every text, computed apart."""
    bands, press = quality.Bands(), zstandard.ZstdCompressor(level=quality.LEVEL)

    def ratio(part):
        return len(press.compress(part)) / len(part)

    def fits(part):
        low, high = next((low, high) for least, low, high in reversed(bands.whole) if least <= len(part))
        return low <= ratio(part) <= high

    want = {}
    for d, text in texts.items():
        raw = text.encode()
        parts = [raw[k : k + bands.chunk_bytes] for k in range(0, len(raw), bands.chunk_bytes)]
        bad = 0
        for part in parts if len(raw) >= bands.chunk_bytes else []:
            good = bands.chunk_low <= ratio(part) <= bands.chunk_high if len(part) == bands.chunk_bytes else fits(part)
            bad += 0 if good else len(part)
        failed = base(text)[-1]
        want[d] = not failed and (not raw or fits(raw) and bad / len(raw) <= bands.bad_share)
    assert {r.doc_id: r.kept for r in quality.quality(documents).collect()} == want


# -- shards


def test_shards_by_plain_best_fit(spark, monkeypatch):
    """Every group is a parcel, so the plan is that of best fit alone."""
    monkeypatch.setattr(sharding, "PARCELS_PER_SHARD", 10**6)
    rng = np.random.default_rng(4)
    docs = [(k, "x" * int(n)) for k, n in enumerate(rng.integers(1, 4000, 300))]
    rows = sharding.assign(
        spark.createDataFrame([(str(k), len(t) + 1, 1) for k, t in docs], "key string, size long, n long"), 8, 10**6
    ).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    sizes = [len(t) + 1 for _, t in docs]
    low = -(-sum(sizes) // 8)
    while classic_best_fit(sizes, low) > 8:
        low += 1
    assert len(rows) == len(docs) and set(load) <= set(range(8))
    assert max(load.values()) <= low


# -- languages


def test_predictions_by_plain_code(documents, texts):
    """N-grams cut by slices, logits by a dictionary of weights."""
    model = langid.train(documents)
    shift = 64 - langid.FEATURES.bit_length() + 1
    multipliers = [int(m) for m in langid._MULTIPLIERS]

    def plain(text):
        lower = text.lower()
        if not any(c.isalpha() for c in lower):
            return "und", 0.0
        kept = re.sub(r"[^\W\d_]|(.)", lambda m: m[0] if m[0].isalpha() else " ", lower, flags=re.S)
        codes = [ord(c) for c in " " + "".join(c if c.isalpha() else " " for c in kept)]
        codes = [c for k, c in enumerate(codes) if k == 0 or c != 32 or (k > 1 and codes[k - 1] != 32)]
        counts = Counter()
        for n in range(1, langid.LONGEST + 1):
            for k in range(len(codes) - n + 1):
                total = sum(c * m for c, m in zip(codes[k : k + n], multipliers, strict=False)) % 2**64
                mixed = (total ^ total >> 29) * (0xBF58476D1CE4E5B9 + 2 * (n - 1)) % 2**64
                counts[mixed >> shift] += 1
        x = {f: (1 + np.log(c)) * model.idf[f] for f, c in counts.items()}
        norm = np.sqrt(sum(v * v for v in x.values()))
        z = sum(v / norm * model.weights[f] for f, v in x.items()) + model.weights[-1]
        p = np.exp(z / model.temperature - max(z / model.temperature))
        return model.langs[int(np.argmax(p))], float(max(p) / sum(p))

    for r in langid.identify(documents, model).collect():
        if len(texts[r.doc_id]) < 3000:
            lang, score = plain(texts[r.doc_id])
            assert r.lang_pred == lang and abs(r.score - score) < 1e-6


# -- personal data


def test_pii_in_a_text_of_very_many_matches(spark):
    text = " ".join(f"u{k}@m{k % 7}.org, +49 30 {1000000 + k} or 10.0.{k % 300}.7;" for k in range(6_000))
    began = time.perf_counter()
    (row,) = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert time.perf_counter() - began < 60
    emails = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert row.n_email == len(emails) == 6_000
    assert row.n_ip == sum(k % 300 <= 255 for k in range(6_000))
    spans = row.spans.split(",")
    assert len(spans) == row.n_email + row.n_ip + row.n_card + row.n_phone + row.n_found
    assert spans[:6_000] == [f"email:{s}:{e}" for s, e in emails]


def test_windows_see_what_lists_see(spark, documents, monkeypatch):
    """Texts of few spans, taken as ones of many; small blocks of matches."""
    want = sorted(map(str, pii.find(documents).collect()))
    monkeypatch.setattr(pii, "FEW", 0)
    monkeypatch.setattr(pii, "BLOCK", 3)
    assert sorted(map(str, pii.find(documents).collect())) == want


# -- shingles


def test_join_of_rows_without_ids_and_with_one_id(spark):
    """Two thousand rows without an id and as many with the same one; wholly
    repeated rows, too."""
    rng = np.random.default_rng(9)
    first = ["w%d" % k for k in rng.integers(10**6, size=200)]
    rows = []
    for k in range(2000):
        own = list(first) if k % 10 == 0 else ["v%d" % x for x in rng.integers(10**6, size=30)]
        if k % 10 == 0:
            own[k // 10 % 200] = "x%d" % k
        rows += [(None, " ".join(own)), (5, " ".join(own[::-1]))]
    rows += [(6, " ".join(first))] * 50
    began = time.perf_counter()
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert time.perf_counter() - began < 120
    assert len(got) == len(rows)
    sets = [plain_shingles(t) for _, t in rows]
    at = [k for k, (_, t) in enumerate(rows) if len(t.split()) == 200]
    links = Counter()
    for a, b in itertools.combinations(at, 2):
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            links[a] += 1
            links[b] += 1
    want = Counter((rows[k][0], links[k]) for k in range(len(rows)))
    assert Counter((r.doc_id, r.n_links) for r in got) == want


def test_join_recall_of_long_texts(spark):
    """Pairs of texts of over 256 shingles, which the sketches sift, at
    similarities from just over the least to 0.95."""
    rng = np.random.default_rng(12)
    docs, pairs = [], []
    for k in range(300):
        first = ["w%d" % x for x in rng.integers(10**7, size=int(rng.integers(300, 900)))]
        own = list(first)
        for at in rng.choice(len(own), int(len(own) * rng.uniform(0.002, 0.021)), replace=False):
            own[at] = "y%d" % rng.integers(10**7)
        pairs.append((len(docs), len(docs) + 1))
        docs += [(len(docs), " ".join(first)), (len(docs) + 1, " ".join(own))]
    got = {r.doc_id: r.class_id for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = [plain_shingles(t) for _, t in docs]
    near = [(a, b) for a, b in pairs if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    assert len(near) > 200
    found = sum(got[a] == got[b] for a, b in near)
    assert found >= 0.99 * len(near)
    assert all(got[a] != got[b] for a, b in pairs if (a, b) not in set(near))


# -- token files


def test_token_files_of_rows_with_one_id(spark):
    rows = [(1, "word " * (k % 50)) for k in range(3000)] + [(None, "other %d" % k) for k in range(1000)]
    got = token_io.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 1000 + [1] * 3000
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
