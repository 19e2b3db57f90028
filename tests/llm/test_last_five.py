"""Shingle join, language id, token files, license scans and personal data
against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cloneloom.llm import kernels, langid, license_scan, ngram_join, pii, token_io, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_shingles(text):
    words = WORD.findall(text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


# -- shingle join


def brute_join(docs, similarity=0.8):
    sets = [plain_shingles(t) for _, t in docs]
    links, parent = [0] * len(docs), list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    pairs = {(a, b) for own in holders.values() for i, a in enumerate(own) for b in own[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if both * (1 + similarity) >= similarity * (len(sets[a]) + len(sets[b])) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted(str((d, least.get(find(k)), links[k])) for k, (d, _) in enumerate(docs))


def test_join_documents(documents, texts):
    rows = ngram_join.near_duplicates(documents).collect()
    assert sorted(str(tuple(r)) for r in rows) == brute_join(list(texts.items()))


def test_join_edges(edge, empty):
    rows = ngram_join.near_duplicates(edge).collect()
    assert sorted(str(tuple(r)) for r in rows) == brute_join([(r.doc_id, r.text) for r in edge.collect()])
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.one_per_class(edge).columns == edge.columns


def test_join_splits_large_buckets_and_tiles(spark, monkeypatch):
    """Many texts with a common passage, and a large group of near copies."""
    monkeypatch.setattr(ngram_join, "SMALL", 8)
    monkeypatch.setattr(ngram_join, "TILE", 16)
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % rng.integers(10**6)
    passage = " ".join(word() for _ in range(30))
    first = [word() for _ in range(120)]
    docs = []
    for k in range(150):
        docs.append((k, " ".join(word() for _ in range(40)) + " " + passage + " " + " ".join(word() for _ in range(40))))
    for k in range(150, 270):
        own = list(first)
        for _ in range(int(rng.integers(0, 4))):
            own[int(rng.integers(120))] = word()
        docs.append((k, " ".join(own)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = ngram_join.near_duplicates(table).collect()
    got = {r.doc_id: (r.class_id, r.n_links) for r in rows}
    want = {eval(x)[0]: eval(x)[1:] for x in brute_join(docs)}
    assert {d: c for d, (c, _) in got.items()} == {d: c for d, (c, _) in want.items()}
    missed = sum(want[d][1] - got[d][1] for d in want) / sum(n for _, n in want.values())
    assert 0 <= missed < 0.001


def test_join_recall_of_texts_made_of_hot_passages(spark):
    """Nearly every shingle that a pair shares stands in 78 texts, so splits
    lead to it; all texts have the same size, so a passage's buckets agree."""
    word = iter(range(10**7))
    run = lambda n: " ".join("w%d" % next(word) for _ in range(n))
    passages = [run(150) for _ in range(40)]
    docs = []
    for one, two in itertools.combinations(passages, 2):
        docs += [(len(docs) + k, f"{one} {two} {run(30)}") for k in range(2)]
    got = {r.doc_id: r.class_id for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    missed = sum(got[k] != got[k + 1] for k in range(0, len(docs), 2))
    assert missed == 0


def test_runs_reach_the_recall():
    rng = np.random.default_rng(2)
    runs, missed, pairs = ngram_join.runs_for(ngram_join.RECALL), 0, 400
    for _ in range(pairs):
        a = rng.integers(0, 2**63, 90).astype(np.uint64)
        b = np.concatenate([a[:80], rng.integers(0, 2**63, 10).astype(np.uint64)])
        keys = [set(np.concatenate([ngram_join._chosen(x, r + 1, 0.8) for r in range(runs)]).tolist()) for x in (a, b)]
        missed += not keys[0] & keys[1]
    assert missed == 0


def test_components_of_long_chains(spark):
    chain = [(bytes([k]), bytes([k + 1])) for k in range(60)] + [(bytes([90]), bytes([91])), (bytes([95]), bytes([91]))]
    got = {r.sid[0]: r.root[0] for r in ngram_join.components(spark.createDataFrame(chain, "sid binary, root binary")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {91: 90, 95: 90}


def test_shingle_sets_have_the_sizes_of_plain_ones(texts):
    values = list(texts.values())
    for k, own in kernels.shingle_sets(pa.array(values)):
        assert len(own) == len(plain_shingles(values[k]))


# -- language id


def test_language_held_out_accuracy(spark, documents, data_dir):
    rows = langid.identify(documents).collect()
    lang = {r.doc_id: r.lang for r in documents.collect()}
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and len(documents.columns)]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_edges(edge, empty):
    rows = langid.identify(edge).collect()
    texts = Counter((r.doc_id, any(c.isalpha() for c in r.text or "")) for r in edge.collect())
    assert Counter((r.doc_id, r.lang_pred != "und") for r in rows) == texts
    assert langid.identify(empty).count() == 0


def test_elastic_net_leaves_few_weights_and_temperature_calibrates():
    rng = np.random.default_rng(7)
    rows = []
    for k in range(400):
        at = np.unique(rng.integers(0, 3000, 60))
        at = np.unique(np.append(at, [5000 + k % 3]))
        x = np.full(len(at), 1 / np.sqrt(len(at)))
        rows.append((k % 3, at, x))
    weights = langid.fit(rows, 3)
    assert (np.abs(weights[5000:5003]).argmax(0) == [0, 1, 2]).all()
    dense, sparse = ((langid.fit(rows, 3, l1=l1)[:3000] != 0).mean() for l1 in (0.0, 0.5))
    assert sparse < 0.2 < 0.9 < dense
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    labels = (p.cumsum(1) > rng.random((4000, 1))).argmax(1)
    assert abs(langid.temperature(logits * 3, labels) - 3) < 0.5


# -- token files


FRESH = Tokenizer.from_file(tokens.default_tokenizer())


def check_files(rows, docs):
    at, want = 0, []
    for d, text in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        ids = [*FRESH.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows)


def test_token_files_documents(documents, texts):
    check_files(token_io.round_trip(documents).collect(), list(texts.items()))


def test_token_files_edges(edge, empty):
    check_files(token_io.round_trip(edge).collect(), [(r.doc_id, r.text) for r in edge.collect()])
    assert token_io.round_trip(empty).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_simple8b_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 5000))
    bits = rng.integers(0, [1, 2, 16, 17, 31, 60, 63, 64][seed] + 1, n)
    values = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    values = np.where(bits == 0, np.uint64(0), values >> np.minimum(64 - bits, 63).astype(np.uint64))
    if seed == 7 and n > 3:
        values[:3] = [token_io.ESCAPE, 2**64 - 1, token_io.ESCAPE - 1]
    words, at, escapes = token_io.encode(values)
    assert (token_io.decode(words, n, at, escapes) == values).all()
    if seed == 2 and n:
        assert len(words) * 8 < n * 4


# -- license scans


def test_license_documents(documents, texts):
    got = {(r.doc_id, r.template): (r.containment, r.first_word, r.last_word) for r in license_scan.scan(documents).collect()}
    words = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    shingles = lambda t: [tuple(w[k : k + 5]) for w in [words(t)] for k in range(len(w) - 4)]
    notices = [frozenset(shingles(t)) for _, t in license_scan.NOTICES]
    want = set()
    for d, t in texts.items():
        own = shingles(t)
        for k, n in enumerate(notices):
            # all templates are short, so that they stand in one place
            if len(n & set(own)) >= 0.8 * len(n):
                want.add((d, k))
    assert set(got) == want and want
    for (d, k), (_, a, b) in got.items():
        assert set(shingles(" ".join(words(texts[d])[a : b + 1]))) & notices[k]


def test_license_finds_edited_templates(spark):
    mit = license_scan.NOTICES[2][1]
    rng = np.random.default_rng(8)
    docs = []
    for k in range(60):
        words = mit.split()
        if k % 2:
            words[1] = "certainly"
        filler = lambda: " ".join("f%d" % x for x in rng.integers(0, 10**6, int(rng.integers(0, 90))))
        docs.append((k, f"{filler()} {' '.join(words).upper()} {filler()}"))
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).filter("template = 2").collect()
    assert sorted(r.doc_id for r in got) == list(range(60))


def test_license_edges(edge, empty):
    assert license_scan.scan(edge).count() == 0
    assert license_scan.scan(empty).count() == 0


# -- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 8 <= len(digits) <= 15)
            ):
                out.append((kind, m.start(), m.end()))
    return out


def check_pii(rows, docs):
    want = []
    for d, t in docs:
        spans = plain_spans(t or "")
        n = Counter(s[0] for s in spans)
        listed = ",".join("%s:%d:%d" % s for s in spans)
        want.append((d, *(n[k] for k in BASE), hashlib.sha256(listed.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in rows)


def test_pii_documents(documents, texts):
    check_pii(pii.find(documents).collect(), list(texts.items()))


TRICKY = [
    "a@b.c_d@e.f mail x@y@z.com, .@-.- a%b+c-d_e.f@g.h.i.j. foo@bar baz@qux.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.000.1.2 1.2.3 999999999999999999999.1.1.1 1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "+1 (555) 010-9999) +12 +1234567 +12345678 + 1234567890 +1..2 +1 (((((",
    "é😀 a@b.co 😀 +44 20 7946 0958 ñ 10.0.0.1",
    "9" * 30000 + " " + "a" * 30000 + " " + "1." * 20000 + " " + "a.b@" + "c." * 20000 + "d",
    "+1" + " (" * 20000 + " " + "5 " * 20000,
]


def test_pii_tricky_and_edges(spark, edge, empty):
    docs = list(enumerate(TRICKY))
    check_pii(pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    check_pii(pii.find(edge).collect(), [(r.doc_id, r.text) for r in edge.collect()])
    assert pii.find(empty).count() == 0


def test_pii_context_finds_unseen(spark):
    rng = np.random.default_rng(6)
    docs = [(k, "please call me at +1 555 01%02d %04d today" % (k, rng.integers(10**4))) for k in range(30)]
    docs.append((100, "please call me at 555-0199-777 today"))
    docs.append((101, "the room has 555-0199-777 seats"))
    docs.append((102, "please call me at noon"))
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[100].spans == "phone:18:30" and got[100].n_found == 1 and got[100].n_phone == 0
    assert got[101].spans == "" and got[102].spans == ""
    assert all(got[k].n_found == 0 for k in range(30))


def test_pii_rounds_go_on_while_strings_become_known(spark):
    """Patterns of each level precede the strings found by the level before
    and one string of their own."""
    value = lambda level, k: f"10.{level}.0.{k}"
    rows = []
    for level in range(1, 7):
        for p in range(24):
            for at, k in [*((level - 1, k) for k in range(24)), (level, p)]:
                rows.append(([f"word{level}-{p}"], value(at, k), "ip" if at == 0 else None))
    seen = spark.createDataFrame(rows, "patterns array<string>, value string, kind string")
    got = {r.pattern for r in pii.bootstrap(seen).collect()}
    assert got == {f"word{level}-{p}" for level in range(1, 7) for p in range(24)}
