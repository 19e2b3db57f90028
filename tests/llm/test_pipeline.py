"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
from test_first_five import WORD, base, water_level
from test_last_five import plain_shingles


def test_stages(spark, documents, data_dir):
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = stage(spark, docs, data_dir)
        seen.append((name, rows, out.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == documents.columns
            docs = spark.createDataFrame(seen[-1][2], documents.schema)

    _, rows, out = seen[0]
    assert set(out) <= set(rows) and not any(base(r.text or "")[-1] for r in out)
    assert len(out) > 0.8 * sum(not base(r.text or "")[-1] for r in rows)

    _, rows, out = seen[1]
    last = defaultdict(int)
    for r in rows:
        last[r.text] = max(last[r.text], r.doc_id)
    assert sorted(r.doc_id for r in out) == sorted(last.values())

    _, rows, out = seen[2]
    sets = {r.doc_id: plain_shingles(r.text) for r in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    near = {(a, b) for own in holders.values() for a in own for b in own if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert sorted(r.doc_id for r in out) == sorted(set(root.values()))

    _, rows, out = seen[3]
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    total, taken = Counter(), Counter()
    for r in rows:
        total[r.source] += size[r.doc_id]
    for r in out:
        taken[r.source] += size[r.doc_id]
    assert set(out) <= set(rows) and max(Counter(out).values()) <= 3
    for s, t in water_level(total).items():
        assert abs(taken[s] - t) <= max(size[r.doc_id] for r in rows if r.source == s) + 1

    _, rows, out = seen[4]
    by_doc = Counter(r.doc_id for r in rows)
    assert Counter(r.doc_id for r in out if r.piece == 0) == by_doc
    by_sequence = Counter()
    for r in out:
        by_sequence[r.sequence_id] += r.length
    assert max(by_sequence.values()) <= 1024
    once = [r for r in rows if by_doc[r.doc_id] == 1]
    kept = {r.doc_id for r in once}
    assert len({(r.doc_id, r.piece) for r in out if r.doc_id in kept}) == sum(r.doc_id in kept for r in out)


def test_run_on_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
