"""The five stages against plain versions of them, on a small table."""

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from arborlog.llm import langid, packing, pii, simhash
from tests.llm.test_operators import WORD, brute_print

SF = "/root/testdata/sf0.001"


def mix_copies(rows):
    """Copies of each document by sorting each source's documents by their hash."""
    import hashlib

    ticket = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r["doc_id"])
    total = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    order = sorted(by)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, budget, target = set(order), 1.5 * sum(total.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level >= 2 * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in left}
            break
        target |= {s: 2.0 * total[s] for s in full}
        budget -= sum(2 * total[s] for s in full)
        left -= full
    copies = Counter()
    for s, ids in by.items():
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, run = target[s] - whole * total[s], 0
        for i in sorted(ids, key=ticket):
            nearer = run + size[i] <= rest or (run < rest and rest - run > run + size[i] - rest)
            copies[i] = whole + (rest > 0 and nearer)
            run += size[i]
    return copies


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if (x := model(r["text"]))[0] != "und" and x[1] >= 0.5]
    stage = corpus_pipeline.written(corpus_pipeline.language(spark, docs, SF), "one")
    assert Counter(r["doc_id"] for r in stage.collect()) == Counter(r["doc_id"] for r in rows)
    fps = np.array([brute_print(r["text"]) for r in rows], dtype=np.uint64)
    root = simhash.spanning(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    first = {}
    for r, k in zip(rows, root):
        first[k] = min(first.get(k, r["doc_id"]), r["doc_id"])
    rows = [r for r in rows if r["doc_id"] in set(first.values())]
    stage = corpus_pipeline.written(corpus_pipeline.near_dedup(spark, stage, SF), "two")
    assert Counter(r["doc_id"] for r in stage.collect()) == Counter(r["doc_id"] for r in rows)
    for r in rows:
        r["text"] = pii.masked_text(r["text"])
        assert not pii.base_spans(r["text"])
    stage = corpus_pipeline.written(corpus_pipeline.personal_data(spark, stage, SF), "three")
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in stage.collect()} == {r["doc_id"]: (r["text"], len(r["text"])) for r in rows}
    copies = mix_copies(rows)
    stage = corpus_pipeline.written(corpus_pipeline.mixing_weights(spark, stage, SF), "four")
    assert stage.columns == docs.columns
    assert Counter(r["doc_id"] for r in stage.collect()) == +copies
    encode = packing.Encoder(packing.default_path())
    want = Counter({r["doc_id"]: copies[r["doc_id"]] * (len(encode(r["text"])) // 4 + 1) for r in rows if copies[r["doc_id"]]})
    for out in (corpus_pipeline.packing_windows(spark, stage, SF), corpus_pipeline.run(spark, SF)):
        got = Counter()
        for r in out.collect():
            got[r["doc_id"]] += r["length"]
        assert got == want
