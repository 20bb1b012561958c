"""The pipeline's stages in order, on a small table with cases that each of them must act on."""

import importlib.util
import sys
from pathlib import Path

from trailmark.llm import queries, simhash
from trailmark.llm.scratch import Scratch

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark):
    sys.path.insert(0, str(ROOT))
    import corpus_pipeline
    from tests.llm.test_operators import prose  # noqa: E402

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "source mixing", "token output"]
    item = prose(40, 1000)
    rows = [(k, prose(120, k), "en", "s", 1) for k in range(60)] + [(100, prose(120, 3), "en", "s", 1), (101, "short text", "en", "s", 1), (102, prose(60, 70) + " " + item, "en", "s", 1), (103, None, None, None, None)]
    scratch = Scratch(spark, "t")
    scratch.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "documents.parquet")
    scratch.keep(spark.createDataFrame([(1, item)], "item_id long, text string"), "benchmark.parquet")
    scratch.keep(spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int"), "labels.parquet")
    docs = spark.read.parquet(scratch.path("documents.parquet"))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = scratch.keep(stage(spark, docs, scratch.root), f"stage{k}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r["doc_id"] for r in docs.collect()})
    assert 101 not in seen[0] and 103 not in seen[0] and 100 in seen[0]
    assert 100 not in seen[1] and 102 in seen[1] and 102 not in seen[2]
    assert len(seen[3] & set(range(60))) >= 54
    out = corpus_pipeline.run(spark, scratch.root)
    assert {r["doc_id"] for r in out.collect()} == seen[3]


def test_near_copies(spark):
    """The stage keeps one of each group at similarity 0.8 of five-word shingles, also where fingerprints are far."""
    sys.path.insert(0, str(ROOT))
    import corpus_pipeline
    from tests.llm.test_operators import prose  # noqa: E402

    def jaccard(a, b):
        x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        return len(x & y) / len(x | y)

    def changed(text, places):
        words = text.split()
        for p in places:
            words[p] = f"new{p}"
        return " ".join(words)

    rows, gone, near = [], set(), []
    for k in range(40):
        text = prose(200, 5000 + k)
        copy, far = changed(text, [20 + k, 150]), changed(text, range(15, 190, 20))
        near.append((text, copy))
        assert jaccard(text, copy) >= 0.8 > jaccard(text, far)
        # a chain: the last is near the copy only
        last = changed(copy, [40 + k, 100, 120])
        assert jaccard(copy, last) >= 0.8 > jaccard(text, last)
        rows += [(10 * k, text), (10 * k + 1, copy), (10 * k + 2, far), (10 * k + 3, last), (10 * k + 4, text.upper())]
        gone |= {10 * k + 1, 10 * k + 3, 10 * k + 4}
    assert any((simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > simhash.RADIUS for a, b in near)
    # one large group of near copies
    base = prose(150, 9)
    rows += [(1000 + k, changed(base, [k % 140])) for k in range(140)]
    gone |= set(range(1001, 1140))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows} - gone


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.SQL) <= set(queries.QUERIES) and importlib.util.find_spec("corpus_pipeline")
