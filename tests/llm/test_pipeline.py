"""The pipeline's stages against their definitions, and its whole run."""

from collections import Counter

import corpus_pipeline
from codexine.llm import quality_rules
from codexine.llm.common import cut, table

from .test_models import plain_join, read, shingles
from .test_texts import base, plain_dedup


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    given = {d["doc_id"]: d for d in read(sf_dir, "documents")}
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, sf_dir), "stage")
        if name != "packing":
            assert out.columns == columns
        rows = [r.asDict() for r in out.collect()]
        if name == "quality rules":
            kept = {r["doc_id"] for r in quality_rules.judge(docs, table(spark, sf_dir, "labels")).filter("kept").collect()}
            assert {r["doc_id"]: r for r in rows} == {k: given[k] for k in kept}
        elif name == "line dedup":
            want = plain_dedup([(k, d["text"]) for k, d in sorted(given.items())])
            assert {r["doc_id"]: r["text"] for r in rows} == {k: t for k, n, gone, t in want if gone < n or not n}
        elif name == "n-gram jaccard join":
            classes = plain_join([(k, d["text"]) for k, d in given.items()])
            assert {r["doc_id"] for r in rows} == {d for d, c, _ in classes if d == c}
            assert len({frozenset(shingles(r["text"])) for r in rows if shingles(r["text"])}) == sum(bool(shingles(r["text"])) for r in rows)
        elif name == "secret scans":
            assert {r["doc_id"] for r in rows} == set(given)
            for r in rows:
                assert not base(r["text"] or "") and r["n_chars"] == len(r["text"] or "")
                assert base(given[r["doc_id"]]["text"]) or "[" in r["text"] or r["text"] == given[r["doc_id"]]["text"]
        else:
            lengths = Counter()
            for r in rows:
                lengths[r["doc_id"]] += r["length"]
            assert set(lengths) == set(given) and all(lengths[r["doc_id"]] == r["doc_tokens"] for r in rows)
        docs = out
        if name != "packing":
            given = {r["doc_id"]: r for r in rows}


def test_run(spark, sf_dir, tables):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
    assert corpus_pipeline.run(spark, tables(documents=[(1, None), (2, ""), (None, None)])).collect() == []


def test_null_and_repeated_ids(spark, tables):
    """A bad row takes no other row of its id along, and a group's row no row of another group."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, words(1)), (None, words(2)), (None, words(2)), (None, "bad"), (None, None), (7, words(3)), (7, words(4)), (7, "bad"), (8, words(4)), (9, words(1) + " end")]
    folder = tables(documents=[(i, t, "en", "s", len(t or "")) for i, t in rows])
    docs = table(spark, folder, "documents")
    good = cut(corpus_pipeline.quality(spark, docs, folder), "good")
    assert Counter((r["doc_id"], r["text"]) for r in good.collect()) == Counter((i, t) for i, t in rows if t and t != "bad")
    left = corpus_pipeline.near_copies(spark, good, "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter([(None, words(2)), (7, words(3)), (7, words(4)), (9, words(1) + " end")])


def test_empty(spark, tables):
    assert corpus_pipeline.run(spark, tables()).collect() == []
