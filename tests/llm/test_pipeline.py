"""The pipeline's stages, each against a plain version on its own input."""

import corpus_pipeline as cp

from .test_ops import CLASH, brute_contamination, components  # noqa: F401


def test_stages(spark, sf):
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, now = docs.columns, docs
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        after = stage(spark, now, sf)
        ids = {r.doc_id for r in after.collect()}
        if name == "language_id":
            assert ids == {k for k, t in before.items() if re.search(r"[^\W\d_]", t or "")}
        elif name == "exact_dedup":
            first = {}
            for k, t in sorted(before.items()):
                first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), k)
            assert ids == set(first.values())
        elif name == "minhash_dedup":
            assert ids == {k for k, c in components(before, 5, 80)[0].items() if k == c}
        elif name == "decontaminate":
            found = brute_contamination(before.items(), items)
            assert ids == {k for k in before if not found[k][4]}
        else:
            assert ids == set(before)
            break
        assert after.columns == columns
        now = after.cache()
    assert {r.doc_id for r in cp.run(spark, sf).select("doc_id").collect()} == ids
