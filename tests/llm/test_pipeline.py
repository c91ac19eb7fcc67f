import os
import random

import brute
import numpy as np
import pytest
from test_pii import feistel
from test_search import brute_leaks

import __spark_entry__
import corpus_pipeline
from segmill.llm import decontaminate

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


def fixture():
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(20)) for i in range(5)]
    docs = [(i, prose(80), "en", f"s{i % 3}") for i in range(40)]
    docs += [(100 + i, docs[i][1] + " " + word(), "en", "s") for i in range(6)] + [(120, docs[9][1], "de", "s")]
    docs += [(200 + i, prose(30) + " " + items[i][1].upper() + " " + prose(30), "de", "s") for i in range(5)]
    docs += [(300, prose(40) + " 10.0.0.1 " + prose(40), "fr", "s"), (301, "kurz", "en", "s"), (302, None, "en", "s"), (303, "ab cd ef " * 40, "en", None)]
    return docs, items


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, items = fixture()
    rows = [(*d, len(d[1] or "")) for d in docs]
    spark.createDataFrame([(i, t, lang, s, n) for i, t, lang, s, n in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = [(i, t) for i, t, *_ in docs if t and i not in (301, 303)]  # base rules alone: no cutoff is certified from one label
    classes = brute.near_classes(kept)
    kept = [(i, t) for i, t in kept if classes[i][2]]
    leaks = {d for d, _ in brute_leaks(items, kept)}
    kept = [(i, t) for i, t in kept if i not in leaks]
    a, b = feistel(10 * 256, 1, 65536, 65536, "ip")
    kept = [(i, t.replace("10.0.0.1", f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}")) for i, t in kept]
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in kept}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and len(leaks) == 5 and 300 in got
    assert np.mean([len(v) for v in got.values()]) > 100


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "benchmark_decontamination", "pii_pseudonyms", "bpe_token_ids"]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        assert name == "bpe_token_ids" or out.columns == docs.columns


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert decontaminate.RATE and os.path.exists(corpus_pipeline.__file__)
