import re

import pytest

import corpus_pipeline
from quarry.llm import queries
from tests.llm.plain import documents, near_components, normalised
from tests.llm.test_dedup import prose
from tests.llm.test_text import KEY

P = pytest.importorskip("public_tokenizers")


def plain_pipeline(rows):
    """Ids and texts that come to packing."""
    kept = {i: t for i, t in rows if t and any(c.isalpha() for c in t)}
    first = {}
    for i in sorted(kept):
        first.setdefault(normalised(kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    of, _ = near_components(list(kept.items()), 5)
    kept = {i: t for i, t in kept.items() if of[i] == i}
    return {i: re.sub(r'(?i)(token = ")[0-9a-f]{40}(")', r"\1[secret]\2", t) for i, t in kept.items()}


def test_pipeline_against_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    base = prose(1, 150)
    rows = [(1, base), (2, base + "  "), (3, base.replace("alpha", "other", 1)), (4, None), (5, "12 34"), (6, prose(2, 80) + f' token = "{KEY}" end'), (7, prose(3, 3000)), (8, prose(4, 20)), (9, prose(4, 20)), (10, "")]
    rows += [(20 + k, prose(50 + k, 40)) for k in range(20)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in plain_pipeline(rows).items()}
    assert {p.doc_id: p.doc_tokens for p in got} == want
    assert sum(p.length for p in got) == sum(want.values())


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= 50


def test_pipeline_on_no_documents(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ten_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(queries.SQL) <= set(__spark_entry__.oracle_sql())
