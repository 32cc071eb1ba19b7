"""The pipeline against a plain version, stage by stage."""

import hashlib
import os

import brute
import pytest

import corpus_pipeline
from liftspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small table with repeated texts, near copies, passages of a benchmark, and texts without letters."""
    path = tmp_path_factory.mktemp("tables")
    prose = {"en": "the quick brown fox jumps over lazy dogs while seven wizards quietly mix strong potions near old bridges", "fr": "le renard brun saute par dessus les chiens paresseux pendant que sept sorciers mélangent des potions"}
    rows, n = [], 0
    for lang, text in prose.items():
        w = text.split()
        for k in range(40):
            body = " ".join(w[(k * 7 + i * (k % 5 + 1)) % len(w)] + ("" if i % 9 else f"{lang}{k}x{i}") for i in range(60))
            rows.append((n, body, lang, "s", len(body)))
            n += 1
    item = "which of these seven strange answers about purple rivers is true when nobody counts the stones"
    rows += [(n, rows[3][1], "en", "s", 0), (n + 1, rows[5][1] + " tail", "en", "s", 0), (n + 2, rows[8][1] + " " + item, "en", "s", 0), (n + 3, "123 456", "en", "s", 0), (n + 4, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, item, n


def test_pipeline(spark, folder):
    path, rows, item, n = folder
    texts = {i: t for i, t, *_ in rows if t and any(map(str.isalpha, t))}
    last = {}
    for i, t in texts.items():
        last[t] = max(i, last.get(t, -1))
    texts = {i: t for t, i in last.items()}
    _, found = brute.jaccard_components(sorted(texts.items()))
    texts = {i: t for i, t in texts.items() if found[i] == i and not brute.contaminated(t, item)}
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        digest = hashlib.sha256(t.encode()).hexdigest()
        assert got[i]["decoded_sha256"] == digest and len(got[i]["token_ids"]) == 4 * got[i]["n_tokens"]
    assert 3 not in got and n in got and n + 1 not in got and n + 2 not in got and n + 3 not in got


def test_stages_keep_the_columns(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontamination", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.count()
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    want = {"op8_url_filter": spark.read.parquet(f"{SF}/pages.parquet").count(), "op3_line_dedup": None, "op10_decontamination": None}.get(name, documents)
    assert rows == want if want is not None else rows > 0
