"""The stages one after the other against plain decisions, and the registered queries."""

from __future__ import annotations

import cases
import duckdb
import pytest

pytest.importorskip("opatlas.llm")
import corpus_pipeline  # noqa: E402
from opatlas.llm import language_crf, packing, pii, quality_crf  # noqa: E402
from opatlas.llm.queries import QUERIES  # noqa: E402
from opatlas.llm.sql import ORACLE_SQL  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def test_stages_and_queries_are_registered():
    import __spark_entry__ as entry

    names = ["quality", "language", "near_copies", "personal_data", "packing"]
    assert [name for name, _ in corpus_pipeline.STAGES] == names
    registered = entry.queries()
    assert registered["pipeline"] is corpus_pipeline.run
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in registered) == 1
    assert set(QUERIES) <= set(registered)


def test_each_stage_takes_effect(spark, tmp_path):
    rows = [r for r in cases.documents() if not (r[0] is None and r[1] is None)]
    source = cases.frame(spark, rows)
    source.write.parquet(str(tmp_path / "documents.parquet"))
    cases.labels(spark, rows).write.parquet(str(tmp_path / "labels.parquet"))
    sf_dir = str(tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")

    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, sf_dir)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        path = str(tmp_path / name)
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        old, new = (sorted(str(tuple(r)) for r in x.select("doc_id", "text").collect()) for x in (before, kept))
        if name == "quality":
            scores = quality_crf.score_quality(before, quality_crf.fit_quality(before, labels))
            want = scores.where("quality_score >= 0.3").select("doc_id", "text")
        elif name == "language":
            found = language_crf.label_languages(before, language_crf.fit_languages(before))
            want = found.where("found_lang <> 'und' and lang_score >= 0.4").select("doc_id", "text")
        elif name == "near_copies":
            own = [tuple(r) for r in before.select("doc_id", "text").collect()]
            groups = {}
            for (doc_id, text), (_, root) in zip(own, cases.components([t for _, t in own]), strict=True):
                groups.setdefault(root, []).append((doc_id is None, doc_id, text))
            assert len(new) == len(groups) < len(old)
            assert new == sorted(str(min(g, key=lambda x: x[:2])[1:]) for g in groups.values())
            continue
        else:
            want = pii.mask_pii(before).select("doc_id", "text")
            assert len(new) == len(old)
        assert new == sorted(str(tuple(r)) for r in want.collect()), name

    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).toPandas()
    encoder = packing.Encoder()
    sizes = {}
    for r in kept.collect():
        sizes[r.doc_id] = len(encoder.ids(r.text)) + 1
    assert packed.groupby("doc_id").length.sum().to_dict() == {i: n for i, n in sizes.items() if i is not None}
    whole = corpus_pipeline.run(spark, sf_dir).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, whole[columns].values.tolist())) == sorted(map(str, packed[columns].values.tolist()))


def test_an_empty_table_stays_empty(spark, tmp_path):
    cases.frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    cases.labels(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_queries_equal_their_twins(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "labels"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = connection.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF_DIR).toPandas()[list(want.columns)]
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, want.values.tolist()))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_queries_run_on_the_smallest_tables(spark, name):
    tables = {"op2_nearest_neighbours": "embeddings", "op7_warc_revisits": "pages"}
    rows = QUERIES[name](spark, SF_DIR)
    n = spark.read.parquet(f"{SF_DIR}/{tables.get(name, 'documents')}.parquet").count()
    assert rows.count() >= (n if name not in tables else 1)
    assert len(set(rows.columns)) == len(rows.columns)
