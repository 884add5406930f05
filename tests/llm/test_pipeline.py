"""The pipeline's stages, each against its own operator's decisions."""

from collections import Counter

import pytest

import corpus_pipeline
from tidegauge.llm import decontamination, mixing, sharding, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs[-1], sf_dir).write.parquet(str(folder / str(i)))
        docs.append(spark.read.parquet(str(folder / str(i))))
    return docs


def _rows(df):
    return Counter(map(tuple, df.select(*COLUMNS).collect()))


def test_each_stage_does_what_its_operator_decides(spark, sf_dir, stages):
    raw, clean, single, fresh, mixed, sharded = stages
    rejected = {r.doc_id for r in toxicity.toxicity(raw, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    assert rejected and _rows(clean) == Counter({k: n for k, n in _rows(raw).items() if k[0] not in rejected})
    first = {r.doc_id for r in simhash.near_duplicates(clean).where("doc_id = component_id").collect()}
    assert _rows(single) == Counter({k: 1 for k in _rows(clean) if k[0] in first}) and single.count() < clean.count()
    leaks = {r.doc_id for r in decontamination.contaminated(single, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert leaks and _rows(fresh) == Counter({k: n for k, n in _rows(single).items() if k[0] not in leaks})
    copies = {r.doc_id: r.copies for r in mixing.mix(fresh).collect()}
    assert _rows(mixed) == Counter({k: copies[k[0]] for k in _rows(fresh) if copies[k[0]]})
    assert _rows(sharded) == _rows(mixed)
    assert sharded.columns == [*COLUMNS, "n_bytes", "depth", "shard", "shard_bytes"]
    sums = Counter()
    for r in sharded.collect():
        sums[r.shard] += r.n_bytes
    assert all(n <= sharding.BYTE_LIMIT for n in sums.values())
    assert all(df.columns == COLUMNS for df in stages[:-1])


def test_stages_take_awkward_and_empty_tables(spark, sf_dir, awkward, empty, tmp_path):
    for start in (awkward, empty):
        docs = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            if i < 4:
                assert out.columns == docs.columns
            path = str(tmp_path / f"{start.count()}-{i}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if start is awkward and i == 1:
                assert [r.doc_id for r in docs.where("text like 'The quick%'").collect()] == [1]
                assert docs.where("doc_id is null").count() == 1  # the one without text is a copy of document 3


def test_an_id_with_several_texts_stays_only_where_it_leads(spark, sf_dir):
    prose = [" ".join(f"{w}{i * k % 97}" for k in range(1, 60)) for i, w in ((3, "a"), (5, "b"), (7, "c"))]
    rows = [(1, prose[0]), (2, prose[0]), (2, prose[1]), (2, prose[1]), (5, prose[1]), (4, prose[2]), (4, prose[2]), (None, prose[2])]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, sf_dir).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == [(1, prose[0]), (2, prose[1]), (4, prose[2])]


def test_run_removes_what_its_stages_wrote(spark, sf_dir):
    from pathlib import Path

    from tidegauge.session import checkpoint_dir

    assert corpus_pipeline.run(spark, sf_dir.replace("0.01", "0.001")).count() > 0
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    newest = max(folder.glob("pipeline-*"), key=lambda p: p.stat().st_mtime)
    assert [p.name for p in newest.iterdir()] == [str(len(corpus_pipeline.STAGES) - 1)]
