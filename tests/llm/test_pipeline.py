import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from loomgraph.llm import bpe, mixing, quality_rules, secrets, simhash  # noqa: E402
from loomgraph.llm.common import Scratch  # noqa: E402


def test_stages_hand_on_the_columns_and_take_effect(spark, docs):
    scratch, table = Scratch(spark, "test"), docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = table, scratch.keep(stage(spark, table, ""))
        if name == "quality rules":
            assert out.count() == quality_rules.judge(before).where("kept").count() < before.count()
        if name == "near duplicates":
            groups = simhash.near_duplicates(before, 5, 4, 4, 0.8).select("root").distinct().count()
            assert out.count() == groups
        if name == "secrets":
            assert secrets.op6(out).where("n_assign > 0").count() == 0 and out.count() == before.count()
        if name == "mixing":
            assert out.count() == sum(len(r.shards.split(",")) for r in mixing.op4(before).collect() if r.shards)
        if name == "byte-level BPE":
            assert out.count() == before.count() and sorted(out.select("ids_sha256").collect()) == sorted(bpe.op8(before).select("ids_sha256").collect())
        else:
            assert out.columns == docs.columns
        table = out


def test_run_equals_the_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table = docs
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, "")
    names = ["doc_id", "n_tokens", "ids_sha256"]
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select(*names).collect())) == sorted(map(str, table.select(*names).collect()))
