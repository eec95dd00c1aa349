import corpus_pipeline
from quern.llm.common import read
from quern.llm.decontam import contamination
from quern.llm.neardup import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = read(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        seen[name] = docs = spark.createDataFrame(out.toPandas(), out.schema)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    columns = read(spark, SF, "documents").columns
    assert all(seen[n].columns == columns for n in names[:-1])
    assert seen["toxicity"].count() == seen["line_dedup"].count() > seen["near_dedup"].count()
    assert near_duplicates(seen["near_dedup"]).filter("not kept").count() == 0
    assert contamination(seen["decontamination"], read(spark, SF, "benchmark")).filter("contaminated").count() <= 1
    assert {r.doc_id for r in seen["packing"].collect()} == {r.doc_id for r in seen["decontamination"].collect()}
