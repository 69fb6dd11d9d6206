import corpus_pipeline as P
from logsentinel.llm.decontam import decontaminate
from logsentinel.llm.neardup import near_duplicates
from logsentinel.llm.quality import score_quality
from logsentinel.llm.toxicity import score_toxicity

DATA = "/root/testdata/sf0.001"


def test_stages_equal_their_operators(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    docs = read("documents")
    decide = [
        lambda d: ids(score_toxicity(d, read("labels")).where("predicted = 0")),
        lambda d: ids(score_quality(d, read("labels")).where("predicted = 1")),
        lambda d: ids(near_duplicates(d).where("kept")),
        lambda d: ids(decontaminate(d, read("benchmark")).where("NOT contaminated")),
    ]
    for (_, stage), want in zip(P.STAGES[:-1], decide, strict=True):
        kept = want(docs)
        docs = stage(spark, docs, DATA)
        assert docs.columns == read("documents").columns
        assert ids(docs) == kept
    packed = P.run(spark, DATA).toPandas()
    assert set(packed.doc_id) == ids(docs)
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
