
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa

from logsentinel.llm import decontam, neardup, packing, tokens, toxicity
from logsentinel.llm import textkit as K


def test_toxicity_does_not_grow_with_length(spark):
    at = "/root/testdata/sf0.1"
    model = toxicity.fit(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    words, bias = toxicity.bucket_scores(model), model["bias"][1] - model["bias"][0]

    def scores(texts):
        bags = toxicity.Bags([K.utf8(pa.array(texts))])
        return bags.texts(bags.of_words(words)) + bias

    sql = "select any_value(text) from '{0}/documents.parquet' join '{0}/labels.parquet' using (doc_id) where toxic = {1} group by doc_id order by doc_id"
    clean, toxic = ([r[0] for r in duckdb.sql(sql.format(at, y)).fetchall()] for y in (0, 1))
    clean = [t for t, z in zip(clean, scores(clean), strict=True) if z < 0]
    toxic = sorted((t for t, z in zip(toxic, scores(toxic), strict=True) if z > 0), key=len)[:50]
    rng = random.Random(4)
    for _ in range(3):
        parts = []
        while sum(map(len, parts)) < 1 << 20:
            parts.append(rng.choice(clean))
        whole, spoiled = scores(["\n".join(parts), "\n".join([*parts[:99], rng.choice(toxic), *parts[99:]])])
        assert whole < 0 < spoiled


def test_toxicity_learns_from_long_texts(spark, monkeypatch):
    texts = ["long " * 20_000, "bad " * 20_000, "short", "brief"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    taken = lambda: sorted(tuple(r) for r in toxicity.training_rows(docs, labels, held=9).collect())
    assert taken() == sorted(zip(texts, [0, 1, 0, 1], strict=True))
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", {0: 1000, 1: 1 << 20})
    assert taken() == sorted(zip(texts[1:], [1, 0, 1], strict=True))


def test_samples_have_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, held=9).collect()
    assert len(rows) == 2 and {r.label for r in rows} == {0, 1} and ("", 0) in [tuple(r) for r in rows]


def test_toxicity_windows_are_all_runs_of_words():
    words = [f"w{i}" for i in range(20)]
    bags = toxicity.Bags([K.utf8(pa.array([" ".join(words), ""])), K.utf8(pa.array(["w0 w1 w2", "w3"]))])
    score = np.random.default_rng(1).normal(size=bags.words)
    at = score[bags.word]
    runs = [at[i : i + toxicity.WINDOW].mean() for i in range(len(words) - toxicity.WINDOW + 1)]
    assert np.allclose(bags.texts(score), [max(runs), 0, at[20:23].mean(), at[23] / 2], atol=1e-6)


def test_drops_judge_rows_and_not_ids(spark):
    rng = random.Random(6)
    prose = lambda: " ".join(f"{rng.choice('bdfgk')}{rng.choice('aeiou')}{rng.randrange(10**6)}" for _ in range(60))
    leak, clean, other, copied = (prose() for _ in range(4))
    benchmark = spark.createDataFrame([("b1", " ".join(leak.split()[20:40]))], "item_id string, text string")
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    rows = [(None, leak, "a"), (1, leak, "b"), (1, clean, "c"), (2, leak, "d"), (2, None, "e"), (None, clean, "f"), (3, "", "g")]
    left = decontam.drop_contaminated(table(rows), benchmark)
    assert left.columns == ["doc_id", "text", "source"] and sorted(r.source for r in left.collect()) == ["c", "e", "f", "g"]
    near = copied + " end"
    rows = [(5, copied, "a"), (5, copied, "a"), (7, copied, "b"), (None, near, "c"), (None, near, "c"), (9, clean, "d"), (9, other, "e"), (None, leak, "f"), (None, leak, "f"), (8, None, "g"), (None, "", "h")]
    left = neardup.drop_near_duplicates(table(rows))
    assert left.columns == ["doc_id", "text", "source"] and sorted(r.source for r in left.collect()) == ["a", "d", "e", "f", "g", "h"]


def test_packing_keeps_large_ids_beside_null_ones(spark):
    ids = [2**53 + 1, None, 2**62 + 3, 7, -(2**60) - 1]
    docs = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    got = [r.doc_id for r in packing.pack_documents(docs).collect()]
    assert sorted(got, key=str) == sorted(ids, key=str)


def test_units_of_over_16_million_tokens(monkeypatch):
    class Encoded:
        def __init__(self, ids):
            self.ids = ids

    long = np.arange((1 << 24) + 5, dtype=np.uint32)
    coder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    monkeypatch.setattr(coder, "_encode", lambda texts: [Encoded(long if t.strip() == "long" else np.array([1, 2])) for t in texts])
    values, first = coder.units(*K.utf8(pa.array(["long", "a", "", "long"])))
    assert tokens.per_text(coder.lengths(values), first).tolist() == [len(long), 2, 0, len(long)]
    assert np.array_equal(coder.ids_of(values), np.concatenate([long, [1, 2], long]))
