"""Stages hand every column through, also those with names that they use themselves."""

import pytest
from pyspark.sql import functions as F

from marketlake.llm import exact_dedup, minhash_dedup, mixing, toxicity

NAMES = [
    "mix_row", "mix_again", "copies", "copy", "MIX_ROW", "toxic_row", "_sha", "_id", "_sha2", "_times", "_content", "_long", "_row", "sha", "doc",
    "sha2", "times", "content", "long", "row", "_gone", "_r", "_copy", "kept", "component_id", "a.b", "size", "source_size", "target", "score",
]


def docs_of(spark, names):
    rows = [(i, f"text number {i % 9} " * (i % 5), "s%d" % (i % 2)) for i in range(40)] + [(3, "text number 3 " * 3, "s1")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.select("*", *[F.concat(F.lit(n + ":"), "source", F.lit("-"), F.length("text")).alias(n) for n in names])


STAGES = {
    "mix": mixing.mix,
    "toxic": lambda d: toxicity.drop_toxic(d, None),
    "exact": exact_dedup.drop_duplicates,
    "near": minhash_dedup.drop_near_duplicates,
}


@pytest.mark.parametrize("stage", list(STAGES))
def test_columns_come_back(spark, stage):
    own = [n for n in NAMES if n != "MIX_ROW"]
    docs = docs_of(spark, own)
    out = STAGES[stage](docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows
    for r in rows:
        for n in own:
            assert r[n] == f"{n}:{r['source']}-{len(r['text'])}"
    plain = STAGES[stage](docs.select("doc_id", "text", "source"))
    assert sorted(r[:3] for r in map(tuple, rows)) == sorted(map(tuple, plain.collect()))


def test_text_in_a_column_called_mix_row(spark):
    docs = docs_of(spark, ["MIX_ROW"])
    assert mixing.copies(docs).count() == docs.count()
    assert mixing.mix(docs).columns == docs.columns
