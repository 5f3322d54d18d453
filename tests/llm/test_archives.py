import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlake.llm import token_codes, warc


def test_frames_are_dealt_to_tasks(spark):
    pages = spark.range(400).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 200).alias("html")
    )
    index = warc.write(pages.coalesce(1), frame=4000)
    records = warc.read(index)
    used = records.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(used) > 1 and sum(r["count"] for r in used) == 400
    assert index.select("bundle").distinct().count() < index.select("bundle", "frame").distinct().count()


def record():
    return warc.record(7, "http://a", b"x" * 50, "d", None, "2000-01-01T00:00:00Z")


def test_whole_records_are_parsed():
    two = record() + record()
    head, payload, end = warc.parse(memoryview(two))
    assert payload == b"x" * 50 and end == len(record()) and warc.parse(memoryview(two), end)[2] == len(two)
    long = warc.record(7, "http://" + "a" * 200_000, b"y", "d", None, "2000-01-01T00:00:00Z")  # headers beyond one block
    assert warc.parse(memoryview(long))[1] == b"y"


@pytest.mark.parametrize("damage", [lambda r: r[:100], lambda r: r[:-3], lambda r: b"\0" * len(r), lambda r: r.replace(b"Content-Length", b"Content-Weight"), lambda r: r[1:], lambda r: r.replace(b"\r\n\r\n", b"\r\n"), lambda r: b""])
def test_damaged_records_raise(damage):
    with pytest.raises(ValueError):
        warc.parse(memoryview(damage(record())))


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 8, 16, 32])
def test_codes_of_any_width_are_right_or_refused(width):
    for top in (1, 100, 49_000, 2**32 - 1):
        ids = np.array([0, top, 1, top // 2, top], np.uint32)
        if max(1, -(-int(top).bit_length() // width)) > 7:
            with pytest.raises(ValueError):
                token_codes.pack([(1, ids)], width)
        else:
            got = token_codes.Codes(token_codes.pack([(1, ids)], width))
            assert [got.token(i) for i in range(5)] == ids.tolist()


def texts_of(letters, n):
    rng = np.random.default_rng(3)
    return ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(n)] + [None]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library(name):
    """Words of any form with signs behind them, and a tokenizer that does not drop white space."""
    path = public_tokenizers.path(name)
    letters = [*"aBéÓßñ.,#'’sS7 \n中ΣЖ_", "###", "!!", "the", "The", "ÇA", "İ", "ŉ", "Ⱥ", "e\u0301", "$$$ ", "'s", "'ll", ". ", "<|endoftext|>", "²", "ª", "ʰ"]
    texts = texts_of(letters, 3000)
    words = token_codes.Words(path, most=200)
    assert words.by_words == (name == "word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    for some in (texts[:1500], texts[1500:]):
        got = token_codes.encode_texts([t if t is None else t.encode() for t in some], words)
        assert [x.tolist() for x in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in some]


def test_workers_keep_one_table():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_codes.words_of(path) is token_codes.words_of(path)
