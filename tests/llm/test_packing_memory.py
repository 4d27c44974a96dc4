"""The memory that packing takes and keeps in a Python worker, which other operators share."""

import sys
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from footfall.llm import common, packing


def test_rare_words_do_not_pile_up():
    words = common.Remembered(lambda w: w.encode() * 2)
    for i in range(600_000):
        words[f"word{i}"]
    kept = [words, words.old]
    held = sum(map(sys.getsizeof, kept)) + sum(sys.getsizeof(k) + sys.getsizeof(v) for d in kept for k, v in d.items())
    assert held < 50e6
    assert words["word599999"] == b"word599999word599999" and words["word0"] == b"word0word0"


def test_a_batch_is_encoded_in_small_parts(spark, monkeypatch):
    asked = {}

    def seen(df, fn, fields, text="text", keep=None, most=common.SLICE_BYTES, arrow=False):
        asked.update(fn=fn, most=most)
        return df.withColumn(fields[0].name, common.F.lit(None).cast(fields[0].dataType))

    monkeypatch.setattr(packing, "map_texts", seen)
    packing.pieces(spark.createDataFrame([], T._parse_datatype_string("doc_id long, text string")), packing.vocabulary(), keep=["doc_id"])
    texts = pa.array([" ".join(f"{w} {i % 7}" for w in ("a", "bare", "word") * 400) for i in range(3000)])
    sizes = pa.compute.binary_length(texts).to_pylist()
    assert sum(sizes) > 16 << 20
    work = asked["fn"]()
    work(texts[:1])
    tracemalloc.start()
    n = 0
    for a, b in common.slices(sizes, asked["most"]):
        (rows,) = work(texts[a:b])
        n += len(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and peak < 64 << 20, peak


@pytest.mark.parametrize("n", [0, 1, 25_000])
def test_rows_of_all_batches_come_out(spark, n):
    df = spark.range(n).selectExpr("id", "if(id % 5 = 0, null, concat('t', id)) AS text")
    sized = common.map_texts(df, lambda: lambda texts: [[len(t) if t else 0 for t in texts]], [T.StructField("n", T.LongType())])
    assert sized.where("n != coalesce(length(text), 0)").count() == 0 and sized.count() == n
