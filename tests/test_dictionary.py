import time

import pytest
from pyspark.errors import PySparkException

from veilquery.operators import tagger


def test_long_texts_take_time_in_proportion(spark):
    docs = spark.createDataFrame([(1, "the cat of de la x_" * 6000), (2, "OF THE, (in) İnan-Hof. ΟΔΟΣ hof"), (3, None)], "id long, text string")
    known = spark.createDataFrame([("A", "of De"), ("B", "of the in"), ("C", "İnan-hof"), ("D", "οδος Hof"), ("E", "of the"), (None, "x the"), ("F", "_")], "tag string, phrase string")
    began = time.time()
    joined = sorted(map(tuple, tagger.dictionary(docs, known, "id").collect()))
    assert time.time() - began < 60
    assert [r[1:] for r in joined if r[0] == 2] == [(0, 11, "B", "OF THE, (in"), (13, 21, "C", "İnan-Hof"), (23, 31, "D", "ΟΔΟΣ hof")]
    assert [r[1:] for r in joined if r[0] == 1][:2] == [(8, 13, "A", "of de"), (17, 22, None, "x_the")] and len(joined) == 6000 + 5999 + 3
    assert sorted(map(tuple, tagger.dictionary(docs, known, "id", held=2).collect())) == joined


def test_too_long_phrases_are_errors(spark):
    docs = spark.createDataFrame([(1, "a b c")], "id long, text string")
    with pytest.raises(PySparkException):
        tagger.dictionary(docs, spark.createDataFrame([("A", "a b c")], "tag string, phrase string"), "id", longest=2).collect()
