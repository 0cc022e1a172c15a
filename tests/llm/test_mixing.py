import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oddrows.llm import mixing


def test_cdf_inverts_poisson(spark):
    rates = [0.0, 0.3, 1.0, 7.5, 900.0]
    rows = spark.createDataFrame([(r,) for r in rates], "rate double").select("rate", mixing.poisson_cdf(F.col("rate")).alias("cdf")).collect()
    for r in rows:
        total, log = 0.0, -r["rate"]
        for k, have in enumerate(r["cdf"]):
            if k:
                log += math.log(r["rate"] / k)
            total += math.exp(log)
            assert abs(have - total) < 1e-9
        assert abs(r["cdf"][-1] - 1) < 1e-9


def test_shares_reach_their_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 20).alias("text"), F.when(F.col("id") < 4000, "big").when(F.col("id") < 5500, "mid").otherwise("little").alias("source"))
    got = mixing.mix(docs, {"big": 0.5, "mid": 0.25, "little": 0.25}, epochs=2.0).groupBy("source").count().collect()
    sizes = {r["source"]: r["count"] for r in got}
    for source, share in (("big", 0.5), ("mid", 0.25), ("little", 0.25)):
        assert abs(sizes[source] - 12000 * share) < 5 * math.sqrt(12000 * share)


def test_result_does_not_depend_on_partitions(spark, small):
    docs = small.select("doc_id", "source", "text")
    key = lambda df: sorted((r["doc_id"], r["copy"], r["shuffle_key"]) for r in df.collect())
    assert key(mixing.mix(docs)) == key(mixing.mix(docs.repartition(7)))


def test_plan_is_native(small):
    plan = mixing.mix(small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


@pytest.mark.parametrize("frame", ["odd", "none"])
def test_odd_rows(frame, request):
    docs = request.getfixturevalue(frame)
    got = mixing.mix(docs, epochs=4.0)
    assert set(docs.columns) <= set(got.columns)
    copies = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert copies[4, next(r["text"] for r in docs.where("doc_id = 4").take(1))] % 2 == 0 if copies else docs.count() == 0
