"""The pipeline's language stage: what is in no known language goes, all else stays."""

import pytest
from pyspark.sql import functions as F

from quantloom.llm.langid import keep_known

UNKNOWN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
    "Все люди рождаются свободными и равными в своем достоинстве и правах",
    "人人生而自由,在尊严和权利上一律平等",
    "asdkfj qwlekr zxmcvn qpwoeiru tyghbn vmxcz lkjhgfd poiuyt mnbvcxz",
    "xxxxxxxx xxxxxx xxxxx xxxxxxxx xxxx",
    "12 34 !!",
    None,
]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_unknown_goes_and_known_stays(spark, sf_dir, sf):
    docs = spark.read.parquet(f"{sf_dir}/../{sf}/documents.parquet")
    text = F.element_at(F.array(*[F.lit(t) for t in UNKNOWN]), F.col("k").cast("int"))
    planted = spark.range(1, len(UNKNOWN) + 1).withColumnRenamed("id", "k").select((-F.col("k")).alias("doc_id"), text.alias("text"), F.lit(None).cast("string").alias("lang"))
    mixed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").unionByName(planted)
    got = [r[0] for r in keep_known(mixed, docs).select("doc_id").collect()]
    letters = docs.filter(F.col("text").rlike(r"\p{L}"))
    assert sorted(got) == sorted(r[0] for r in letters.select("doc_id").collect())
