from test_mixing import SCHEMA

from lodestone.llm import mixing


def test_mix_comes_in_the_order_of_the_schedule(spark):
    df = spark.createDataFrame([(i, "w " * 1000, "en", "abc"[i % 3], 0, 1) for i in range(300)], SCHEMA)
    _, sources, slots = mixing.planned(df, "doc_id", "text", "source")
    name = {r["place_no"]: r["source"] for r in sources.collect()}
    order = [name[r["place_no"]] for r in slots.where("slot IS NOT NULL").orderBy("slot").collect()]
    got = [r["source"] for r in mixing.mix(df).collect()]
    assert got[: len(order)] == order and len(got) == slots.count()
