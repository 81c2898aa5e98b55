from kalkula.operators import weights


def test_normalize_takes_the_first_of_the_largest(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 40), (1, 3, 40), (2, 4, None), (2, 5, 7)], "job_id int, item_id int, steps long")
    got = {r.item_id: r.normal_steps for r in weights.normalize_on_largest(df, "steps", dp=0).collect()}
    assert (got[1], got[2], got[3], got[5]) == (10, 50, 40, 100)
