"""Documents of more than a thousand units."""

from rhetree.plans.bridge import PAIRS, UNITS


def test_pair_numbers_are_unique(spark):
    turns = spark.range(1, 1002).selectExpr("CAST(7 AS BIGINT) AS conv_id", "id - 1 AS turn", "'a b' AS text")
    units = spark.sql(UNITS.replace("FROM conversations", "FROM {c}"), c=turns)
    pairs = spark.sql(PAIRS.replace("FROM units", "FROM {u}").replace("JOIN units", "JOIN {u}"), u=units)
    assert pairs.select("pair_ix").distinct().count() == pairs.count() == 1001 * 1001
