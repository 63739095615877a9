"""JN11: claims and operands are joined without a broadcast, however small their files."""

from quillspark import catalogue


def test_no_side_goes_through_the_driver(spark, sf_dir):
    plan = catalogue.QUERIES["JN11_ratios"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
