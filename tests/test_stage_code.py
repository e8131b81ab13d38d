from terranet.operators import gradient as G, mesh as M
from terranet.plans.scratch import cut
from tests.helpers import random_grid, to_tables

JIT_LIMIT = 8000  # bytes of a method; HotSpot only interprets larger ones


def test_code_of_the_gradient_is_compiled(spark):
    region = cut(M.full_region(*to_tables(spark, {"a": random_grid(9, 7, 50, 1)})))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or the stages are not known before they run
    try:
        plan = G.gradient_plan(region)._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages = debug.codegenStringSeq(plan)
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 3 and max(sizes) < JIT_LIMIT
