from pyspark.sql import functions as F

from tidegate.functions import prompts
from tidegate.plans import catalog


def test_code_prompt_is_whole(spark):
    """The task, what is expected of the code, and the tools to try it with; nothing of it is left to the caller."""
    rows = spark.createDataFrame([("Sum {} 'a'",), ("",), (None,)], "task string")
    said = [r.p for r in rows.select(prompts.code(F.col("task")).alias("p")).collect()]
    assert said[1:] == [None, None] and "Sum {} 'a'." in said[0]
    assert said[0].count("\n- ") == 5 and "'execute'" in said[0] and "'evaluate'" in said[0] and "Result" in said[0]
    own = rows.select(prompts.code(F.col("task"), "Do {}!").alias("p")).first().p
    assert own == "Do Sum {} 'a'!"


def test_code_prompt_query_and_sql_are_whole(spark):
    messages = catalog.QUERIES["code_prompt"](spark, "/root/testdata/sf0.001").where("conv_id % 3 != 0").select("message").collect()
    assert messages and all("'execute'" in r.message and r.message.count("\\n- ") >= 5 for r in messages)
    assert "''execute''" in catalog.ORACLES["code_prompt"]
