import json

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from tidegate.functions import jsonrpc, urls
from tidegate.operators import paging, state, status, usercode
from tidegate.operators.state import Bucket
from tidegate.sources.tables import opened


def allowed(most, rate, arrivals):
    b = Bucket(most, rate)
    return [b.allow(round(t * 1e6)) for t in arrivals]


def test_bucket_cases():
    assert all(allowed(10, 5, [0] * 10))
    assert allowed(5, 1, [0] * 6) == [True] * 5 + [False]
    assert allowed(2, 100, [0, 0, 0, 0.05]) == [True, True, False, True]
    assert sum(allowed(3, 1000, [0.1] * 10)) == 3


@pytest.mark.parametrize("n,cursor,items,next_", [(0, "", 0, None), (5, "", 5, None), (100, "", 50, "50"), (100, "50", 50, None), (75, "50", 25, None), (3, "invalid", 3, None), (3, "-5", 3, None), (3, "9", 0, None)])
def test_pages(spark, n, cursor, items, next_):
    offset = spark.range(1).select(paging.parsed_cursor(F.lit(cursor)).alias("o")).first().o
    rows = paging.page(spark.range(n), ["id"], offset).collect()
    assert len(rows) == items and {r.next_cursor for r in rows} <= {next_}
    assert [r.id for r in rows] == list(range(offset, offset + items))


def test_deep_pages_and_positions(spark, monkeypatch):
    monkeypatch.setattr(paging, "NEAR", 10)
    assert [r.id for r in paging.page(spark.range(500), ["id"], 120, 5).collect()] == [120, 121, 122, 123, 124]
    placed = paging.positions(spark.range(1000).select((999 - F.col("id")).alias("k")), ["k"], range_rows=150)
    assert placed.where("pos <> k").count() == 0 and placed.count() == 1000


@pytest.mark.parametrize("text", [
    "DROP TABLE x", "INSERT INTO x VALUES (1)", "SET a = b", "CREATE TABLE t AS SELECT 1", "FROM tidegate_rows INSERT OVERWRITE TABLE y SELECT *", "import os",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT JAVA_METHOD('java.lang.System', 'exit', 0)",
    "SELECT 1 WHERE EXISTS (SELECT try_reflect('java.lang.System', 'getProperty', 'user.home'))", "SELECT (SELECT max(reflect('java.lang.System', 'nanoTime')) FROM tidegate_rows)",
    "WITH c AS (SELECT reflect('java.lang.System', 'nanoTime') AS x) SELECT * FROM c", "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
    "SELECT * FROM (SELECT value FROM text.`/etc/hostname`)", "SELECT * FROM unknown", "SELECT transform(id) USING 'cat' AS x FROM tidegate_rows", "SELECT * FROM identifier('tidegate_rows')",
    "SELECT identifier('reflect')('java.lang.System', 'nanoTime')", "SELECT input_file_name() FROM tidegate_rows", "SELECT tidegate_secret(1)", "SELECT system.builtin.reflect('java.lang.System', 'nanoTime')",
    "EXPLAIN SELECT 1", "DESCRIBE tidegate_rows", "SHOW TABLES", "SELECT * FROM sql_keywords()", "CALL x()", "SELECT explode(array(reflect('java.lang.System', 'nanoTime')))",
])
def test_refused(spark, text):
    spark.range(3).createOrReplaceTempView("tidegate_rows")
    spark.udf.register("tidegate_secret", lambda x: x)
    with pytest.raises((ValueError, ParseException)):
        usercode.execute_sql(spark, text)


@pytest.mark.parametrize("text,want", [
    ("SELECT 'insert' AS x", ["insert"]), ("SELECT 'reflect(' || max(id) AS x FROM tidegate_rows", ["reflect(2"]), ("VALUES (1), (2)", [1, 2]), ("TABLE tidegate_rows", [0, 1, 2]),
    ("WITH c AS (SELECT id + 1 AS y FROM tidegate_rows) SELECT sum(y) FROM c WHERE y IN (SELECT id FROM tidegate_rows)", [3]), ("SELECT sum(id) OVER (ORDER BY id) FROM range(3) ORDER BY 1", [0, 1, 3]),
    ("SELECT x FROM tidegate_rows LATERAL VIEW explode(array(id, 10)) t AS x WHERE id = 1 ORDER BY x", [1, 10]), ("SELECT a.id FROM tidegate_rows a JOIN tidegate_rows b ON a.id = b.id + 1 ORDER BY 1 DESC LIMIT 1", [2]),
    ("SELECT CASE WHEN id BETWEEN 1 AND 2 THEN upper('a') ELSE CAST(id AS STRING) END FROM tidegate_rows ORDER BY id", ["0", "A", "A"]), ("SELECT id FROM tidegate_rows UNION ALL SELECT 7 ORDER BY 1", [0, 1, 2, 7]),
    ("SELECT count(*) FROM tidegate_rows GROUP BY id % 2 HAVING count(*) > 1", [2]), ("SELECT tidegate_open(4)", [5]), ("SELECT transform(array(1, 2), x -> x + 1)[0]", [2]),
])
def test_executed(spark, text, want):
    spark.range(3).createOrReplaceTempView("tidegate_rows")
    spark.udf.register("tidegate_open", lambda x: x + 1, "int")
    assert [r[0] for r in usercode.execute_sql(spark, text, functions=["tidegate_open"]).collect()] == want


def test_expressions(spark):
    rows = spark.range(2)
    assert [r.result for r in usercode.evaluate(rows, "id * 2 + length('reflect')").orderBy("id").collect()] == ["7", "9"]
    for text in ("java_method('java.lang.System', 'exit', 0)", "try_reflect('java.lang.System', 'nanoTime')", "(SELECT max(value) FROM text.`/etc/hostname`)", "concat('a', reflect('java.lang.System', 'nanoTime'))"):
        with pytest.raises(ValueError):
            usercode.evaluate(rows, text)


def test_names_and_surrogates(spark):
    """Keys with quotes and dots, names as names, doubled keys, and surrogates with and without partner."""
    opened(spark)
    body = r"""{"id":"1","it's[":{"b":1,"a":null},"a.b":2,"a":{"b":3},"q\"":"x"}"""
    got = spark.createDataFrame([(body,)], "j string").select(jsonrpc.answer_body(F.col("j")).alias("b"), jsonrpc.argument(F.col("j"), "a.b").alias("d"), jsonrpc.argument(F.col("j"), "it's[").alias("q"), jsonrpc.argument(F.col("j"), "none").alias("n")).first()
    assert json.loads(got.b) == {"it's[": {"b": 1, "a": None}, "a.b": 2, "a": {"b": 3}, 'q"': "x"} and (got.d, json.loads(got.q), got.n) == ("2", {"a": None, "b": 1}, None)
    twice = spark.createDataFrame([('{"id":1,"id":2,"x":1,"x":null}',), ("[1]",), ("{",)], "j string").select(jsonrpc.kind(F.col("j")).alias("k"), jsonrpc.has_key(F.col("j"), "x").alias("h"), jsonrpc.answer_body(F.col("j")).alias("b"), jsonrpc.field(F.col("j"), "$.id").alias("i"))
    rows = twice.collect()
    assert tuple(rows[0]) == ("OBJECT", True, '{"x":null}', "2") and rows[1].k == "ARRAY" and rows[2].k is None
    texts = ["%uD83D%uDE00", "a%uD83Db", "%uDE00", "%uD83D%uD83D%uDE00x", "%uDE00%uD83D", "%u0416%D0%96", "%uD83D"]
    decoded = [r.d for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", urls.url_decode(F.col("s")).alias("d")).orderBy("i").collect()]
    assert decoded == ["\U0001f600", "a\ufffdb", "\ufffd", "\ufffd\U0001f600x", "\ufffd\ufffd", "ЖЖ", "\ufffd"]


def test_functions_by_name():
    f = usercode.Functions()

    @f.register("Сложить", "add")
    def add(a, b=2):
        return a + b

    assert f.call("add", 1) == 3 and f.call("ADD", 1, 1) == 2 and f.find("СЛОЖИТЬ") is add and f.find("x") is None
    with pytest.raises(LookupError):
        f.call("nothing")
    assert f.names() == "add|Сложить"


def test_functions_in_sql(spark):
    f = usercode.Functions()

    @f.register("tidegate_add", "tidegate_plus")
    def add(a, b=2):
        return a + b

    f.in_sql(spark, "TIDEGATE_ADD", "long")
    assert [tuple(r) for r in spark.sql("SELECT tidegate_add(id), tidegate_plus(id, id) FROM range(3) ORDER BY id").collect()] == [(2, 0), (3, 2), (4, 4)]
    with pytest.raises(LookupError):
        f.in_sql(spark, "nothing", "long")


def test_handlers_as_tables(spark):
    f = usercode.Functions()

    @f.register("tidegate_count", "tidegate_zaehle")
    def count(n, by=1):
        for k in range(0, n, by):
            yield k
        return "done"

    @f.register("tidegate_plain")
    def plain(x=None):
        return x

    for name in ("tidegate_count", "TIDEGATE_PLAIN"):
        f.as_table(spark, name)
    rows = lambda text: [tuple(r) for r in spark.sql(text).collect()]
    assert rows("SELECT * FROM tidegate_zaehle(3, 2)") == [(1, "progress", "0"), (2, "progress", "2"), (3, "answer", "done")]
    assert rows("SELECT * FROM tidegate_plain()") == [(1, "answer", None)] and rows("SELECT * FROM tidegate_plain('x')") == [(1, "answer", "x")]
    assert rows("SELECT id, sum(h.step) FROM range(3) r, LATERAL tidegate_count(CAST(r.id AS INT)) h GROUP BY id ORDER BY id") == [(0, 1), (1, 3), (2, 6)]
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM tidegate_count(1, 2, 3)")
    with pytest.raises(LookupError):
        f.as_table(spark, "nothing")


def test_session_ids_differ(spark):
    made = state.sessions_created(spark.range(200), F.lit("v"), F.current_timestamp())
    assert made.select("session_id").distinct().count() == 200


def test_buckets_by_any_key(spark):
    df = spark.createDataFrame([("c3", "a", "2024-01-01"), ("c3", "b", "2024-01-01"), (None, "c", "2024-01-01"), (None, "d", "2024-01-01"), ("x", "e", "2024-01-01")], "k string, i string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = state.token_bucket(df, "t", "i", "k", 1.0, 0.0).collect()
    assert {(r.key, r.id): r.allowed for r in got} == {("c3", "a"): True, ("c3", "b"): False, (None, "c"): True, (None, "d"): False, ("x", "e"): True}


def test_answers_and_arguments(spark):
    rows = ['{"id":"1","body":"x\\ny"}', '{"id":"1","status":5,"b":{"z":1,"a":2},"a":null}', '{"body":[1, 2]}', "[]", "{no", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string").select("i", jsonrpc.answer_body(F.col("j")).alias("b"), jsonrpc.argument(F.col("j"), "id").alias("a"), jsonrpc.parsed(F.col("j"), F.lit("none")).alias("p")).orderBy("i").collect()
    assert [r.b for r in got][:3] == ["x\ny", '{"a":null,"b":{"a":2,"z":1}}', "[1,2]"]
    assert [r.a for r in got] == ['"1"', '"1"', None, None, None, None] and [r.p for r in got][3:] == ["[]", "none", "none"]


def test_runtime_status(spark):
    steps = [(1, "start", "r1", "t1", 0, 9, ""), (2, "progress", "", "", 3, 9, "half"), (3, "failure", "", "", 0, 0, "broke"), (4, "start", "r2", "t2", 0, 5, ""), (5, "success", "", "", 0, 0, "done"), (6, "progress", "", "", 4, 5, "after")]
    log = spark.createDataFrame([(*s, str(s[0])) for s in steps], "at int, step string, request_id string, tool string, progress int, total int, message string, updated_at string")
    show = lambda n: tuple(status.runtime_status(log.where(F.col("at") <= n), ["at"]).first())
    assert show(0) == (False, "", "", 0, 0, "Idle", "", "", "")
    assert show(2) == (True, "r1", "t1", 3, 9, "half", "", "", "2")
    assert show(3) == (False, "r1", "t1", 3, 9, "Failed.", "", "broke", "3")
    assert show(4) == (True, "r2", "t2", 0, 5, "Started.", "", "", "4")
    assert show(6) == (False, "r2", "t2", 4, 5, "after", "done", "", "6")


def test_registry_keeps_the_last_valid_version(spark):
    df = spark.createDataFrame([("tools", 1, "[1]"), ("tools", 2, "{"), ("tools", 3, "{}"), ("prompts", 1, None)], "r string, v int, p string")
    assert [tuple(r) for r in state.registry_latest(df, "r", ["v"], "p").collect()] == [("tools", 1, "[1]")]
