"""SQL text and expressions from callers, and functions by name. Text is parsed by Spark, never run as Python.

What a caller may say is a list of what is allowed, checked on Spark's own plan of the text and not on its letters: kinds of plan node,
kinds of expression, functions by the group that they are documented in, and relations that the caller was given.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Collection, Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeResult

#: Names of Spark's classes and function groups. Commands, scripts, paths, hints that name them and calls out of SQL are in none.
NODES = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Union Distinct Except Intersect Deduplicate SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation "
    "UnresolvedInlineTable UnresolvedTableValuedFunction ResolvedInlineTable LocalRelation OneRowRelation UnresolvedWith UnresolvedHaving WithWindowDefinition Window Generate Pivot Unpivot Tail".split()
)
EXPRESSIONS = frozenset(
    "UnresolvedAttribute UnresolvedStar UnresolvedStarWithColumns UnresolvedFunction UnresolvedAlias UnresolvedExtractValue UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedGenerator "
    "UnresolvedWindowExpression UnresolvedInlineTable UnresolvedSubqueryColumnAliases MultiAlias".split()
)
GROUPS = frozenset(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs date_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs "
    "string_funcs struct_funcs url_funcs variant_funcs window_funcs xml_funcs".split()
)
TABLE_FUNCTIONS = frozenset(["range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"])
_EXPRESSION_PACKAGES = ("org.apache.spark.sql.catalyst.expressions.", "org.apache.spark.sql.types.")


class Refused(ValueError):
    """What a caller isn't allowed to say."""


def _each(seq: JavaObject) -> Iterator[JavaObject]:
    for i in range(seq.size()):
        yield seq.apply(i)


class _Checked:
    """Walks a parsed plan and refuses what isn't allowed."""

    def __init__(self, spark: SparkSession, functions: Collection[str] = ()):
        self.session = spark._jsparkSession.sessionState()
        self.jvm, self.spark = spark.sparkContext._jvm, spark
        self.own, self.ctes = {f.lower() for f in functions}, set()

    def _is(self, x: JavaObject, name: str) -> bool:
        return bool(self.jvm.java.lang.Class.forName(name).isInstance(x))

    def plan(self, node: JavaObject) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in NODES:
            raise Refused(f"only queries are executed: {kind} is none")
        if kind == "UnresolvedWith":
            for pair in _each(node.cteRelations()):
                self.ctes.add(pair._1().lower())
            for pair in _each(node.cteRelations()):
                self.plan(pair._2())
        if kind == "UnresolvedRelation":
            self.relation([str(p) for p in _each(node.multipartIdentifier())])
        if kind == "UnresolvedTableValuedFunction":
            name = ".".join(str(p) for p in _each(node.name()))
            if name.lower() not in TABLE_FUNCTIONS:
                raise Refused(f"no table function {name}")
        if kind == "Generate":
            self.expression(node.generator())
        for e in _each(node.expressions()):
            self.expression(e)
        for child in _each(node.children()):
            self.plan(child)

    def relation(self, parts: list[str]) -> None:
        """A name of the query itself or of the catalog; a path with the name of a format before it is in neither."""
        if len(parts) == 1 and parts[0].lower() in self.ctes:
            return
        if not self.spark.catalog.tableExists(".".join("`" + p.replace("`", "``") + "`" for p in parts)):
            raise Refused(f"no table {'.'.join(parts)}")

    def expression(self, e: JavaObject) -> None:
        name = e.getClass().getName()
        kind = name.rpartition(".")[2]
        if kind == "UnresolvedFunction":
            self.function([str(p) for p in _each(e.nameParts())])
        elif kind == "UnresolvedGenerator":
            self.function([str(e.name().funcName())])
        elif not (kind in EXPRESSIONS or name.startswith(_EXPRESSION_PACKAGES) and "Reflect" not in kind and not kind.startswith(("Invoke", "StaticInvoke", "NewInstance", "ScalaUDF", "PythonUDF"))):
            raise Refused(f"no {kind} in expressions")
        if self._is(e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            self.plan(e.plan())
        for child in _each(e.children()):
            self.expression(child)

    def function(self, parts: list[str]) -> None:
        name = parts[-1].lower()
        if name in self.own and len(parts) == 1:
            return
        builtin = getattr(self.jvm.org.apache.spark.sql.catalyst.analysis, "FunctionRegistry").builtin()
        identifier = self.jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
        info = builtin.lookupFunction(identifier)
        if len(parts) > 1 or not info.isDefined() or info.get().getGroup() not in GROUPS:
            raise Refused(f"no function {'.'.join(parts)}")
        own = self.session.functionRegistry().lookupFunction(identifier)
        if own.isDefined() and own.get().getClassName() != info.get().getClassName():
            raise Refused(f"function {name} has been replaced")


def execute_sql(spark: SparkSession, text: str, functions: Collection[str] = ()) -> DataFrame:
    """The result of one query over tables and views that the session knows; ``functions`` names functions of the session's own
    that it may call. Anything else is refused."""
    _Checked(spark, functions).plan(spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
    return spark.sql(text)


def evaluate(df: DataFrame, expression: str, name: str = "result", functions: Collection[str] = ()) -> DataFrame:
    """``df`` with an expression's value as text."""
    spark = df.sparkSession
    _Checked(spark, functions).expression(spark._jsparkSession.sessionState().sqlParser().parseExpression(expression))
    return df.withColumn(name, F.expr(expression).cast("string"))


class Functions:
    """Functions by name, with up to seven parameters and defaults; found exactly, else by upper-case name."""

    def __init__(self) -> None:
        self.by_name: dict[str, Callable] = {}

    def register(self, *names: str) -> Callable[[Callable], Callable]:
        def put(f: Callable) -> Callable:
            if len(inspect.signature(f).parameters) > 7:
                raise ValueError("at most seven parameters")
            self.by_name.update(dict.fromkeys(names, f))
            return f

        return put

    def find(self, name: str) -> Callable | None:
        if name in self.by_name:
            return self.by_name[name]
        return next((f for n, f in self.by_name.items() if n.upper() == name.upper()), None)

    def names(self) -> str:
        return "|".join(sorted(self.by_name))

    def call(self, name: str, *arguments):
        if (f := self.find(name)) is None:
            raise LookupError(f"Unknown tool: {name}")
        return f(*arguments)

    def in_sql(self, spark: SparkSession, name: str, returns: str) -> None:
        """Makes a function callable in SQL, under each name that it has; arguments with defaults may be left out there too."""
        if (f := self.find(name)) is None:
            raise LookupError(f"Unknown tool: {name}")
        for known in (n for n, g in self.by_name.items() if g is f):
            spark.udf.register(known, F.udf(f, returns, useArrow=True))

    def as_table(self, spark: SparkSession, name: str) -> None:
        """Makes a handler a table function in SQL, under each name that it has, with rows (step, kind, value): a generator's yields are its progress,
        what it returns is its answer; any other function's value is its answer. Values are texts; arguments may be left out where they have
        defaults, and a wrong number of them is found when the query is analysed."""
        if (f := self.find(name)) is None:
            raise LookupError(f"Unknown tool: {name}")
        names = [n for n, g in self.by_name.items() if g is f]
        parameters = inspect.signature(f).parameters.values()
        least, most = sum(p.default is p.empty for p in parameters), len(parameters)

        class Handled:
            @staticmethod
            def analyze(*arguments) -> AnalyzeResult:
                if not least <= len(arguments) <= most:
                    raise ValueError(f"{names[0]} takes {least} to {most} arguments")
                return AnalyzeResult(T.StructType().add("step", T.IntegerType()).add("kind", T.StringType()).add("value", T.StringType()))

            def eval(self, *arguments):
                made, step = f(*arguments), 0
                if inspect.isgenerator(made):
                    while True:
                        try:
                            value = next(made)
                        except StopIteration as end:
                            made = end.value
                            break
                        step += 1
                        yield step, "progress", None if value is None else str(value)
                yield step + 1, "answer", None if made is None else str(made)

        for known in names:
            spark.udtf.register(known, udtf(Handled))
