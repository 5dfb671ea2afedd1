"""A registry of named, parameterised queries. A wrong argument is an answer that says so, not an exception."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tools:
    def __init__(self):
        self.known: dict[str, tuple[Callable, dict[str, type], str]] = {}

    def tool(self, **params: type):
        """Registers f(spark, sf_dir, **params) under its name."""

        def register(f):
            self.known[f.__name__] = (f, params, (f.__doc__ or "").strip())
            return f

        return register

    def describe(self, spark: SparkSession) -> DataFrame:
        rows = [(n, d, sorted(f"{k}: {t.__name__}" for k, t in p.items())) for n, (_, p, d) in sorted(self.known.items())]
        return spark.createDataFrame(rows, "name string, says string, params array<string>")

    def call(self, spark: SparkSession, sf_dir: str, name: str, **args) -> DataFrame:
        wrong = None
        if name not in self.known:
            wrong = f"there is no tool {name}"
        else:
            f, params, _ = self.known[name]
            extra = sorted(set(args) - set(params))
            bad = sorted(k for k, v in args.items() if k in params and v is not None and not isinstance(v, params[k]))
            wrong = f"unknown arguments: {', '.join(extra)}" if extra else f"wrong type: {', '.join(bad)}" if bad else None
        if wrong:
            return spark.range(1).select(F.lit(wrong).alias("error"))
        return f(spark, sf_dir, **args)


TOOLS = Tools()


@TOOLS.tool(system=str, dn=int, designation=str)
def pipes(spark: SparkSession, sf_dir: str, system: str | None = None, dn: int | None = None, designation: str | None = None) -> DataFrame:
    """Metres per designation and dimension; what is not given is no filter."""
    from plumbline.plans.filters import only
    from plumbline.plans.takeoff import runs

    return only(runs(spark, sf_dir), system=system, dn=dn, designation=designation).groupBy("designation", "dn").agg(F.sum("metres").alias("metres"))


@TOOLS.tool(designation=str)
def sheets_of(spark: SparkSession, sf_dir: str, designation: str | None = None) -> DataFrame:
    """The sheets on which a designation stands."""
    from plumbline.plans.filters import only
    from plumbline.plans.takeoff import runs

    return only(runs(spark, sf_dir), designation=designation).groupBy("sheet").agg(F.count("*").alias("runs"))


@TOOLS.tool(designation=str, metres=int)
def propose_erase(spark: SparkSession, sf_dir: str, designation: str | None = None, metres: int | None = None) -> DataFrame:
    """A correction as a proposal, which changes nothing; refused if there is less than it would erase."""
    from plumbline.plans.takeoff import runs

    q = runs(spark, sf_dir).where(F.upper("designation") == (designation or "").upper()).agg(F.coalesce(F.sum("metres"), F.lit(0)).alias("there"))
    want = F.lit(metres or 0)
    return q.select(F.lit("erase").alias("kind"), F.lit(designation).alias("designation"), want.alias("metres"), ((want > 0) & (want <= F.col("there"))).alias("accepted"), F.when(want <= 0, "nothing to erase").when(want > F.col("there"), "less than that is there").alias("reason"))


@TOOLS.tool(by=str)
def quantities(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Metres and runs by designation, system or dimension."""
    from plumbline.plans.takeoff import runs

    key = {"system": "system", "dn": "dn"}.get(by or "", "designation")
    return runs(spark, sf_dir).groupBy(F.col(key).alias("key")).agg(F.sum("metres").alias("metres"), F.count("*").alias("runs"))


@TOOLS.tool(ids=list)
def measure(spark: SparkSession, sf_dir: str, ids: list | None = None) -> DataFrame:
    """Metres and sheets of each pipe in a list; one that is not there is a row that says so."""
    from plumbline.plans.takeoff import runs

    asked = spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids or [])], "id bigint")
    m = runs(spark, sf_dir).join(F.broadcast(asked), F.col("part") == F.col("id"), "left_semi").groupBy(F.col("part").alias("id")).agg(F.sum("metres").alias("metres"), F.count_distinct("sheet").alias("sheets"))
    return asked.join(m, "id", "left").select("id", "metres", F.coalesce("sheets", F.lit(0)).alias("sheets"), F.when(F.col("metres").isNull(), "there is no such pipe").otherwise("found").alias("state"))
