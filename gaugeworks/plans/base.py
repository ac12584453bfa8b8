"""The test tables as inspection data: customers are projects, orders measured parts, their items characteristics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions.exprs import DEC
from gaugeworks.operators.tolerance import GENERAL, general_tolerance, table_cells


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task sorts, about, where a window needs them by project.
SORTED = 500_000


def tasks(table: DataFrame) -> int:
    """A task for each SORTED rows of `table` (a count from its footers)."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // SORTED))


def dealt(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """`rows` dealt by `keys` into as many tasks as `table` asks for, so that sorts do not grow with the table."""
    return rows.repartition(tasks(table), *keys)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order and part the line with the highest number, of equal ones the dearest; `sign` is 1 where it was accepted, 2 where it was returned, else 0.

    Lines meet their orders first, so that lines of one order and part are in one task by then; all values are of fixed width, which hashing asks.
    """
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount", F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("sign"), (F.col("l_linenumber") * 10000000 + F.col("l_extendedprice")).alias("order"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy(F.col("o_custkey").alias("project_id"), F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("char_id")).agg(F.max_by("l_discount", "order").alias("l_discount"), F.max_by("sign", "order").alias("sign"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects and the parts that their orders have, once each; dealt by part, as parts meet them next."""
    lines, orders = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("project_id"), F.col("l_partkey").alias("char_id")).repartition("char_id").distinct()


def samples(spark: SparkSession, sf_dir: str, n_tasks: int | None = None) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    orders = orders.repartition(n_tasks, "o_custkey") if n_tasks else orders
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("sample_id"), pos.alias("pos"), F.col("o_orderkey").cast("string").alias("serial"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with kind, nominal and the limits of ISO 2768-1 m; some are rejected, some not to be inspected."""
    kind = F.element_at(F.array(*map(F.lit, ("linear", "diameter", "radius", "angle"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    part = load(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), F.col("p_size").cast(DEC).alias("nominal"), F.when(F.col("p_partkey") % 29 == 0, "rejected").otherwise("open").alias("status"), (F.col("p_partkey") % 31 != 0).alias("inspect"))
    part = general_tolerance(part, table_cells(spark, GENERAL))
    return part.withColumn("upper_limit", (F.col("nominal") + F.col("tolerance")).cast(DEC)).withColumn("lower_limit", (F.col("nominal") - F.col("tolerance")).cast(DEC))


def characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).join(parts(spark, sf_dir), F.col("char_id") == F.col("p_partkey")).withColumn("pos", F.col("char_id")).drop("p_partkey")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values around the size; every second angle has an attribute instead, or none."""
    size = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast(DEC).alias("nominal"))
    rows = items(spark, sf_dir).join(size, F.col("char_id") == F.col("p_partkey"))
    flag = F.col("char_id") % 8 == 3
    value = (F.col("nominal") + (F.col("l_discount").cast("decimal(12,2)") - F.lit("0.05").cast("decimal(12,2)")) * 10).cast(DEC)
    attribute = F.when(flag & (F.col("sign") == 1), "ok").when(flag & (F.col("sign") == 2), "not_ok")
    rows = rows.withColumn("attribute", attribute).withColumn("value", F.when(~flag, value)).where("value is not null or attribute is not null")
    return rows.select("project_id", "sample_id", "char_id", "value", "attribute")


CTE = """
item AS (SELECT o_custkey AS project_id, l_orderkey AS sample_id, l_partkey AS char_id, arg_max(l_discount, l_linenumber * 10000000 + l_extendedprice) AS disc, arg_max(l_returnflag, l_linenumber * 10000000 + l_extendedprice) AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
pt AS (SELECT p_partkey, ['linear', 'diameter', 'radius', 'angle'][p_partkey % 4 + 1] AS kind, CAST(p_size AS DECIMAL(28,12)) AS nominal, p_partkey % 29 <> 0 AND p_partkey % 31 <> 0 AS meas,
  CAST(CASE p_partkey % 4 WHEN 3 THEN NULL WHEN 2 THEN CASE WHEN p_size <= 3 THEN 0.2 WHEN p_size <= 6 THEN 0.5 ELSE 1 END ELSE CASE WHEN p_size <= 6 THEN 0.1 WHEN p_size <= 30 THEN 0.2 ELSE 0.3 END END AS DECIMAL(28,12)) AS tol FROM part),
ch AS (SELECT DISTINCT project_id, char_id FROM item),
mc AS (SELECT ch.*, pt.* FROM ch JOIN pt ON char_id = p_partkey WHERE meas),
sa AS (SELECT o_custkey AS project_id, o_orderkey AS sample_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders),
res AS (SELECT project_id, sample_id, char_id, CASE WHEN char_id % 8 = 3 THEN NULL ELSE p_size + (CAST(disc AS DECIMAL(12,2)) - 0.05) * 10 END AS value,
  CASE WHEN char_id % 8 = 3 THEN CASE flag WHEN 'A' THEN 'ok' WHEN 'R' THEN 'not_ok' END END AS attribute FROM item JOIN part ON char_id = p_partkey),
dense AS (SELECT mc.project_id, mc.char_id, sa.sample_id, sa.pos, CASE WHEN attribute = 'ok' THEN 'pass' WHEN attribute = 'not_ok' THEN 'fail' WHEN value IS NULL THEN 'missing' WHEN tol IS NULL THEN 'not_evaluated' WHEN value BETWEEN nominal - tol AND nominal + tol THEN 'pass' ELSE 'fail' END AS verdict,
  CASE WHEN value IS NOT NULL AND tol IS NOT NULL THEN CASE WHEN value < nominal - tol THEN 'below' WHEN value > nominal + tol THEN 'above' WHEN value = nominal - tol THEN 'on_lower' WHEN value = nominal + tol THEN 'on_upper' ELSE 'inside' END END AS position
  FROM mc JOIN sa USING (project_id) LEFT JOIN res USING (project_id, sample_id, char_id))
"""
COUNTS = "count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'fail') AS fail, count(*) FILTER (verdict = 'not_evaluated') AS not_evaluated, count(*) FILTER (verdict = 'missing') AS missing"
OVERALL = "CASE WHEN fail > 0 THEN 'fail' WHEN pass > 0 AND pass = pass + fail + not_evaluated + missing THEN 'pass' ELSE 'open' END"
STATE = CTE + f""",
state AS (SELECT 'characteristic' AS grain, project_id, char_id AS key, {COUNTS} FROM dense GROUP BY project_id, char_id
  UNION ALL SELECT 'sample', s.project_id, s.sample_id, {COUNTS} FROM sa s LEFT JOIN dense d ON s.project_id = d.project_id AND s.sample_id = d.sample_id GROUP BY s.project_id, s.sample_id
  UNION ALL SELECT 'project', s.project_id, -1, {COUNTS} FROM (SELECT DISTINCT project_id FROM sa) s LEFT JOIN dense d ON s.project_id = d.project_id GROUP BY s.project_id),
st AS (SELECT *, {OVERALL} AS verdict FROM state)
"""
