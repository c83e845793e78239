"""The driver's star schema read as a typed property graph.

region -> Act, nation -> Section, customer -> Case, supplier -> Subsection,
part -> Proviso, orders -> Paragraph; urgent orders belong to a private matter.
The mapping is plain SQL that either engine can run over tables or views.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES_SQL = """
SELECT concat('region:', r_regionkey) AS id, 'Act' AS node_type, 1 AS tier, CAST(NULL AS VARCHAR(9)) AS matter_id, r_name AS label, 1950 AS yr, CAST(NULL AS VARCHAR(10)) AS valid_to, concat('Act for the region of ', r_name) AS body FROM {region}
UNION ALL SELECT concat('nation:', n_nationkey), 'Section', 2, NULL, concat('Section ', n_nationkey), 1960 + n_nationkey, NULL, concat('Section on ', n_name, ' under the act') FROM {nation}
UNION ALL SELECT concat('customer:', c_custkey), 'Case', 3, NULL, c_name, 1950 + CAST(c_custkey % 70 AS INT), NULL, concat('Case of ', c_name, ' in the segment ', c_mktsegment) FROM {customer}
UNION ALL SELECT concat('supplier:', s_suppkey), 'Subsection', 3, NULL, s_name, 1970, NULL, concat('Subsection for ', s_name) FROM {supplier}
UNION ALL SELECT concat('part:', p_partkey), 'Proviso', 4, NULL, p_name, 1980, NULL, concat('Proviso about ', p_name, ' of ', p_brand, ' and ', p_type) FROM {part}
UNION ALL SELECT concat('order:', o_orderkey), 'Paragraph', 5, CASE WHEN o_orderpriority = '1-URGENT' THEN concat('m', o_custkey % 7) END, concat('para ', o_orderkey), CAST(year(o_orderdate) AS INT),
  CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END, concat('Paragraph ', o_orderkey, ' with status ', o_orderstatus, ' and priority ', o_orderpriority) FROM {orders}
"""

EDGES_SQL = """
SELECT 'CHAPTER_CONTAINS_SECTION' AS edge_type, concat('region:', n_regionkey) AS src, concat('nation:', n_nationkey) AS dst FROM {nation}
UNION ALL SELECT 'CASE_INTERPRETS_SECTION', concat('customer:', c_custkey), concat('nation:', c_nationkey) FROM {customer}
UNION ALL SELECT 'SECTION_CONTAINS_SUBSECTION', concat('nation:', s_nationkey), concat('supplier:', s_suppkey) FROM {supplier}
UNION ALL SELECT 'CASE_CITES_CASE', concat('customer:', o_custkey), concat('order:', o_orderkey) FROM {orders}
UNION ALL SELECT DISTINCT 'SECTION_HAS_PROVISO', concat('supplier:', l_suppkey), concat('part:', l_partkey) FROM {lineitem}
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: Of each table that a mapping reads, the kind of the ids that it makes (what stands before the colon) and the column of their key.
ID_KEYS = {"region": ("region", "r_regionkey"), "nation": ("nation", "n_nationkey"), "customer": ("customer", "c_custkey"), "supplier": ("supplier", "s_suppkey"), "part": ("part", "p_partkey"), "orders": ("order", "o_orderkey")}
END_KEYS = {
    "src": {"nation": ("region", "n_regionkey"), "customer": ("customer", "c_custkey"), "supplier": ("nation", "s_nationkey"), "orders": ("customer", "o_custkey"), "lineitem": ("supplier", "l_suppkey")},
    "dst": {"nation": ("nation", "n_nationkey"), "customer": ("nation", "c_nationkey"), "supplier": ("supplier", "s_suppkey"), "orders": ("order", "o_orderkey"), "lineitem": ("part", "l_partkey")},
}


@dataclass
class GraphTables:
    """A graph store: two DataFrames. Any source that yields these columns can stand in."""

    nodes: DataFrame
    edges: DataFrame

    def nodes_of(self, ids: DataFrame) -> DataFrame:
        """The nodes among ``ids`` (id, distinct)."""
        return self.nodes.join(ids, "id", "left_semi")

    def edges_at(self, ids: DataFrame, end: str) -> DataFrame:
        """The edges whose ``end`` (src or dst) is among ``ids`` (id, distinct)."""
        return self.edges.join(ids.withColumnRenamed("id", end), end, "left_semi")


@dataclass
class StarTables(GraphTables):
    """The star schema as a graph; few ids are looked up by the tables' own keys, so ids are written for what is found alone."""

    tables: dict[str, DataFrame]

    def nodes_of(self, ids: DataFrame) -> DataFrame:
        return _mapped(ids.sparkSession, NODES_SQL, self._met(ids, ID_KEYS))

    def edges_at(self, ids: DataFrame, end: str) -> DataFrame:
        return _mapped(ids.sparkSession, EDGES_SQL, self._met(ids, END_KEYS[end]))

    def _met(self, ids: DataFrame, keys: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
        """The rows of each table whose key is among ``ids``."""
        key = F.substring_index("id", ":", -1).try_cast("long")
        parts = ids.select("id", F.substring_index("id", ":", 1).alias("kind"), key.alias("key")).filter(F.concat("kind", F.lit(":"), F.col("key").cast("string")) == F.col("id"))
        wanted = lambda kind: parts.filter(F.col("kind") == kind).select("key")
        return {t: self.tables[t].join(wanted(kind), F.col(column).cast("long") == F.col("key"), "left_semi") for t, (kind, column) in keys.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    return spark.sql(text.replace("VARCHAR(9)", "STRING").replace("VARCHAR(10)", "STRING"), **{t: df for t, df in tables.items() if "{" + t + "}" in text})


def star_graph(spark: SparkSession, sf_dir: str) -> StarTables:
    tables = {t: table(spark, sf_dir, t) for t in TABLES}
    return StarTables(_mapped(spark, NODES_SQL, tables), _mapped(spark, EDGES_SQL, tables), tables)


def plain(text: str) -> str:
    """The mapping over views that bear the tables' own names."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text
