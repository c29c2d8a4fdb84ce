"""Tables of graphs.  Every relation is keyed by ``graph_id``; ``ord`` keeps the authored order of entities.

nodes (graph_id, node_id, parent_id, ord, x, y, width, height), edges (graph_id, edge_id, source_id, target_id, ord,
weight).  The families below derive graphs from plain tables; ``read_graph_json`` reads authored ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transition_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One cyclic graph per user: event types as nodes, observed successions as weighted edges."""
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = _read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("s"), F.lead("event_type").over(by_time).alias("t"))
    in_order = Window.partitionBy("user_id").orderBy("s")
    nodes = steps.select("user_id", "s").distinct().withColumn("ord", F.row_number().over(in_order) - 1)
    nodes = nodes.select(
        F.col("user_id").cast("string").alias("graph_id"),
        F.col("s").alias("node_id"),
        F.lit(None).cast("string").alias("parent_id"),
        "ord",
        ((F.col("ord") * 37 + F.col("user_id") * 13) % 200).cast("double").alias("x"),
        ((F.col("ord") * 53 + F.col("user_id") * 7) % 150).cast("double").alias("y"),
        (40 + 10 * (F.length("s") % 7)).cast("double").alias("width"),
        (20 + 5 * (F.col("ord") % 5)).cast("double").alias("height"),
    )
    edges = steps.where("t is not null").groupBy("user_id", "s", "t").agg(F.count("*").alias("weight"))
    edges = edges.select(
        F.col("user_id").cast("string").alias("graph_id"),
        F.concat("s", F.lit(">"), "t").alias("edge_id"),
        F.col("s").alias("source_id"),
        F.col("t").alias("target_id"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("s", "t")) - 1).alias("ord"),
        "weight",
    )
    return nodes, edges


#: The same two relations for an independent engine.
TRANSITION_SQL = """
steps AS (SELECT user_id, event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events),
nodes AS (SELECT CAST(user_id AS VARCHAR) AS graph_id, s AS node_id, ord,
    CAST((ord * 37 + user_id * 13) % 200 AS DOUBLE) AS x, CAST((ord * 53 + user_id * 7) % 150 AS DOUBLE) AS y,
    CAST(40 + 10 * (length(s) % 7) AS DOUBLE) AS width, CAST(20 + 5 * (ord % 5) AS DOUBLE) AS height
  FROM (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s) - 1 AS ord FROM (SELECT DISTINCT user_id, s FROM steps))),
edges AS (SELECT CAST(user_id AS VARCHAR) AS graph_id, s || '>' || t AS edge_id, s AS source_id, t AS target_id,
    row_number() OVER (PARTITION BY user_id ORDER BY s, t) - 1 AS ord, weight
  FROM (SELECT user_id, s, t, count(*) AS weight FROM steps WHERE t IS NOT NULL GROUP BY ALL))"""


def trade_graphs(spark: SparkSession, sf_dir: str, most_targets: int = 3) -> tuple[DataFrame, DataFrame]:
    """One graph of the trading nations a year: from each nation to the ``most_targets`` others whose suppliers sold it most lines."""
    o, l, c, s, n = (_read(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "supplier", "nation"))
    lines = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.groupBy(F.year("o_orderdate").alias("y"), F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.count("*").alias("weight")).where("a <> b")
    top = F.row_number().over(Window.partitionBy("y", "a").orderBy(F.desc("weight"), "b"))
    kept = lines.withColumn("k", top).where(F.col("k") <= most_targets)
    name = lambda k: F.lpad(k.cast("string"), 2, "0")
    ends = kept.select("y", F.explode(F.array("a", "b")).alias("n_nationkey")).distinct()
    nodes = ends.join(n.select("n_nationkey", "n_name"), "n_nationkey").select(
        F.col("y").cast("string").alias("graph_id"),
        name(F.col("n_nationkey")).alias("node_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.col("n_nationkey").cast("int").alias("ord"),
        (F.col("n_nationkey") * 71 % 500).cast("double").alias("x"),
        (F.col("n_nationkey") * 43 % 300).cast("double").alias("y"),
        (30 + 10 * (F.length("n_name") % 6)).cast("double").alias("width"),
        (20 + 5 * (F.col("n_nationkey") % 4)).cast("double").alias("height"),
    )
    edges = kept.select(
        F.col("y").cast("string").alias("graph_id"),
        F.concat(name(F.col("a")), F.lit(">"), name(F.col("b"))).alias("edge_id"),
        name(F.col("a")).alias("source_id"),
        name(F.col("b")).alias("target_id"),
        (F.row_number().over(Window.partitionBy("y").orderBy("a", "b")) - 1).alias("ord"),
        "weight",
    )
    return nodes, edges


TRADE_SQL = """
kept AS (SELECT * FROM (SELECT y, a, b, weight, row_number() OVER (PARTITION BY y, a ORDER BY weight DESC, b) AS k
  FROM (SELECT year(o_orderdate) AS y, c_nationkey AS a, s_nationkey AS b, count(*) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL)) WHERE k <= 3),
nodes AS (SELECT CAST(y AS VARCHAR) AS graph_id, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS node_id, n_nationkey AS ord, CAST(n_nationkey * 71 % 500 AS DOUBLE) AS x, CAST(n_nationkey * 43 % 300 AS DOUBLE) AS y,
    CAST(30 + 10 * (length(n_name) % 6) AS DOUBLE) AS width, CAST(20 + 5 * (n_nationkey % 4) AS DOUBLE) AS height FROM (SELECT y, a AS n FROM kept UNION SELECT y, b FROM kept) JOIN nation ON n = n_nationkey),
edges AS (SELECT CAST(y AS VARCHAR) AS graph_id, lpad(CAST(a AS VARCHAR), 2, '0') || '>' || lpad(CAST(b AS VARCHAR), 2, '0') AS edge_id, lpad(CAST(a AS VARCHAR), 2, '0') AS source_id, lpad(CAST(b AS VARCHAR), 2, '0') AS target_id,
    row_number() OVER (PARTITION BY y ORDER BY a, b) - 1 AS ord, weight FROM kept)"""


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One containment tree: regions hold nations, nations hold customers and suppliers; parent-relative places."""
    def level(df: DataFrame, mark: str, key: str, up: str | None, parent: str | None, x, y) -> DataFrame:
        return df.select(
            F.lit("geo").alias("graph_id"),
            F.concat(F.lit(mark), F.col(key).cast("string")).alias("node_id"),
            F.concat(F.lit(up), F.col(parent).cast("string")).alias("parent_id") if parent else F.lit(None).cast("string").alias("parent_id"),
            x(F.col(key)).cast("double").alias("x"),
            y(F.col(key)).cast("double").alias("y"),
        )

    region = level(_read(spark, sf_dir, "region"), "R", "r_regionkey", None, None, lambda k: k * 1000, lambda k: k * 0)
    nation = level(_read(spark, sf_dir, "nation"), "N", "n_nationkey", "R", "n_regionkey", lambda k: k % 5 * 150, lambda k: k % 7 * 100)
    customer = level(_read(spark, sf_dir, "customer"), "C", "c_custkey", "N", "c_nationkey", lambda k: k % 20 * 10, lambda k: k % 50)
    supplier = level(_read(spark, sf_dir, "supplier"), "S", "s_suppkey", "N", "s_nationkey", lambda k: k % 20 * 10, lambda k: k % 50)
    return region.unionByName(nation).unionByName(customer).unionByName(supplier)


CONTAINMENT_SQL = """
geo AS (SELECT 'geo' AS graph_id, 'R' || r_regionkey AS node_id, CAST(NULL AS VARCHAR) AS parent_id, CAST(r_regionkey * 1000 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y FROM region
  UNION ALL SELECT 'geo', 'N' || n_nationkey, 'R' || n_regionkey, n_nationkey % 5 * 150, n_nationkey % 7 * 100 FROM nation
  UNION ALL SELECT 'geo', 'C' || c_custkey, 'N' || c_nationkey, c_custkey % 20 * 10, c_custkey % 50 FROM customer
  UNION ALL SELECT 'geo', 'S' || s_suppkey, 'N' || s_nationkey, s_suppkey % 20 * 10, s_suppkey % 50 FROM supplier)"""


def read_graph_json(spark: SparkSession, path: str, depth: int = 8) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of ``read_graph_tables``."""
    tables = read_graph_tables(spark, path, depth)
    return tables["nodes"], tables["edges"]


def read_graph_tables(spark: SparkSession, path: str, depth: int = 8) -> dict[str, DataFrame]:
    """Authored JSON trees (id, x, y, width, height, children, ports, labels, layoutOptions, edges with sources and
    targets), one document a file, flattened level by level.  ``depth``: levels read; a deeper tree raises an error.

    nodes and edges as everywhere; an edge between ports is one between their nodes, and one with several ends goes
    from the first source to the first target.  ``ends`` (graph_id, edge_id, role, k, node_id, port_id) has all of them;
    ``ports`` (graph_id, port_id, node_id, ord, x, y, width, height); ``labels`` (graph_id, owner, owner_id, k, text,
    width, height) and ``options`` (graph_id, owner, owner_id, name, value), whose owner is a graph, node, port or edge.
    """
    parts: dict[str, DataFrame] = {}

    def add(name: str, rows: DataFrame) -> None:
        parts[name] = parts[name].unionByName(rows, allowMissingColumns=True) if name in parts else rows

    text = lambda v, k: F.variant_get(v, f"$.{k}", "string")
    number = lambda v, k: F.coalesce(F.variant_get(v, f"$.{k}", "double"), F.lit(0.0)).alias(k)
    each = lambda v, k: F.posexplode(F.variant_get(v, f"$.{k}", "array<variant>"))

    def owned(rows: DataFrame, owner: str, v: str) -> None:
        """Labels and options of the entities in column ``v``."""
        l = rows.select("graph_id", F.lit(owner).alias("owner"), text(v, "id").alias("owner_id"), each(v, "labels").alias("k", "l"))
        add("labels", l.select("graph_id", "owner", "owner_id", "k", text("l", "text").alias("text"), number("l", "width"), number("l", "height")))
        options = F.explode(F.variant_get(v, "$.layoutOptions", "map<string,string>")).alias("name", "value")
        add("options", rows.select("graph_id", F.lit(owner).alias("owner"), text(v, "id").alias("owner_id"), options))

    roots = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    level = roots.select(text("v", "id").alias("graph_id"), F.lit(None).cast("string").alias("parent_id"), "v")
    owned(level, "graph", "v")
    for n in range(depth + 1):
        kids = level.select("graph_id", F.when(F.lit(n > 0), text("v", "id")).alias("parent_id"), each("v", "children").alias("ord", "v"))
        own = level.select("graph_id", each("v", "edges").alias("ord", "e"))
        add("edges", own.select("graph_id", text("e", "id").alias("edge_id"), "ord"))
        owned(own, "edge", "e")
        for role in ("source", "target"):
            ends = F.posexplode(F.variant_get("e", f"$.{role}s", "array<string>")).alias("k", "id")
            add("ends", own.select("graph_id", text("e", "id").alias("edge_id"), F.lit(role).alias("role"), ends))
        if n == depth:
            add("nodes", kids.select("graph_id", F.raise_error(F.lit(f"graph deeper than {depth} levels")).cast("string").alias("node_id")))
            break
        add("nodes", kids.select("graph_id", text("v", "id").alias("node_id"), "parent_id", "ord", *[number("v", k) for k in ("x", "y", "width", "height")]))
        owned(kids, "node", "v")
        ports = kids.select("graph_id", text("v", "id").alias("node_id"), each("v", "ports").alias("ord", "p"))
        add("ports", ports.select("graph_id", text("p", "id").alias("port_id"), "node_id", "ord", *[number("p", k) for k in ("x", "y", "width", "height")]))
        owned(ports, "port", "p")
        level = kids.select("graph_id", "parent_id", "v")
    at = parts["ports"].select("graph_id", F.col("port_id").alias("id"), F.col("node_id").alias("of"))
    ends = parts["ends"].join(at, ["graph_id", "id"], "left")
    parts["ends"] = ends.select("graph_id", "edge_id", "role", "k", F.coalesce("of", "id").alias("node_id"), F.when(F.col("of").isNotNull(), F.col("id")).alias("port_id"))
    first = parts["ends"].where("k = 0").groupBy("graph_id", "edge_id").agg(F.max(F.when(F.col("role") == "source", F.col("node_id"))).alias("source_id"), F.max(F.when(F.col("role") == "target", F.col("node_id"))).alias("target_id"))
    edges = parts["edges"].join(first, ["graph_id", "edge_id"], "left")
    parts["edges"] = edges.select("graph_id", "edge_id", "source_id", "target_id", "ord", F.lit(1).cast("long").alias("weight"))
    return parts
