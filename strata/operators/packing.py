"""Packers and fixed arrangements.  A row of a packed table is one graph; rows are folded in their authored order.

The fold of one graph's nodes runs inside one row (an ``aggregate`` over an ordered array), so a graph must fit a
task; graphs spread over the cluster by ``graph_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _in_order():
    return Window.partitionBy("graph_id").orderBy("ord")


PLACED = "array<struct<node_id:string,x:double,y:double,width:double,height:double>>"


def _shelves(ordered: Column, left: float, top: float, spacing: float, wraps) -> Column:
    """Left to right, a new row below where ``wraps(x, width)``; placed nodes in order."""
    start = F.struct(F.lit(left).alias("x"), F.lit(top).alias("y"), F.lit(0.0).alias("row"), F.array().cast(PLACED).alias("out"))

    def put(s: Column, n: Column) -> Column:
        wrap = wraps(s["x"], n["width"])
        x, y = F.when(wrap, F.lit(left)).otherwise(s["x"]), F.when(wrap, s["y"] + s["row"] + spacing).otherwise(s["y"])
        placed = F.struct(n["node_id"].alias("node_id"), x.alias("x"), y.alias("y"), n["width"].alias("width"), n["height"].alias("height"))
        return F.struct((x + n["width"] + spacing).alias("x"), y.alias("y"), F.greatest(F.when(wrap, 0.0).otherwise(s["row"]), n["height"]).alias("row"), F.concat(s["out"], F.array(placed)).alias("out"))

    return F.aggregate(ordered, start, put, lambda s: s["out"])


def _unpacked(df: DataFrame) -> DataFrame:
    return df.select("graph_id", F.inline("placed"))


def rectangle_packing(nodes: DataFrame, spacing: float = 20.0, padding: float = 0.0, target_width: float | None = None) -> DataFrame:
    """Shelves of a width that follows from the total area."""
    order = F.array_sort(F.collect_list(F.struct("ord", "node_id", "width", "height")))
    g = nodes.groupBy("graph_id").agg(order.alias("ns"), F.sum((F.col("width") + spacing) * (F.col("height") + spacing)).alias("area"))
    target = F.lit(target_width) if target_width else F.greatest(F.lit(1.0), F.sqrt("area") * 1.5)
    return _unpacked(g.select("graph_id", _shelves(F.col("ns"), padding, padding, spacing, lambda x, w: (x > padding) & (x + w > padding + target)).alias("placed")))


def box_packing(nodes: DataFrame, spacing: float = 15.0, padding: float = 15.0, aspect: float = 1.3, priority: str | None = None, interactive: bool = False, expand: bool = False) -> DataFrame:
    """Rows of boxes by area, width by total area, its spread and the aspect ratio (rounded to single precision).

    ``priority``: a column whose larger values come first; ``interactive``: authored places (y, then x) go before areas;
    ``expand``: boxes get the height of their row, the last of a row reaches as far as the broadest one.
    """
    aspect = F.lit(aspect).cast("float").cast("double")
    area = F.col("width") * F.col("height")
    first = [(-F.coalesce(F.col(priority), F.lit(0))).alias("p")] if priority else []
    order = F.array_sort(F.collect_list(F.struct(*first, *(["y", "x"] if interactive else []), area.alias("a"), "ord", "node_id", "width", "height")))
    g = nodes.groupBy("graph_id").agg(order.alias("ns"), F.sum(area).alias("total"), F.count("*").alias("n"), F.coalesce(F.stddev_samp(area), F.lit(0.0)).alias("sd"), F.max("width").alias("widest"))
    g = g.withColumn("t", F.col("total") + F.col("n") * F.col("sd"))
    g = g.withColumn("t", F.col("t") + F.sqrt("t") * (2 * padding))
    g = g.withColumn("t", F.col("t") + F.sqrt("t") * padding)
    most = F.greatest(F.col("widest"), F.sqrt(F.col("t") * aspect)) + padding
    placed = _unpacked(g.select("graph_id", _shelves(F.col("ns"), padding, padding, spacing, lambda x, w: x + w > most).alias("placed")))
    if not expand:
        return placed
    row, every = Window.partitionBy("graph_id", "y"), Window.partitionBy("graph_id")
    last = F.col("x") == F.max("x").over(row)
    return placed.select("graph_id", "node_id", "x", "y", F.when(last, F.max(F.col("x") + F.col("width")).over(every) - F.col("x")).otherwise(F.col("width")).alias("width"), F.max("height").over(row).alias("height"))


def relative_spread(nodes: DataFrame, compact: bool, spacing: float = 20.0, padding: float = 0.0) -> DataFrame:
    """Every node from the one before it: same direction, distance as required (compact) or at least as required."""
    def moved(c: str, size: str) -> Column:
        delta, need = F.col(c) - F.lag(c).over(_in_order()), F.lag(size).over(_in_order()) + spacing
        far = need if compact else F.greatest(F.abs(delta), need)
        return F.coalesce(F.signum(delta) * far, F.lit(padding))

    steps = nodes.select("graph_id", "node_id", "ord", "width", "height", moved("x", "width").alias("dx"), moved("y", "height").alias("dy"))
    upto = _in_order().rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("graph_id", "node_id", (F.sum("dx").over(upto) + 0.0).alias("x"), (F.sum("dy").over(upto) + 0.0).alias("y"), "width", "height")


def normalised(nodes: DataFrame, padding: float = 12.0) -> DataFrame:
    """Shifted so that the least x and y of a graph are ``padding``, with the graph's bounds."""
    all_of = Window.partitionBy("graph_id")
    x, y = F.col("x") - F.min("x").over(all_of) + padding, F.col("y") - F.min("y").over(all_of) + padding
    moved = nodes.select("graph_id", "node_id", x.alias("x"), y.alias("y"), "width", "height")
    return moved.withColumns({"bounds_width": F.max(F.col("x") + F.col("width")).over(all_of) + padding, "bounds_height": F.max(F.col("y") + F.col("height")).over(all_of) + padding})


LCG_MUL, LCG_ADD, LCG_MOD = 25214903917, 11, 1 << 48


def lcg_doubles(n: int | Column, seed: Column) -> Column:
    """The first n doubles in [0, 1) of the 48-bit linear congruential generator that Java specifies."""
    mod = F.lit(LCG_MOD).cast("decimal(38,0)")
    step = lambda s: ((s * F.lit(LCG_MUL).cast("decimal(12,0)") + LCG_ADD) % mod).cast("decimal(16,0)")
    start = F.struct(F.expr("0").cast("double").alias("d"), seed.bitwiseXOR(F.lit(LCG_MUL)).bitwiseAND(F.lit(LCG_MOD - 1)).cast("decimal(16,0)").alias("s"), F.array().cast("array<double>").alias("out"))

    def draw(a: Column, _: Column) -> Column:
        one = step(a["s"])
        two = step(one)
        high = F.floor(one / (1 << 22)).cast("long")
        low = F.floor(two / (1 << 21)).cast("long")
        d = (high * (1 << 27) + low).cast("double") * (1.0 / (1 << 53))
        return F.struct(d.alias("d"), two.alias("s"), F.concat(a["out"], F.array(d)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), (F.lit(n) if isinstance(n, int) else n).cast("int")), start, draw, lambda a: a["out"])


def random_places(nodes: DataFrame, edges: DataFrame, seed: Column, spacing: float = 15.0, aspect: float = 1.6, padding: float = 12.0) -> DataFrame:
    """Places from the generator of ``lcg_doubles``, two draws a node in authored order, in a drawing whose area is that
    of all nodes and a square of twice the spacing's for each node and edge; one row of draws is one graph."""
    area = nodes.groupBy("graph_id").agg(F.sum(F.col("width") * F.col("height")).alias("area"), F.count("*").alias("n"), F.max("width").alias("widest"), F.max("height").alias("highest"))
    area = area.join(edges.groupBy("graph_id").agg(F.count("*").alias("e")), "graph_id", "left")
    root = F.sqrt(F.col("area") + 2 * spacing * spacing * (1 + F.coalesce("e", F.lit(0))) * F.col("n"))
    size = area.select("graph_id", F.greatest(root * aspect, F.col("widest")).alias("w"), F.greatest(root / aspect, F.col("highest")).alias("h"), lcg_doubles(F.col("n") * 2, seed).alias("draws"))
    k = F.row_number().over(_in_order()) - 1
    n = nodes.withColumn("k", k).join(size, "graph_id")
    draw = lambda i: F.element_at("draws", (F.col("k") * 2 + i).cast("int"))
    return n.select("graph_id", "node_id", (padding + draw(1) * (F.col("w") - F.col("width"))).alias("x"), (padding + draw(2) * (F.col("h") - F.col("height"))).alias("y"), "width", "height")


def lcg_bits(n: int, seed: Column, bits: int) -> Column:
    """The first n draws of ``bits`` bits (32 at most) of the generator of ``lcg_doubles``, as longs of 0 or more.

    One bit is a boolean, 24 over 2^24 a float; 32 with the sign in the highest are an integer.
    """
    if not 1 <= bits <= 32:
        raise ValueError("bits must be 1 to 32")
    mod = F.lit(LCG_MOD).cast("decimal(38,0)")
    start = F.struct(seed.bitwiseXOR(F.lit(LCG_MUL)).bitwiseAND(F.lit(LCG_MOD - 1)).cast("decimal(16,0)").alias("s"), F.array().cast("array<bigint>").alias("out"))

    def draw(a: Column, _: Column) -> Column:
        s = ((a["s"] * F.lit(LCG_MUL).cast("decimal(12,0)") + LCG_ADD) % mod).cast("decimal(16,0)")
        return F.struct(s.alias("s"), F.concat(a["out"], F.array(F.shiftright(s.cast("long"), 48 - bits))).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, draw, lambda a: a["out"])
