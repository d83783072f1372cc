"""Entity resolution inside blocks of one licence, and canonical attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import similarity as s
from sievewright.functions.coerce import col, half_even, stripped
from sievewright.functions.text import normalized_name
from sievewright.operators.modes import group_mode
from sievewright.roles import Roles
from sievewright.storage import write_table


def union_keys(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """(the six key columns, cnt, total_records, diff_info_cnt, node): each different key of a licence once.

    cnt: its rows; total_records: those of the licence; diff_info_cnt: keys of the licence; node: its place in the
    licence, by cnt falling, then by the key. Rows with a null in any key column are left out.
    """
    some = df.where(reduce(lambda a, b: a & b, (col(k).isNotNull() for k in roles.key)))
    keys = some.groupBy(*[col(k) for k in roles.key]).agg(F.count("*").alias("cnt"))
    block = Window.partitionBy(col(roles.license))
    order = block.orderBy(F.col("cnt").desc(), *[col(k) for k in roles.key])
    return keys.withColumns({"total_records": F.sum("cnt").over(block), "diff_info_cnt": F.count("*").over(block), "node": (F.row_number().over(order) - 1).cast("int")})


def pair_scores(keys: DataFrame, roles: Roles = Roles(), threshold: float | None = None) -> DataFrame:
    """(licence, i, j, sim_name, sim_zip, sim_geo, sim_facility, score) for each two nodes i < j of a licence.

    With a threshold, pairs that can't reach it, whatever their names, are left out before names are compared; names
    are compared once for each different pair of them.
    """
    many = keys.where("diff_info_cnt > 1").select(col(roles.license).alias("block"), "node", normalized_name(col(roles.name)).alias("name"), *[col(x).alias(y) for x, y in ((roles.zip, "zip"), (roles.lat, "lat"), (roles.lon, "lon"), (roles.category, "category"))])
    a, b = many.alias("a"), many.alias("b")
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.node") < F.col("b.node"))).select(
        F.col("a.block").alias("block"), F.col("a.node").alias("i"), F.col("b.node").alias("j"), F.col("a.name").alias("name_i"), F.col("b.name").alias("name_j"),
        s.same_code(F.col("a.zip"), F.col("b.zip")).alias("sim_zip"), s.place_similarity(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("sim_geo"), s.same_category(F.col("a.category"), F.col("b.category")).alias("sim_facility"),
    )
    if threshold is not None:
        x, y = F.length("name_i"), F.length("name_j")
        most = F.when((x > 0) & (y > 0), 2.0 * F.least(x, y) / (x + y)).otherwise(0.0)
        pairs = pairs.where(s.score(most, F.col("sim_zip"), F.col("sim_geo"), F.col("sim_facility")) + 0.003 >= threshold)
    names = pairs.select("name_i", "name_j").distinct().withColumn("sim_name", s.name_ratio("name_i", "name_j"))
    out = pairs.join(names, ["name_i", "name_j"]).withColumn("score", s.score(F.col("sim_name"), F.col("sim_zip"), F.col("sim_geo"), F.col("sim_facility")))
    out = out if threshold is None else out.where(F.col("score") >= threshold)
    return out.select(F.col("block").alias(roles.license), "i", "j", "sim_name", "sim_zip", "sim_geo", "sim_facility", "score")


def links(keys: DataFrame, roles: Roles = Roles(), threshold: float = s.THRESHOLD) -> DataFrame:
    """(licence, i, j): few pairs of nodes that connect the same nodes as all pairs that reach the threshold do.

    Equal names reach it alone and no pair does without names, so a licence's nodes fall into classes of equal names:
    each class is a star from its first node, and two classes are linked, by their first nodes, if any pair between them
    reaches it. Names are compared once for two classes, nodes only where the names leave it open. Licences are shuffled
    once.
    """
    if not sum(s.WEIGHTS[1:]) + 0.003 < threshold <= s.WEIGHTS[0]:
        return pair_scores(keys, roles, threshold).select(roles.license, "i", "j")
    node = F.struct("node", F.col("zip").cast("string").alias("zip"), "lat", "lon", "category")
    many = keys.where("diff_info_cnt > 1").select(col(roles.license).alias("block"), "node", normalized_name(col(roles.name)).alias("name"), F.lower(stripped(col(roles.category))).alias("category"), *[col(x).alias(y) for x, y in ((roles.zip, "zip"), (roles.lat, "lat"), (roles.lon, "lon"))])
    classes = many.where("name != ''").repartition("block").groupBy("block", "name").agg(F.min("node").alias("first"), F.collect_list(node).alias("nodes"))
    blocks = classes.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("first", "name", "nodes"))).alias("c")).withColumn("ratios", s.ratio_list(F.col("c.name")))
    both = blocks.select("block", "ratios", "c", F.posexplode("c").alias("p", "a")).select("block", "ratios", F.size("c").alias("n"), "p", "a", F.posexplode("c").alias("q", "b")).where("p <= q")
    ratio = F.when(F.col("p") < F.col("q"), F.expr("ratios[cast(p * (2 * n - p - 1) / 2 as int) + q - p - 1]")).otherwise(1.0)
    both = both.select("block", "p", "q", ratio.alias("ratio"), F.col("a.first").alias("i"), F.col("b.first").alias("k"), F.col("a.nodes").alias("a"), F.col("b.nodes").alias("b"))
    name, rest = s.WEIGHTS[0] * F.col("ratio"), sum(s.WEIGHTS[1:]) + 0.003
    both = both.where(name + rest >= threshold).select("block", "p", "q", "ratio", "i", "k", "b", F.explode("a").alias("x"))
    both = both.select("block", "p", "q", "ratio", "i", "k", "x", F.explode("b").alias("y"))
    firsts = (F.col("x.node") == F.col("i")) & (F.col("y.node") == F.col("k"))
    star = (F.col("p") == F.col("q")) & (F.col("x.node") == F.col("i")) & (F.col("y.node") != F.col("i"))
    pairs = both.where(star | ((F.col("p") < F.col("q")) & (firsts | (name < threshold))))
    far = s.haversine(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon"))
    pairs = pairs.select("block", "ratio", "i", F.when(F.col("p") < F.col("q"), F.col("k")).otherwise(F.col("y.node")).alias("j"), "x", "y", far.alias("far"))
    score = s.score(F.col("ratio"), s.same_code(F.col("x.zip"), F.col("y.zip")), s.nearness(F.col("far")), s.same_text(F.col("x.category"), F.col("y.category")))
    return pairs.groupBy("block", "i", "j").agg(F.max(score).alias("score")).where(F.col("score") >= threshold).select(F.col("block").alias(roles.license), "i", "j")


_QUICK_FIND = """aggregate(edges, sequence(0, n - 1), (label, e) -> transform(label, l ->
    if(l = greatest(label[e.i], label[e.j]), least(label[e.i], label[e.j]), l)))"""


def clusters(keys: DataFrame, edges: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """(licence, node, component, seq): connected components of each licence of more than one key.

    component: the smallest node; seq: 1 for the largest, of equals the one with the smallest node. Joining the
    labels of each edge in turn gives the components in one pass over a licence's edges.
    """
    blocks = keys.where("diff_info_cnt > 1").groupBy(col(roles.license)).agg(F.count("*").cast("int").alias("n"))
    lists = edges.groupBy(col(roles.license)).agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("edges"))
    labels = blocks.join(lists, roles.license, "left").withColumn("edges", F.coalesce("edges", F.expr("cast(array() as array<struct<i:int,j:int>>)")))
    nodes = labels.select(col(roles.license), F.posexplode(F.expr(_QUICK_FIND)).alias("node", "component"))
    block = Window.partitionBy(col(roles.license))
    sized = nodes.withColumn("size", F.count("*").over(Window.partitionBy(col(roles.license), "component")))
    return sized.withColumn("seq", F.dense_rank().over(block.orderBy(F.col("size").desc(), "component"))).select(col(roles.license), "node", F.col("component").cast("int").alias("component"), "seq")


def entity_keys(df: DataFrame, threshold: float = s.THRESHOLD, roles: Roles = Roles()) -> DataFrame:
    """union_keys() with an entity id: licence_seq, or licence_0 where a licence has one key only."""
    keys = write_table(union_keys(df, roles), "keys")  # read by the links, the clusters and the result
    found = clusters(keys, links(keys, roles, threshold), roles)
    number = F.concat_ws("_", col(roles.license).cast("bigint").cast("string"), F.coalesce("seq", F.lit(0)).cast("string"))
    wide = keys.join(found.select(roles.license, "node", "seq"), [roles.license, "node"], "left")
    return wide.select(*[col(k) for k in roles.key], "cnt", "total_records", "diff_info_cnt", "node", number.alias(roles.entity))


def canonical(keys: DataFrame, roles: Roles = Roles(), suffix: str = "_std") -> DataFrame:
    """keys with <column>_std: the values of the entity's most frequent key, of equals its first node."""
    best = Window.partitionBy(col(roles.entity)).orderBy(F.col("cnt").desc(), col(roles.license), "node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return keys.withColumns({f"{x}{suffix}": F.first(col(x)).over(best) for x in roles.standard})


def unify_zip(df: DataFrame, lon: str, lat: str, zip_col: str, digits: int = 6, cut: bool = False) -> DataFrame:
    """Coordinates rounded, and one zip for each spot: the most frequent, of equals the least.

    cut: the rows, which the spots are made from and joined to, and the spots are written to the shared folder."""
    rounded = df.withColumns({x: half_even(col(x), digits) for x in (lon, lat)})
    rounded = write_table(rounded, "rounded") if cut else rounded
    modes = group_mode(rounded, [lon, lat], [zip_col], tie="smallest").select(col(lon), col(lat), col(zip_col).alias("__zip"))
    modes = write_table(modes, "spots") if cut else modes
    return rounded.join(modes, [lon, lat], "left").withColumn(zip_col, F.coalesce("__zip", col(zip_col))).select(*[col(x) for x in df.columns])


def resolve(df: DataFrame, threshold: float = s.THRESHOLD, roles: Roles = Roles()) -> DataFrame:
    """All of the above: entity keys with canonical attributes and unified zips."""
    keys = canonical(entity_keys(df, threshold, roles), roles)
    return unify_zip(keys, f"{roles.lon}_std", f"{roles.lat}_std", f"{roles.zip}_std", cut=True)
