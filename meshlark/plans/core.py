"""Registered queries: filters, adjacency, sets, aggregates, order, edits, partitions and spatial joins.

``Q`` has the queries and ``SQL`` the same in SQL, under one name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjacency, aggregate, dml, mesh, ordered, partition, sets, spatial
from . import tables as t

Q, SQL = {}, {}


def query(sql: str | None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


INC = "(SELECT DISTINCT l_orderkey AS id, l_partkey AS vid FROM lineitem)"
ORDERS = "SELECT o_orderkey AS id FROM orders"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "orders").select(F.lit(4).cast("tinyint").alias("etype"), F.col("o_orderkey").alias("id"))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "documents").select(F.lit(0).cast("tinyint").alias("etype"), F.col("doc_id").alias("id"))


# --- filters -------------------------------------------------------------


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def tag_filter_intersect(spark, sf):
    orders = _orders(spark, sf)
    has = t.incidence(spark, sf).select("etype", "id").distinct().withColumn("value", F.lit(1))
    preds = [{"tag": t.tag(spark, sf, "orders", "o_orderkey", "o_orderstatus"), "value": "F"}, {"tag": t.tag(spark, sf, "orders", "o_orderkey", "o_orderpriority"), "value": "1-URGENT"}, {"tag": has}]
    return mesh.tag_filter(orders, preds, "intersect").select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'")
def tag_filter_union(spark, sf):
    preds = [{"tag": t.tag(spark, sf, "orders", "o_orderkey", "o_orderstatus"), "value": "P"}, {"tag": t.tag(spark, sf, "orders", "o_orderkey", "o_orderpriority"), "value": "5-LOW"}]
    return mesh.tag_filter(_orders(spark, sf), preds, "union").select("id")


@query("SELECT DISTINCT doc_id AS id FROM documents d WHERE coalesce((SELECT min(quality) FROM labels l WHERE l.doc_id = d.doc_id), 1) = 1")
def tag_filter_default(spark, sf):
    tag = t.table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("value")).select(F.lit(0).cast("tinyint").alias("etype"), F.col("doc_id").alias("id"), "value")
    return mesh.tag_filter(_docs(spark, sf), [{"tag": tag, "value": 1, "default": 1}]).select("id")


@query("SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def has_tag_semi(spark, sf):
    tag = t.tag(spark, sf, "labels", "doc_id", "toxic", 0)
    return mesh.tag_filter(_docs(spark, sf), [{"tag": tag}]).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def tag_filter_within(spark, sf):
    big = t.table(spark, sf, "orders").where("o_totalprice > 200000").select(F.lit(4).cast("tinyint").alias("etype"), F.col("o_orderkey").alias("id"))
    return mesh.tag_filter(_orders(spark, sf), [{"tag": t.tag(spark, sf, "orders", "o_orderkey", "o_orderstatus"), "value": "O"}], "intersect", big).select("id")


@query("SELECT DISTINCT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS line FROM lineitem WHERE (l_linenumber & 5) = 5")
def bit_tag_search(spark, sf):
    tag = t.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("etype"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("value"))
    return mesh.bits_equal(tag, 5, 5).select("id", F.col("etype").cast("bigint").alias("line")).distinct()


@query("SELECT doc_id AS id, count(*) AS n, count_if(quality IS NULL) AS missing, CAST(sum(coalesce(quality, -1)) AS BIGINT) AS total FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id")
def tag_values_default(spark, sf):
    tag = t.tag(spark, sf, "labels", "doc_id", "quality", 0)
    v = mesh.tag_values(_docs(spark, sf), tag, -1)
    return v.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("value") == -1).alias("missing"), F.sum("value").alias("total"))


@query("SELECT asked AS sid, bool_and(asked = o_custkey) AS held FROM (SELECT o_custkey, o_custkey + CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 1 ELSE 0 END AS asked FROM orders) GROUP BY asked")
def set_contains_all(spark, sf):
    """Every customer's set is asked for its orders, but urgent pending ones are asked of the next customer's."""
    o, odd = t.table(spark, sf, "orders"), (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    wanted = o.select((F.col("o_custkey") + F.lit(t.CUSTOMER) + F.when(odd, 1).otherwise(0)).alias("sid"), F.lit(4).cast("tinyint").alias("etype"), F.col("o_orderkey").alias("id"))
    return mesh.contains_each(t.set_members(spark, sf), wanted).select((F.col("sid") - F.lit(t.CUSTOMER)).alias("sid"), "held")


@query("SELECT o_orderkey AS id FROM orders WHERE (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END & 2) = 2 AND (CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 5 ELSE 3 END & 4) <> 0")
def status_mask_filter(spark, sf):
    p = F.col("o_orderpriority")
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("status"), F.when(p == "1-URGENT", 4).when(p == "2-HIGH", 5).otherwise(3).alias("rush"))
    return mesh.status_filter(mesh.status_filter(o, "status", 2, "and"), "rush", 4, "or").select("id")


@query("SELECT l_orderkey AS id, CAST(round(avg(x), 6) AS DOUBLE) AS x, CAST(round(avg(y), 4) AS DOUBLE) AS y FROM lineitem JOIN (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part) ON l_partkey = p_partkey GROUP BY l_orderkey")
def avg_position(spark, sf):
    m = mesh.Mesh.build(t.vertices(spark, sf).withColumn("z", F.lit(0.0)), t.elements(spark, sf))
    return m.coordinates().where("etype = 4").select("id", F.round("x", 6).alias("x"), F.round("y", 4).alias("y"))


# --- adjacency -----------------------------------------------------------


@query(f"SELECT DISTINCT id FROM {INC} WHERE vid IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def adj_union(spark, sf):
    v = t.table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("vid"))
    return adjacency.up(t.incidence(spark, sf), v, "union").select("id")


@query(f"""WITH inc AS {INC}, two AS (SELECT id AS q, vid FROM (SELECT id, vid, row_number() OVER (PARTITION BY id ORDER BY vid) AS r, count(*) OVER (PARTITION BY id) AS n FROM inc) WHERE r <= 2 AND n > 1)
SELECT q, b.id FROM two JOIN inc b USING (vid) GROUP BY q, b.id HAVING count(*) = 2""")
def adj_intersect(spark, sf):
    """For every element's first two vertices, the elements that have both."""
    inc = t.incidence(spark, sf)
    two = inc.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("vid")), 1, 2).alias("v")).where(F.size("v") == 2).select(F.col("id").alias("q"), F.explode("v").alias("vid"))
    return adjacency.up_each(inc, two).select("q", "id")


@query(f"SELECT a.id, b.id AS super FROM (SELECT id, list(vid ORDER BY vid) AS v FROM {INC} GROUP BY id HAVING count(*) = 2) a JOIN (SELECT id, list(vid ORDER BY vid) AS v FROM {INC} GROUP BY id HAVING count(*) > 2) b ON list_has_all(b.v, a.v)")
def adj_up_division(spark, sf):
    """Elements whose vertex list has all vertices of a two-vertex element (relational division)."""
    inc = t.incidence(spark, sf)
    n = inc.groupBy("etype", "id").agg(F.count("*").alias("n"))
    small = inc.join(n.where("n = 2"), ["etype", "id"], "left_semi").select(F.col("id").alias("q"), "vid")
    return adjacency.up_each(inc.join(n.where("n > 2"), ["etype", "id"], "left_semi"), small).select(F.col("q").alias("id"), F.col("id").alias("super"))


@query("""WITH item AS (SELECT l_orderkey AS id, l_partkey AS a, row_number() OVER w - 1 AS side, coalesce(lead(l_partkey) OVER w, first_value(l_partkey) OVER w) AS b
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)),
edge AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi FROM item WHERE a <> b),
sib AS (SELECT *, count(*) OVER (PARTITION BY lo, hi) AS n, coalesce(lead(id) OVER s, first_value(id) OVER s) AS i, coalesce(lead(side) OVER s, first_value(side) OVER s) AS j FROM edge WINDOW s AS (PARTITION BY lo, hi ORDER BY id, side))
SELECT id, CAST(side AS INTEGER) AS side, a, b, CASE WHEN n > 1 THEN i END AS sib_id, CAST(CASE WHEN n > 1 THEN j END AS INTEGER) AS sib_side FROM sib""")
def half_facets(spark, sf):
    return adjacency.half_facets(t.elements(spark, sf)).drop("etype")


@query(f"SELECT DISTINCT b.vid FROM {INC} a JOIN {INC} b USING (id) WHERE a.vid IN (SELECT p_partkey FROM part WHERE p_size = 31)")
def adj_down_union(spark, sf):
    inc = t.incidence(spark, sf)
    v = t.table(spark, sf, "part").where("p_size = 31").select(F.col("p_partkey").alias("vid"))
    return adjacency.down(inc, adjacency.up(inc, v, "union"))


@query(f"SELECT DISTINCT vid FROM {INC} WHERE id IN (SELECT id FROM {INC} GROUP BY id HAVING count(*) = 1)")
def adj_down_single(spark, sf):
    """Vertices of the elements on one vertex."""
    inc = t.incidence(spark, sf)
    return adjacency.down(inc, inc.groupBy("etype", "id").count().where("count = 1"), "union")


@query(f"""WITH inc AS {INC}, start AS (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
SELECT DISTINCT b.id FROM (SELECT DISTINCT vid FROM inc JOIN start USING (id)) v JOIN inc b USING (vid) WHERE b.id NOT IN (SELECT id FROM start)""")
def bridge_adjacency(spark, sf):
    dear = t.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 400000")
    return adjacency.bridge(t.incidence(spark, sf), dear.select(F.lit(4).cast("tinyint").alias("etype"), F.col("o_orderkey").alias("id")), 1, keep_start=False).select("id")


@query(f"""WITH inc AS {INC}, l0 AS (SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 499000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)), l1 AS (SELECT DISTINCT b.id FROM inc a JOIN l0 USING (id) JOIN inc b ON a.vid = b.vid WHERE b.id NOT IN (SELECT id FROM l0)),
l2 AS (SELECT DISTINCT b.id FROM inc a JOIN l1 USING (id) JOIN inc b ON a.vid = b.vid WHERE b.id NOT IN (SELECT id FROM l0) AND b.id NOT IN (SELECT id FROM l1))
SELECT id, 0 AS layer FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2""")
def second_adjacency_layers(spark, sf):
    inc = t.incidence(spark, sf)
    dear = t.table(spark, sf, "orders").where("o_totalprice > 499000").select(F.col("o_orderkey").alias("id"))
    return adjacency.bridge(inc, inc.join(dear, "id", "left_semi"), 2).select("id", "layer")


@query(f"SELECT vid, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM {INC} GROUP BY vid")
def inverted_index(spark, sf):
    return adjacency.vertex_index(t.incidence(spark, sf))


# vertices repeated at a polygon's end are padding
_LINE = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity"
_RING = f"""line AS (SELECT l_orderkey AS id, l_partkey AS v, row_number() OVER ({_LINE}) AS r, lag(l_partkey) OVER ({_LINE}) AS was,
 min(l_partkey) OVER ({_LINE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lo, max(l_partkey) OVER ({_LINE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM lineitem),
ring AS (SELECT id, r, v, lead(v) OVER w AS nxt, first_value(v) OVER w AS fst FROM line WHERE was IS NULL OR was <> v OR lo <> hi WINDOW w AS (PARTITION BY id ORDER BY r)),
edge AS (SELECT id, v AS a, coalesce(nxt, fst) AS b FROM ring), key AS (SELECT id, least(a, b) AS lo, greatest(a, b) AS hi FROM edge)"""


@query(f"WITH {_RING} SELECT lo, hi, min(id) AS id FROM key GROUP BY lo, hi HAVING count(*) = 1")
def skin_edges_once(spark, sf):
    """Edges that exactly one element has; an order's parts in line order are a polygon."""
    return adjacency.skin(t.elements(spark, sf), 1).select(F.col("key")[0].alias("lo"), F.col("key")[1].alias("hi"), "id")


@query(f"WITH {_RING} SELECT k, count(*) AS n FROM (SELECT count(*) AS k FROM key GROUP BY lo, hi) GROUP BY k")
def edge_classes(spark, sf):
    """How many edges are used once, twice, ...: boundary, manifold and non-manifold."""
    return adjacency.side_uses(t.elements(spark, sf), 1).select(F.col("n").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


# --- sets ----------------------------------------------------------------

_A = "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'"
_B = "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 250000"


def _ab(spark, sf):  # noqa: ANN001, ANN202
    o = t.table(spark, sf, "orders").select(F.lit(4).cast("tinyint").alias("etype"), F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")
    return o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 250000")


@query(f"{_A} UNION {_B}")
def set_unite(spark, sf):
    return sets.unite(*_ab(spark, sf)).select("id")


@query(f"{_A} INTERSECT {_B}")
def set_intersect(spark, sf):
    return sets.intersect(*_ab(spark, sf)).select("id")


@query(f"{_A} EXCEPT {_B}")
def set_subtract(spark, sf):
    return sets.subtract(*_ab(spark, sf)).select("id")


@query("SELECT sid, min(sid) OVER (PARTITION BY ids) AS same_as FROM (SELECT l_partkey AS sid, list(DISTINCT l_orderkey ORDER BY l_orderkey) AS ids FROM lineitem WHERE l_quantity >= 49 GROUP BY l_partkey)")
def set_equal(spark, sf):
    """Of each part's set of large orders the smallest set with the same contents."""
    return sets.equal_sets(t.table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("sid"), F.lit(4).cast("tinyint").alias("etype"), F.col("l_orderkey").alias("id")))


@query("SELECT r_regionkey AS region, o_orderkey AS id FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey")
def contents_recursive(spark, sf):
    sids = t.table(spark, sf, "region").select((F.col("r_regionkey") + F.lit(t.REGION)).alias("sid"))
    return sets.contents(t.set_members(spark, sf), sids, recursive=True).select((F.col("sid") - t.REGION).cast("int").alias("region"), "id")


@query(f"""WITH RECURSIVE link AS (SELECT n_regionkey + {t.REGION} AS parent, n_nationkey + {t.NATION} AS child FROM nation UNION ALL SELECT c_nationkey + {t.NATION}, c_custkey + {t.CUSTOMER} FROM customer),
walk AS (SELECT parent AS sid, child, 1 AS hop FROM link WHERE parent < {t.NATION} UNION ALL SELECT sid, link.child, hop + 1 FROM walk JOIN link ON walk.child = link.parent WHERE hop < 2)
SELECT sid, child, hop FROM walk""")
def children_n_hops(spark, sf):
    start = t.table(spark, sf, "region").select((F.col("r_regionkey") + F.lit(t.REGION)).alias("sid"))
    return sets.children(t.links(spark, sf), start, 2)


@query(f"SELECT o_orderkey AS sid, CASE h WHEN 1 THEN o_custkey + {t.CUSTOMER} WHEN 2 THEN c_nationkey + {t.NATION} ELSE n_regionkey + {t.REGION} END AS parent, h AS hop FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey, (SELECT unnest([1, 2, 3]) AS h) WHERE o_orderstatus = 'P'")
def parents_all_hops(spark, sf):
    start = t.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("sid"))
    return sets.parents(t.links(spark, sf), start, 3)


@query(f"SELECT o_orderkey AS id, o_custkey + {t.CUSTOMER} AS sid FROM orders WHERE o_totalprice < 20000")
def owning_sets(spark, sf):
    e = t.table(spark, sf, "orders").where("o_totalprice < 20000").select(F.lit(4).cast("tinyint").alias("etype"), F.col("o_orderkey").alias("id"))
    return sets.owners(t.set_members(spark, sf), e).select("id", "sid")


@query("SELECT o_orderkey AS key, o_orderkey - (o_orderkey // 1000) * 1000 + 5000000 + (o_orderkey // 1000) * 2000 AS value FROM orders")
def range_map_lookup(spark, sf):
    """Ids looked up in intervals of a thousand, each mapped elsewhere."""
    keys = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    ranges = keys.select(F.floor(F.col("key") / 1000).alias("k")).distinct().select((F.col("k") * 1000).alias("start"), F.lit(1000).alias("count"), (F.lit(5_000_000) + F.col("k") * 2000).alias("value"))
    return sets.range_lookup(ranges, keys)


# --- aggregates ----------------------------------------------------------


@query("SELECT 'element' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'vertex', count(*) FROM part UNION ALL SELECT 'set', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer)")
def count_by_type(spark, sf):
    kinds = {"vertex": ["part"], "element": ["orders"], "set": ["region", "nation", "customer"]}
    out = None
    for kind, names in kinds.items():
        for n in names:
            part = t.table(spark, sf, n).select(F.lit(kind).alias("kind"))
            out = part if out is None else out.unionByName(part)
    return aggregate.counts(out, ["kind"]).withColumnRenamed("count", "n")


_STATS = "count({v}) AS n, round(sum({v}), 2) AS total, min({v}) AS least, round(avg({v}), 4) AS mean, round(sqrt(avg({v} * {v})), 4) AS rms, max({v}) AS greatest, round(stddev_pop({v}), 4) AS deviation"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("total", F.round("total", 2)).withColumns({c: F.round(c, 4) for c in ("mean", "rms", "deviation")})


@query(f"SELECT o_orderstatus AS kind, {_STATS.format(v='o_totalprice')} FROM orders GROUP BY o_orderstatus")
def mesh_stats_rms(spark, sf):
    return _rounded(aggregate.stats(t.table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "kind"), ["kind"], "o_totalprice"))


@query("SELECT p_brand AS block, count_if(p_type = 'ECONOMY') AS ECONOMY, count_if(p_type = 'STANDARD') AS STANDARD, count_if(p_type = 'PROMO') AS PROMO FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO') GROUP BY p_brand")
def counts_by_tag(spark, sf):
    kinds = ["ECONOMY", "STANDARD", "PROMO"]
    p = t.table(spark, sf, "part").where(F.col("p_type").isin(kinds)).select(F.col("p_brand").alias("block"), "p_type")
    return aggregate.counts(p, ["block"], "p_type", kinds)


def _copies(spark, sf):  # noqa: ANN001, ANN202
    return t.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("value"), (F.col("l_linenumber") - 4).alias("signed"), "l_quantity")


_REDUCED = {
    "sum": ("sum(CAST(l_linenumber AS BIGINT))", "value"),
    "max": ("max(l_linenumber)", "value"),
    "min": ("min(l_linenumber)", "value"),
    "land": ("min(CASE WHEN l_linenumber <> 4 THEN 1 ELSE 0 END)", "signed"),
    "lor": ("max(CASE WHEN l_linenumber <> 4 THEN 1 ELSE 0 END)", "signed"),
    "lxor": ("sum(CASE WHEN l_linenumber <> 4 THEN 1 ELSE 0 END) % 2", "signed"),
}


def _reduction(op: str, expr: str, col: str):  # noqa: ANN202
    def run(spark, sf):  # noqa: ANN001, ANN202
        return aggregate.reduce_tags(_copies(spark, sf), op, ["id"], col).select("id", F.col(col).cast("bigint").alias("value"))

    run.__name__ = f"tag_reduce_{op}"
    return query(f"SELECT l_partkey AS id, CAST({expr} AS BIGINT) AS value FROM lineitem GROUP BY l_partkey")(run)


for _op, (_expr, _col) in _REDUCED.items():
    _reduction(_op, _expr, _col)


@query("SELECT l_orderkey AS id, round(product(l_linenumber - 4), 3) + 0.0 AS value FROM lineitem GROUP BY l_orderkey")
def tag_reduce_prod(spark, sf):
    c = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 4).alias("value"))
    return aggregate.reduce_tags(c, "prod", ["id"]).select("id", (F.round("value", 3) + 0.0).alias("value"))


@query("SELECT l_partkey AS id, l_suppkey AS part_id, arg_min(l_quantity, l_suppkey) OVER (PARTITION BY l_partkey) AS value FROM (SELECT l_partkey, l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_partkey, l_suppkey)")
def exchange_owner_tags(spark, sf):
    c = t.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("part_id")).agg(F.max("l_quantity").alias("value"))
    return aggregate.exchange_tags(c, ["id"])


@query("SELECT n_name AS block, round(sum(o_totalprice), 2) AS integral, round(1e9 / sum(o_totalprice), 6) AS factor FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def norm_subset(spark, sf):
    o, c, n = (t.table(spark, sf, x) for x in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).withColumnRenamed("n_name", "block")
    return aggregate.group_integral(j, ["block"], "o_totalprice").select("block", F.round("integral", 2).alias("integral"), F.round(F.col("factor") * 1e9, 6).alias("factor"))


@query("SELECT DISTINCT p_brand, p_type, p_size FROM part")
def distinct_tuples(spark, sf):
    return aggregate.distinct_tuples(t.table(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


@query("SELECT label AS block, round(min(embedding[1])::DOUBLE, 6) AS xmin, round(max(embedding[1])::DOUBLE, 6) AS xmax, round(min(embedding[2])::DOUBLE, 6) AS ymin, round(max(embedding[2])::DOUBLE, 6) AS ymax, round(min(embedding[3])::DOUBLE, 6) AS zmin, round(max(embedding[3])::DOUBLE, 6) AS zmax FROM embeddings GROUP BY label")
def bbox_by_block(spark, sf):
    b = aggregate.bounding_box(t.points(spark, sf).withColumnRenamed("label", "block"), ["block"])
    return b.select("block", *[F.round(c, 6).alias(c) for c in b.columns if c != "block"])


@query("SELECT label, 'x' AS metric, round(min(embedding[1])::DOUBLE, 6) AS least, round(max(embedding[1])::DOUBLE, 6) AS greatest FROM embeddings GROUP BY label UNION ALL SELECT label, 'y', round(min(embedding[2])::DOUBLE, 6), round(max(embedding[2])::DOUBLE, 6) FROM embeddings GROUP BY label")
def metric_min_max(spark, sf):
    m = aggregate.metric_range(t.points(spark, sf), ["label"], ["x", "y"])
    return m.select("label", "metric", F.round("least", 6).alias("least"), F.round("greatest", 6).alias("greatest"))


# --- order ---------------------------------------------------------------


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS gid FROM orders")
def global_ids(spark, sf):
    return ordered.dense_ids(t.table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("id")), ["o_custkey", "id"]).select("id", "gid")


@query("SELECT o_orderkey AS id, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS part FROM orders")
def part_slices_ntile(spark, sf):
    return ordered.slices(t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), ["id"], 7)


@query("WITH d AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT id, id - row_number() OVER (ORDER BY id) AS k FROM d) SELECT min(id) AS first, max(id) AS last FROM g GROUP BY k")
def range_runs(spark, sf):
    return ordered.runs(t.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")), cell=1000)


@query("WITH k AS (SELECT o_orderkey AS old, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS r FROM orders WHERE o_custkey <> 7), i AS (SELECT o_orderkey AS new, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE o_custkey <> 7) SELECT old, new FROM k JOIN i USING (r)")
def reorder_by_tag(spark, sf):
    e = t.table(spark, sf, "orders").select(F.lit(4).cast("tinyint").alias("etype"), F.col("o_orderkey").alias("id"), "o_custkey")
    return ordered.permutation(e, "o_custkey", 7).select("old", "new")


@query("SELECT o_custkey, o_orderkey AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def top_hits(spark, sf):
    o = t.table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), (-F.col("o_totalprice")).alias("dist"))
    return sets.first_of(o, ["o_custkey"], ["dist", "id"], 2).select("o_custkey", "id", "rank")


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, user_id, arg_max(value, (ts, event_id)) OVER (PARTITION BY date_trunc('day', ts), user_id) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-05'")
def timestep_select(spark, sf):
    """Time steps of a variable: the last value of each entity on each day of a range."""
    e = t.table(spark, sf, "events").where("ts >= '2024-01-02' AND ts < '2024-01-05'")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


# --- edits ---------------------------------------------------------------


@query("SELECT p_partkey AS old, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS new FROM part QUALIFY old <> new")
def merge_integer_tag(spark, sf):
    tag = t.table(spark, sf, "part").select(F.lit(0).cast("tinyint").alias("etype"), F.col("p_partkey").alias("id"), F.concat_ws("|", "p_brand", "p_size").alias("value"))
    return dml.merge_by_value(tag).select("old", "new")


@query("SELECT l_orderkey AS id, list(m ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)::VARCHAR AS conn FROM lineitem JOIN (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS m FROM part) ON l_partkey = p_partkey GROUP BY l_orderkey")
def merge_rewrite(spark, sf):
    """Connectivity after the merge by tag."""
    m = merge_integer_tag(spark, sf)
    return ordered.rewrite(t.elements(spark, sf), m).select("id", F.concat(F.lit("["), F.array_join(F.transform("conn", lambda v: v.cast("string")), ", "), F.lit("]")).alias("conn"))


@query(f"SELECT count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT id FROM {INC} WHERE vid IN (SELECT p_partkey FROM part WHERE p_size > 45)) AND o_orderkey IN (SELECT id FROM {INC})")
def delete_cascade(spark, sf):
    """Elements that are left when vertices go."""
    m = mesh.Mesh.build(t.vertices(spark, sf), t.elements(spark, sf))
    v = t.table(spark, sf, "part").where("p_size > 45").select(F.lit(0).cast("tinyint").alias("etype"), F.col("p_partkey").alias("id"))
    return dml.delete(m, v).element.agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice * 2 ELSE o_totalprice END AS value FROM orders")
def tag_upsert(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), "o_orderpriority")
    change = o.where("o_orderpriority = '5-LOW'").select("id", (F.col("value") * 2).alias("value"))
    return dml.upsert(o.select("id", "value"), change, ["id"])


@query("SELECT o_orderkey AS id, c_mktsegment AS value FROM orders JOIN customer ON o_custkey = c_custkey")
def tag_propagate(spark, sf):
    """A set's tag goes to its members."""
    tag = t.table(spark, sf, "customer").select((F.col("c_custkey") + F.lit(t.CUSTOMER)).alias("sid"), F.col("c_mktsegment").alias("value"))
    return sets.pass_down(t.set_members(spark, sf), tag).where("etype = 4").select("id", "value")


@query("SELECT p_partkey AS id, round(2 * p_size - p_retailprice + 3, 4) AS x, round(CAST(p_size AS DOUBLE) + 1, 4) AS y FROM part")
def affine_transform(spark, sf):
    v = t.vertices(spark, sf).withColumn("z", F.lit(0.0))
    return dml.transform(v, [[2, -1, 0, 3], [1, 0, 0, 1], [0, 0, 1, 0]]).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


# --- partitions ----------------------------------------------------------


@query("SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS n_parts, min(l_suppkey) AS owner FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def shared_entities(spark, sf):
    return partition.shared(t.part_of(spark, sf), ["id"])


@query("SELECT parts, count(*) AS n_entities FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey))::VARCHAR AS parts FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) BETWEEN 2 AND 1000000) GROUP BY parts")
def interface_sets(spark, sf):
    p = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("part_id"))
    return partition.interfaces(p, ["id"]).select(F.concat(F.lit("["), F.array_join(F.transform("parts", lambda v: v.cast("string")), ", "), F.lit("]")).alias("parts"), "n_entities")


@query("SELECT a.l_suppkey AS part_id, b.l_suppkey AS other, count(DISTINCT a.l_orderkey) AS n_shared FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2")
def part_neighbours(spark, sf):
    p = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("part_id"))
    return partition.neighbours(p, ["id"])


@query(f"WITH inc AS {INC}, home AS (SELECT l_orderkey AS id, min(l_suppkey) AS part_id FROM lineitem GROUP BY 1) SELECT DISTINCT h.part_id, b.id, 1 AS layer FROM home h JOIN inc a ON a.id = h.id JOIN inc b ON a.vid = b.vid JOIN home g ON g.id = b.id WHERE g.part_id <> h.part_id")
def ghost_layer(spark, sf):
    return partition.ghosts(t.incidence(spark, sf), t.home_part(spark, sf), 1)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING min(l_suppkey) IN (1, 4))")
def keep_parts(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return partition.keep_parts(o, t.home_part(spark, sf), [1, 4], ["id"])


@query("SELECT o_orderkey AS id, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 6 AS INTEGER) AS part FROM orders")
def round_robin_parts(spark, sf):
    return partition.round_robin(t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), 6, ["id"])


# --- space ---------------------------------------------------------------

_PT = "(SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)"


@query(f"WITH p AS {_PT}, b AS (SELECT label AS id, avg(x) - 0.05 AS x0, avg(x) + 0.05 AS x1, avg(y) - 0.05 AS y0, avg(y) + 0.05 AS y1, avg(z) - 0.05 AS z0, avg(z) + 0.05 AS z1 FROM p GROUP BY label) SELECT p.id AS point, b.id AS box FROM p JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1")
def point_in_box(spark, sf):
    p = t.points(spark, sf)
    b = p.groupBy(F.col("label").alias("id")).agg(*[(F.avg(c) + s * 0.05).alias(f"{c}{n}") for c in "xyz" for s, n in ((-1, "min"), (1, "max"))])
    return spatial.points_in_boxes(p, b).select("point", "box")


@query(f"WITH p AS {_PT} SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.0009")
def within_distance(spark, sf):
    p = t.points(spark, sf)
    return spatial.within_distance(p, p, 0.03).where("a < b").select("a", "b")


@query(f"WITH p AS {_PT} SELECT a, b, CAST(rank AS INTEGER) AS rank FROM (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), b.id) AS rank FROM p a, p b) WHERE rank <= 3")
def nearest_point(spark, sf):
    """Nearest three of all points, for every point."""
    p = t.points(spark, sf)
    return spatial.nearest(p, p, 3).select("a", "b", "rank")


@query(f"""WITH p AS {_PT}, c AS (SELECT quantile_disc(x, 0.5) AS mx, quantile_disc(y, 0.5) AS my, quantile_disc(z, 0.5) AS mz, max(x)-min(x) AS wx, max(y)-min(y) AS wy, max(z)-min(z) AS wz FROM p),
q AS (SELECT p.*, CASE WHEN wx >= wy AND wx >= wz THEN x > mx WHEN wy >= wz THEN y > my ELSE z > mz END AS hi FROM p, c) SELECT id, CAST(hi AS INTEGER) AS part FROM q""")
def rcb_partition(spark, sf):
    """One bisection at the lower median of the widest side."""
    p = t.points(spark, sf)
    return spatial.rcb(p, 1, accuracy=1_000_000)


@query("WITH m AS (SELECT p_partkey AS id, p_size % 8 AS a, p_partkey % 8 AS b FROM part) SELECT id, (a & 1) + 2 * (b & 1) + 2 * (a & 2) + 4 * (b & 2) + 4 * (a & 4) + 8 * (b & 4) AS key FROM m")
def morton_keys(spark, sf):
    p = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 8).alias("a"), (F.col("p_partkey") % 8).alias("b"))
    return p.select("id", spatial.morton([F.col("a"), F.col("b")], 3).alias("key"))


@query(f"WITH p AS {_PT}, l AS (SELECT count(*) AS n FROM p GROUP BY floor(x / 0.1), floor(y / 0.1), floor(z / 0.1)) SELECT count(*) AS leaves, min(n) AS least, round(avg(n), 6) AS mean, round(sqrt(avg(n * n)), 6) AS rms, max(n) AS greatest FROM l")
def grid_index_stats(spark, sf):
    s = spatial.tree_stats(t.points(spark, sf), 0.1)
    return s.select("leaves", "least", F.round("mean", 6).alias("mean"), F.round("rms", 6).alias("rms"), "greatest")


# --- relations -----------------------------------------------------------


@query("SELECT c_custkey AS a, s_suppkey AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_mktsegment = 'MACHINERY'")
def infer_relations(spark, sf):
    """Entities of two models that have the same tag."""
    from ..operators import relations

    c = t.table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return relations.infer(c, s, ["nation"])


@query("SELECT 'vertex' AS \"table\", count(*) AS rows, count(*) * 32 AS bytes FROM part UNION ALL SELECT 'element', count(DISTINCT l_orderkey), CAST(count(*) * 8 + count(DISTINCT l_orderkey) * 9 AS BIGINT) FROM lineitem UNION ALL SELECT 'member', count(*), count(*) * 21 FROM (SELECT 1 FROM nation UNION ALL SELECT 1 FROM customer UNION ALL SELECT 1 FROM orders)")
def storage_estimate(spark, sf):
    from ..operators import relations

    m = mesh.Mesh.build(t.vertices(spark, sf), t.elements(spark, sf), member=t.set_members(spark, sf))
    return relations.storage(m)


@query('SELECT p_partkey AS id, CAST(sum(new) OVER (ORDER BY p_retailprice, p_partkey) AS BIGINT) AS "group" FROM (SELECT *, CASE WHEN p_retailprice - lag(p_retailprice) OVER (ORDER BY p_retailprice, p_partkey) <= 0.05 THEN 0 ELSE 1 END AS new FROM part)')
def tolerance_sort(spark, sf):
    """Values sorted, those within a tolerance of their neighbour together."""
    from ..operators import relations

    p = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_retailprice")
    return relations.tolerance_groups(p, "p_retailprice", 0.05).select("id", "group")
