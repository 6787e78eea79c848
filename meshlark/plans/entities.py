"""Registered queries: edits of entities and sets, packing of parts, trees, topology and quality over the driver's tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import quality
from ..functions import topology as T
from ..operators import adjacency, aggregate, coupler, dml, graph, ordered, partition, refine, sets, solids, trees
from ..operators.mesh import Mesh
from . import core, geometry
from . import tables as t

Q, SQL = {}, {}


def query(sql: str):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


PART = "(SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, 0.0::DOUBLE AS z FROM part)"


def _code(name: str):  # noqa: ANN202
    return F.lit(T.CODE[name]).cast("tinyint")


def _mesh(spark: SparkSession, sf: str, **rest) -> Mesh:  # noqa: ANN003
    return Mesh.build(t.vertices(spark, sf).withColumn("z", F.lit(0.0)), t.elements(spark, sf), **rest)


def _said(conn: str):  # noqa: ANN202
    return F.concat(F.lit("["), F.array_join(F.transform(conn, lambda v: v.cast("string")), ", "), F.lit("]"))


# --- entities --------------------------------------------------------------


@query(f"SELECT id, x, y, z FROM {PART} UNION ALL SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY x, y, z), x, y, z FROM {core._PT}")
def create_entities(spark, sf):
    """The embeddings as new vertices."""
    return dml.create_vertices(_mesh(spark, sf), t.points(spark, sf)).vertex


@query(f"SELECT DISTINCT 'no such vertex' AS problem, id FROM {core.INC} WHERE vid IN (SELECT p_partkey FROM part WHERE p_size > 45) UNION ALL SELECT 'no such member', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def mesh_problems(spark, sf):
    """What is wrong with a mesh whose larger vertices are missing and whose sets hold empty orders."""
    m = _mesh(spark, sf, member=t.set_members(spark, sf).where("etype = 4"))
    return dml.check(Mesh.build(m.vertex.where("x <= 45"), m.element, member=m.member)).select("problem", "id")


_MERGED = """WITH m AS (SELECT p_partkey AS old, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS new FROM part),
e AS (SELECT l_orderkey AS id, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY 1 HAVING a < b),
r AS (SELECT id, least(p.new, q.new) AS lo, greatest(p.new, q.new) AS hi FROM e JOIN m p ON p.old = a JOIN m q ON q.old = b), k AS (SELECT *, min(id) OVER (PARTITION BY lo, hi) AS kept FROM r)"""


def _merged(spark, sf):  # noqa: ANN001, ANN202
    e = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b")).where("a < b")
    member = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("sid"), F.lit(None).cast("int").alias("pos"), _code("edge").alias("etype"), F.col("o_orderkey").alias("id"))
    element = e.select(_code("edge").alias("etype"), "id", F.array("a", "b").alias("conn"))
    tag = t.tag(spark, sf, "orders", "o_orderkey", "o_orderpriority", T.CODE["edge"])
    m = Mesh.build(t.vertices(spark, sf).withColumn("z", F.lit(0.0)), element, member=member.join(e, "id", "left_semi").select(*member.columns), tags={"priority": tag.join(e, "id", "left_semi").select("etype", "id", "value")})
    return dml.apply_merge(m, core.merge_integer_tag(spark, sf))


@query(f"{_MERGED} SELECT kept AS id, lo, hi, o_orderpriority AS value FROM k JOIN orders ON o_orderkey = kept WHERE id = kept")
def merge_entities(spark, sf):
    """Edges that come to be the same are one, with its own tag."""
    m = _merged(spark, sf)
    return m.element.join(m.tags["priority"], ["etype", "id"]).select("id", F.array_min("conn").alias("lo"), F.array_max("conn").alias("hi"), "value")


@query(f"{_MERGED} SELECT DISTINCT o_custkey AS sid, kept AS id FROM k JOIN orders ON o_orderkey = id")
def merge_members(spark, sf):
    """Sets hold what their members were merged into."""
    return _merged(spark, sf).member.select("sid", "id")


@query("SELECT p_partkey AS id, CAST(p_size AS DOUBLE) + CASE WHEN p_size < 10 THEN 1 ELSE 0 END AS x FROM part")
def set_coordinates(spark, sf):
    """Some vertices move by one; rows of vertices that don't exist change nothing."""
    m = _mesh(spark, sf)
    moved = m.vertex.where("x < 10").withColumn("x", F.col("x") + 1)
    return dml.set_coordinates(m, moved.unionByName(moved.withColumn("id", -F.col("id") - 1))).vertex.select("id", "x")


@query("SELECT l_orderkey AS id, CAST(CASE WHEN count(*) > 4 THEN 3 ELSE count(*) END AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey")
def set_connectivity(spark, sf):
    """Long polygons get their first three vertices."""
    m = _mesh(spark, sf)
    return dml.set_connectivity(m, m.element.where(F.size("conn") > 4).withColumn("conn", F.slice("conn", 1, 3))).element.select("id", F.size("conn").alias("n"))


@query(f"SELECT DISTINCT id, vid FROM (SELECT o_orderkey AS id, o_custkey AS vid FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT id, vid FROM {core.INC} WHERE vid % 3 = 0) WHERE id % 7 <> 0 OR vid % 2 <> 0")
def adjacency_edits(spark, sf):
    """Explicit adjacencies: some there, some added, some removed, kept both ways round."""
    o = t.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(_code("polygon").alias("etype"), F.col("o_orderkey").alias("id"), _code("vertex").alias("to_etype"), F.col("o_custkey").alias("to_id"))
    i = t.incidence(spark, sf).where("vid % 3 = 0").select("etype", "id", _code("vertex").alias("to_etype"), F.col("vid").alias("to_id"))
    start = o.unionByName(o.toDF("to_etype", "to_id", "etype", "id"))
    gone = o.unionByName(i).where("id % 7 = 0 AND to_id % 2 = 0")
    out = dml.edit_adjacencies(start, i, gone)
    back = out.where("etype = 0").select(F.col("to_id").alias("id"), F.col("id").alias("vid"))
    return out.where("etype = 4").select("id", F.col("to_id").alias("vid")).intersect(back)


@query("""WITH s AS (SELECT p_partkey AS old, (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY p_partkey) AS new FROM part WHERE p_size BETWEEN 7 AND 12)
SELECT l_orderkey AS id, list(CASE WHEN o_orderstatus = 'F' THEN coalesce(new, l_partkey) ELSE l_partkey END ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)::VARCHAR AS conn
FROM lineitem LEFT JOIN s ON old = l_partkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey""")
def split_vertices(spark, sf):
    """Vertices in two along what divides final orders from the others."""
    side = t.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(_code("polygon").alias("etype"), F.col("o_orderkey").alias("id"))
    m, _ = dml.split_vertices(_mesh(spark, sf), t.table(spark, sf, "part").where("p_size BETWEEN 7 AND 12").select(F.col("p_partkey").alias("id")), side)
    return m.element.select("id", _said("conn").alias("conn"))


@query("SELECT o_orderkey AS id, 4 * 72057594037927936 + o_orderkey AS handle, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders")
def handle_order(spark, sf):
    """Handles sort by type, then id, and give both back."""
    o = t.table(spark, sf, "orders").select(T.pack_handle(_code("polygon"), F.col("o_orderkey")).alias("handle"))
    kind, eid = T.unpack_handle(F.col("handle"))
    return ordered.dense_ids(o, ["handle"], "rank").where(kind == T.CODE["polygon"]).select(eid.alias("id"), "handle", "rank")


@query("SELECT quality AS value, count(*) AS n FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) GROUP BY quality")
def tagged_counts(spark, sf):
    tag = t.tag(spark, sf, "labels", "doc_id", "quality", 0).groupBy("etype", "id").agg(F.min("value").alias("value"))
    return aggregate.tag_counts(core._docs(spark, sf), tag).select("value", "n")


@query("SELECT p_partkey AS id, (SELECT count(*) FROM orders WHERE o_totalprice < p_retailprice * 200) AS pos FROM part")
def sorted_search(spark, sf):
    """Where keys go into a sorted list."""
    keys = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") * 200).alias("value"))
    return ordered.search(t.table(spark, sf, "orders").select(F.col("o_totalprice").alias("value")), keys)


# --- sets --------------------------------------------------------------------

_NATION = f"SELECT c_nationkey + {t.NATION} AS sid, c_custkey + {t.CUSTOMER} AS id FROM customer"


@query(f"{_NATION} UNION SELECT c_nationkey + {t.NATION}, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def set_add(spark, sf):
    """Nations' sets get their dear orders too, each once though added twice."""
    o, c = t.table(spark, sf, "orders").where("o_totalprice > 300000"), t.table(spark, sf, "customer")
    new = o.join(c, o.o_custkey == c.c_custkey).select((F.col("c_nationkey") + F.lit(t.NATION)).alias("sid"), _code("polygon").alias("etype"), F.col("o_orderkey").alias("id"))
    member = t.set_members(spark, sf).where(F.col("sid").between(t.NATION, t.CUSTOMER - 1))
    eset = member.select("sid").distinct().select("sid", F.lit(False).alias("ordered"), F.lit(False).alias("track"))
    return sets.add_each(member, eset, new.unionByName(new)).select("sid", "id")


@query("SELECT sid, CAST(row_number() OVER (PARTITION BY sid ORDER BY late, id) - 1 AS INTEGER) AS pos, id FROM (SELECT o_custkey AS sid, 0 AS late, o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F'))")
def set_append(spark, sf):
    """Ordered sets of customers' open orders, and the dear ones appended, repeats and all."""
    o = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("sid"), F.lit(None).cast("int").alias("pos"), _code("polygon").alias("etype"), F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")
    start = sets.convert_each(o.where("o_orderstatus <> 'F'").select("sid", "pos", "etype", "id"), True)
    eset = start.select("sid").distinct().select("sid", F.lit(True).alias("ordered"), F.lit(False).alias("track"))
    return sets.add_each(start, eset, o.where("o_totalprice > 300000").select("sid", "etype", "id")).select("sid", "pos", "id")


@query("SELECT o_custkey AS sid, o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'")
def set_remove(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("sid"), F.lit(None).cast("int").alias("pos"), _code("polygon").alias("etype"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    return sets.remove_each(o.drop("o_orderstatus"), o.where("o_orderstatus = 'F'")).select("sid", "id")


@query("SELECT DISTINCT o_custkey AS sid, CASE WHEN o_orderpriority = '1-URGENT' THEN min(o_orderkey) OVER (PARTITION BY o_custkey) ELSE o_orderkey END AS id FROM orders")
def set_replace(spark, sf):
    """Urgent orders give way to their customer's first."""
    o = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("sid"), F.lit(None).cast("int").alias("pos"), _code("polygon").alias("etype"), F.col("o_orderkey").alias("id"), "o_orderpriority")
    first = o.groupBy("sid").agg(F.min("id").alias("new_id"))
    pairs = o.where("o_orderpriority = '1-URGENT'").join(first, "sid").select("sid", "etype", "id", F.col("etype").alias("new_etype"), "new_id")
    return sets.swap_each(o.drop("o_orderpriority"), pairs).select("sid", "id")


@query("SELECT r_regionkey AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_regionkey")
def set_entities_by_type(spark, sf):
    """Polygons in regions' sets and all sets in these."""
    sids = t.table(spark, sf, "region").select((F.col("r_regionkey") + F.lit(t.REGION)).alias("sid"))
    got = sets.within(t.set_members(spark, sf), sids, T.CODE["polygon"], T.CODE["polygon"], recursive=True)
    return got.groupBy((F.col("sid") - t.REGION).cast("int").alias("region")).agg(F.count("*").alias("n"))


# --- parts -------------------------------------------------------------------

_HOME = "(SELECT l_orderkey AS id, min(l_suppkey) AS part_id FROM lineitem GROUP BY 1)"


@query(f"SELECT o_custkey + {t.CUSTOMER} AS sid, count(DISTINCT part_id) AS n_parts, min(part_id) AS owner FROM orders JOIN {_HOME} ON id = o_orderkey GROUP BY 1 HAVING n_parts > 1")
def shared_sets(spark, sf):
    """Customers whose orders lie in several parts."""
    return partition.resolve_sets(t.set_members(spark, sf).where("etype = 4"), t.home_part(spark, sf))


@query(f"SELECT part_id, 'element' AS kind, count(*) AS n FROM {_HOME} GROUP BY 1 UNION ALL SELECT part_id, 'vertex', count(DISTINCT l_partkey) FROM {_HOME} JOIN lineitem ON id = l_orderkey GROUP BY 1 UNION ALL SELECT part_id, 'set', count(DISTINCT o_custkey) FROM {_HOME} JOIN orders ON id = o_orderkey GROUP BY 1")
def pack_parts(spark, sf):
    """What each part must be sent."""
    p = partition.pack(t.elements(spark, sf), t.set_members(spark, sf).where("etype = 4"), t.home_part(spark, sf))
    kind = F.when(F.col("etype") == 0, "vertex").when(F.col("etype") == 4, "element").otherwise("set")
    return p.groupBy("part_id", kind.alias("kind")).agg(F.count("*").alias("n"))


_GO = f"SELECT id, part_id, CASE WHEN o_orderpriority = '1-URGENT' THEN part_id % 10 + 1 END AS \"to\" FROM {_HOME} JOIN orders ON o_orderkey = id"


def _moves(spark, sf):  # noqa: ANN001, ANN202
    o = t.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return t.home_part(spark, sf).join(o, "id").select("id", (F.col("part_id") % 10 + 1).alias("to"))


@query(f"SELECT part_id, \"to\", count(*) AS n FROM ({_GO}) WHERE \"to\" <> part_id GROUP BY ALL")
def migrate_sent(spark, sf):
    """How many urgent orders go from which part to which."""
    return partition.migrate(t.home_part(spark, sf), _moves(spark, sf))[1]


@query(f"SELECT id, coalesce(\"to\", part_id) AS part_id FROM ({_GO})")
def migrate_parts(spark, sf):
    return partition.migrate(t.home_part(spark, sf), _moves(spark, sf))[0]


@query(f"SELECT id, row_number() OVER (ORDER BY part_id, id) - 1 AS at FROM {_HOME}")
def gather_parts(spark, sf):
    """Places in the list of all parts' orders."""
    p = t.home_part(spark, sf)
    return partition.gather(p.select("id"), p).select("id", "at")


@query("""WITH l AS (SELECT l_orderkey AS id, l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS b FROM lineitem), d AS (SELECT DISTINCT id, a, b FROM l WHERE a <> b)
SELECT a AS part_id, id, b AS other FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.id = d.id AND e.a = d.b AND e.b = d.a)""")
def consistency_check(spark, sf):
    """Links from each line's supplier to the next one's that have no counterpart."""
    w = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    lines = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*w))), lambda s: s["l_suppkey"]).alias("s"))
    pairs = lines.select("id", F.explode(F.arrays_zip(F.col("s").alias("a"), F.slice("s", 2, 1 << 20).alias("b"))).alias("p")).where("p.b IS NOT NULL AND p.a <> p.b")
    links = pairs.select(F.col("p.a").alias("part_id"), "id", F.col("p.b").alias("other"), F.col("id").alias("other_id")).distinct()
    return partition.asymmetric(links).select("part_id", "id", "other")


# --- trees -------------------------------------------------------------------

_TREE = f"""WITH p AS {core._PT}, b AS (SELECT (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (min(z) + max(z)) / 2 AS mz FROM p),
l AS (SELECT p.*, CAST(8 + 4 * CAST(x > mx AS INTEGER) + 2 * CAST(y > my AS INTEGER) + CAST(z > mz AS INTEGER) AS BIGINT) AS node FROM p, b),
t AS (SELECT node >> k AS node, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM l, range(4) r(k) GROUP BY ALL)"""


def _tree(spark, sf):  # noqa: ANN001, ANN202
    return trees.build(t.points(spark, sf), 3, "middle")


@query(f"{_TREE} SELECT node, n, round(x0, 6) AS xmin, round(x1, 6) AS xmax, round(y0, 6) AS ymin, round(y1, 6) AS ymax, round(z0, 6) AS zmin, round(z1, 6) AS zmax FROM t")
def tree_nodes(spark, sf):
    """Nodes of a tree that halves the box along each axis, with tight boxes."""
    n = _tree(spark, sf)[0]
    return n.select("node", "n", *[F.round(c, 6).alias(c) for c in n.columns[3:]])


@query(f"{_TREE} SELECT id, node FROM l")
def tree_leaf_of_point(spark, sf):
    return _tree(spark, sf)[1]


@query(f"""{_TREE}, c AS (SELECT label AS box, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY label)
SELECT box, node FROM c, t WHERE node >= 8 AND cx - 0.02 <= x1 AND cx + 0.02 >= x0 AND cy - 0.02 <= y1 AND cy + 0.02 >= y0 AND cz - 0.02 <= z1 AND cz + 0.02 >= z0""")
def tree_box_leaves(spark, sf):
    """Leaves that boxes around the labels' middles meet, by descent."""
    b = t.points(spark, sf).groupBy(F.col("label").alias("id")).agg(*[(F.avg(c) + s * 0.02).alias(f"{c}{n}") for c in "xyz" for s, n in ((-1, "lo"), (1, "hi"))])
    return trees.box_leaves(_tree(spark, sf)[0], b, 3)


_SLAB = {c: (f"({c}0 - o{c}) / d{c}", f"({c}1 - o{c}) / d{c}") for c in "xyz"}
_IN = "greatest(0, " + ", ".join(f"least({a}, {b})" for a, b in _SLAB.values()) + ")"
_OUT = "least(" + ", ".join(f"greatest({a}, {b})" for a, b in _SLAB.values()) + ")"


@query(f"""{_TREE}, r AS (SELECT a.id AS ray, a.x AS ox, a.y AS oy, a.z AS oz, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM p a JOIN p b ON b.id = a.id + 1)
SELECT ray, node, round(enter, 5) + 0.0 AS enter, round(leave, 5) + 0.0 AS leave FROM (SELECT ray, node, {_IN} AS enter, {_OUT} AS leave FROM r, t WHERE node >= 8 AND dx <> 0 AND dy <> 0 AND dz <> 0) WHERE enter <= leave""")
def tree_ray_leaves(spark, sf):
    """Leaf boxes along the way from each point to the next and on, with the interval in each."""
    p = t.points(spark, sf)
    to = p.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    rays = p.join(to, "id").select(F.col("id").alias("ray"), *[F.col(c).alias(f"o{c}") for c in "xyz"], *[(F.col(f"b{c}") - F.col(c)).alias(f"d{c}") for c in "xyz"]).where("dx <> 0 AND dy <> 0 AND dz <> 0")
    return trees.ray_leaves(_tree(spark, sf)[0], rays, 3).select("ray", "node", (F.round("enter", 5) + 0.0).alias("enter"), (F.round("leave", 5) + 0.0).alias("leave"))


_COV = ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for k, a in enumerate("xyz") for b in "xyz"[k:])


@query(f"""WITH c AS (SELECT label, count(*) AS n, {_COV} FROM {core._PT} GROUP BY label), m AS (SELECT *, (xx + yy + zz) / 3 AS m FROM c),
q AS (SELECT *, ((xx-m)*(xx-m) + (yy-m)*(yy-m) + (zz-m)*(zz-m) + 2*(xy*xy + xz*xz + yz*yz)) / 6 AS p, ((xx-m)*((yy-m)*(zz-m) - yz*yz) - xy*(xy*(zz-m) - yz*xz) + xz*(xy*yz - (yy-m)*xz)) / 2 AS d FROM m),
a AS (SELECT *, acos(greatest(-1, least(1, d / (p * sqrt(p))))) / 3 AS phi FROM q)
SELECT label, n, round(m + 2*sqrt(p)*cos(phi), 7) AS first, round(m + 2*sqrt(p)*cos(phi + 4*pi()/3), 7) AS second, round(m + 2*sqrt(p)*cos(phi + 2*pi()/3), 7) AS third FROM a""")
def oriented_box_axes(spark, sf):
    """Variance along the axes of each label's oriented box."""
    p = t.points(spark, sf)
    return aggregate.oriented_box(p, ["label"]).join(p.groupBy("label").agg(F.count("*").alias("n")), "label").select("label", "n", *[F.round(F.col("variance")[k], 7).alias(n) for k, n in enumerate(("first", "second", "third"))])


# --- topology and quality ------------------------------------------------------


@query(f"WITH {core._RING} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY r) - 1 AS INTEGER) AS side, least(v, coalesce(nxt, fst)) AS lo, greatest(v, coalesce(nxt, fst)) AS hi, CASE WHEN v <= coalesce(nxt, fst) THEN 1 ELSE -1 END AS sense FROM ring")
def side_senses(spark, sf):
    """Sides of polygons against edges that run from the smaller vertex to the larger."""
    e = t.elements(spark, sf)
    number = F.col("key")[0] * F.lit(1 << 31) + F.col("key")[1]
    lower = adjacency.sides(e, 1).select("key").distinct().select(_code("edge").alias("etype"), number.alias("id"), F.col("key").alias("conn"))
    m = adjacency.match_sides(e, lower, 1)
    return m.select("id", "side", F.shiftright("to_id", 31).alias("lo"), F.col("to_id").bitwiseAND(F.lit((1 << 31) - 1)).alias("hi"), "sense")


_THREE = "(SELECT l_orderkey AS id, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS c FROM lineitem GROUP BY 1 HAVING count(*) = 3)"


@query(f"""WITH f AS (SELECT o_custkey AS volume, o_orderstatus, c[1] AS p, c[2] AS q, c[3] AS r FROM {_THREE} JOIN orders ON o_orderkey = id),
g AS (SELECT volume, p, q, r FROM f UNION ALL SELECT volume, p, r, q FROM f WHERE o_orderstatus = 'F'),
e AS (SELECT volume, p AS a, q AS b FROM g UNION ALL SELECT volume, q, r FROM g UNION ALL SELECT volume, r, p FROM g)
SELECT volume, a, b, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.volume = e.volume AND x.a = e.b AND x.b = e.a) GROUP BY ALL""")
def sealed_check(spark, sf):
    """Open edges of triangles by customer; final orders' triangles are there both ways round, so they are closed."""
    e = t.elements(spark, sf).where(F.size("conn") == 3).join(t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("volume"), "o_orderstatus"), "id")
    c = F.col("conn")
    there = e.select("volume", *[c[k].alias(f"v{k}") for k in range(3)])
    back = e.where("o_orderstatus = 'F'").select("volume", c[0].alias("v0"), c[2].alias("v1"), c[1].alias("v2"))
    return solids.unsealed(there.unionByName(back)).groupBy("volume", "a", "b").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS node, root FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS root FROM part) WHERE p_partkey <> root")
def graph_components(spark, sf):
    """Parts of one brand and size are a chain in the order of their prices."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand", "p_size").orderBy("p_retailprice", "p_partkey")
    chain = t.table(spark, sf, "part").select(F.col("p_partkey").alias("u"), F.lead("p_partkey").over(w).alias("v")).where("v IS NOT NULL")
    return graph.components(chain)


def _cells_sql(n: int) -> str:
    at = ", ".join(f"max(CASE WHEN id % {n} = {k} THEN {c} END) AS {c}{k}" for k in range(n) for c in "xyz")
    return f"(SELECT id // {n} AS id, {at} FROM {core._PT} GROUP BY 1 HAVING count(*) = {n})"


def _p(k: int) -> list[str]:
    return [f"{c}{k}" for c in "xyz"]


def _minus(a: list[str], b: list[str]) -> list[str]:
    return [f"({x} - {y})" for x, y in zip(a, b, strict=True)]


def _plus(ks: tuple[int, ...]) -> list[str]:
    return ["(" + " + ".join(f"{c}{k}" for k in ks) + ")" for c in "xyz"]


def _dot(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def _cross(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


def _len(a: list[str]) -> str:
    return f"sqrt({_dot(a, a)})"


_HEX_EDGES = ", ".join(_len(_minus(_p(b), _p(a))) for a, b in T.EDGES["hex"])
_HEX_X = [_minus(_plus(a), _plus(b)) for a, b in (((1, 2, 6, 5), (0, 3, 7, 4)), ((3, 2, 6, 7), (0, 1, 5, 4)), ((4, 5, 6, 7), (0, 1, 2, 3)))]
_HEX_MID = _dot(_HEX_X[0], _cross(_HEX_X[1], _HEX_X[2]))
_HEX_DETS = [_dot(_minus(_p(a), _p(k)), _cross(_minus(_p(b), _p(k)), _minus(_p(c), _p(k)))) for k, (a, b, c) in enumerate(quality.HEX_AXES)]
_HEX_DIAGONALS = ", ".join(_len(_minus(_p(a), _p(b))) for a, b in ((6, 0), (7, 1), (4, 2), (5, 3)))


@query(f"SELECT id, round(greatest({_HEX_EDGES}) / least({_HEX_EDGES}), 5) AS edge_ratio, round({_HEX_MID} / 64, 7) AS volume, round(least({', '.join(_HEX_DETS)}, {_HEX_MID} / 64), 7) AS jacobian, round(least({_HEX_DIAGONALS}) / greatest({_HEX_DIAGONALS}), 6) AS diagonal, round(sqrt(3) * least({_HEX_EDGES}) / greatest({_HEX_DIAGONALS}), 6) AS stretch FROM {_cells_sql(8)}")
def quality_hexes(spark, sf):
    """Every eight vectors are a hex, badly skewed."""
    e, p = geometry._cells(spark, sf, "hex", 8)
    q = quality.measure(e, p, "hex", ["edge_ratio", "volume", "jacobian", "diagonal", "stretch"])
    return q.select("id", *[F.round(c, d).alias(c) for c, d in (("edge_ratio", 5), ("volume", 7), ("jacobian", 7), ("diagonal", 6), ("stretch", 6))])


_QUAD_E = [_minus(_p((k + 1) % 4), _p(k)) for k in range(4)]
_QUAD_L = ", ".join(_len(e) for e in _QUAD_E)
_QUAD_D = f"greatest({_len(_minus(_p(2), _p(0)))}, {_len(_minus(_p(3), _p(1)))})"
_QUAD_X = _minus(_plus((1, 2)), _plus((0, 3))), _minus(_plus((2, 3)), _plus((0, 1)))
_QUAD_N = _cross(*_QUAD_X)
_QUAD_A = [f"{_dot(_QUAD_N, _cross(_QUAD_E[k - 1], _QUAD_E[k]))} / {_len(_QUAD_N)}" for k in range(4)]


@query(f"SELECT id, round(greatest({_QUAD_L}) / least({_QUAD_L}), 5) AS edge_ratio, round(({' + '.join(_QUAD_A)}) / 4, 7) AS area, round(least({', '.join(_QUAD_A)}), 7) AS jacobian, round(abs({_dot(*_QUAD_X)} / ({_len(_QUAD_X[0])} * {_len(_QUAD_X[1])})), 6) AS skew, round(sqrt(2) * least({_QUAD_L}) / {_QUAD_D}, 6) AS stretch FROM {_cells_sql(4)}")
def quality_quads(spark, sf):
    """Every four vectors are a quad, not flat."""
    e, p = geometry._cells(spark, sf, "quad", 4)
    q = quality.measure(e, p, "quad", ["edge_ratio", "area", "jacobian", "skew", "stretch"])
    return q.select("id", *[F.round(c, d).alias(c) for c, d in (("edge_ratio", 5), ("area", 7), ("jacobian", 7), ("skew", 6), ("stretch", 6))])


@query(f"SELECT CAST(count(*) + sum(m) AS BIGINT) AS cells, CAST(3 * count(*) + sum(m) AS BIGINT) AS vertices, round(sum(s), 5) AS area FROM (SELECT s, CAST(l0 > 0.15 AS INTEGER) + CAST(l1 > 0.15 AS INTEGER) + CAST(l2 > 0.15 AS INTEGER) AS m FROM {geometry._LEN})")
def adaptive_triangles(spark, sf):
    """Triangles cut through their long edges; the area stays."""
    e, p = geometry._cells(spark, sf, "tri", 3)
    used = p.join(e.select(F.explode("conn").alias("id")), "id", "left_semi").select("id", "x", "y", "z")
    length = F.sqrt(sum(((F.col(f"b{c}") - F.col(f"a{c}")) * (F.col(f"b{c}") - F.col(f"a{c}")) for c in "yz"), (F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax"))))
    m = refine.adaptive_tris(Mesh.build(used, e), length > 0.15)
    cells = quality.measure(m.element, m.vertex, "tri", ["area"]).agg(F.count("*").alias("cells"), F.round(F.sum("area"), 5).alias("area"))
    return cells.crossJoin(F.broadcast(m.vertex.agg(F.count("*").alias("vertices")))).select("cells", "vertices", "area")


@query(f"SELECT id, round(s * ((ax + bx + cx) + 2 * (ay + by_ + cy) + 3 * (az + bz + cz)) / 3, 7) AS integral FROM {geometry._LEN} JOIN {geometry._TRI} USING (id)")
def element_integrals(spark, sf):
    """A linear field over triangles."""
    e, p = geometry._cells(spark, sf, "tri", 3)
    f = p.select("id", (F.col("x") + 2 * F.col("y") + 3 * F.col("z")).alias("value"))
    return coupler.integrals(e, p, f, "tri").select("id", F.round("integral", 7).alias("integral"))
