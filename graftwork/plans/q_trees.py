"""Queries for trees, clusters, patching, transport, fields and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graftwork import model as M
from graftwork.functions import fields as FI
from graftwork.operators import cluster as CL
from graftwork.operators import construct as CO
from graftwork.operators import distance as D
from graftwork.operators import graph as GR
from graftwork.operators import patch as PA
from graftwork.operators import transport as OT
from graftwork.operators import trees as T
from graftwork.plans import tree_sql as Q
from graftwork.plans.q_graph import KNN, knn_edges, r6
from graftwork.plans.q_paths import GA, MST, SIDES, centers, kept
from graftwork.session import load, scratch_path, written
from graftwork.streaming import graph_events as ST

QUERIES, ORACLES = {}, {}
PL, P = M.PLANE_SQL, M.POINTS_SQL


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def shape(tree: DataFrame) -> DataFrame:
    """(n_edges, n_nodes, n_components): a tree has one more node than edges and one component."""
    t = written(tree.select("u", "v"), "shape")
    n = t.select(F.explode(F.array("u", "v")).alias("id")).agg(F.countDistinct("id").alias("n_nodes"))
    c = GR.connected_components(t).agg(F.countDistinct("component").alias("n_components"))
    return t.agg(F.count("*").alias("n_edges")).crossJoin(n).crossJoin(c)  # one row each


TREE25 = "SELECT 24::BIGINT AS n_edges, 25::BIGINT AS n_nodes, 1::BIGINT AS n_components"


def plane_knn(spark: SparkSession, d: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    p = written(M.plane_points(spark, d), "plane")
    return p, written(CO.knn_graph(p, 1, k)[0], "knn")


def some_centers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(3,), (17,), (42,)], "id long")


# ---- 2.7 -----------------------------------------------------------------------------------------------------------------


def picks(tree: DataFrame) -> DataFrame:
    """The picked edges with round and score, as the SQL of `tree_sql` gives them."""
    return tree.select("u", "v", F.col("step").cast("long").alias("step"), F.round(F.col("score").cast("double"), 6).alias("score"))


@query(Q.tree(Q.iterated("a", "SELECT u, v, w FROM nation_edges", "cluster_all")))
def tr01_ict_cluster_all(spark: SparkSession, d: str) -> DataFrame:
    return picks(T.iterated_centrality_tree(kept(spark, d), "cluster_all", centers(spark), True))


@query(Q.tree(Q.iterated("a", "SELECT u, v, w FROM nation_edges", "exact")))
def tr01_ict_exact(spark: SparkSession, d: str) -> DataFrame:
    return picks(T.iterated_centrality_tree(kept(spark, d), "exact", None, True))


@query(Q.tree(Q.iterated("a", "SELECT u, v, w FROM nation_edges", "cluster")))
def tr03_ict_cluster(spark: SparkSession, d: str) -> DataFrame:
    return picks(T.iterated_centrality_tree(kept(spark, d), "cluster", centers(spark), True))


@query(f"{GA}, b AS (SELECT e.u, e.v, sum(x.c * y.c * 1.0 / z.c) AS score FROM adj e JOIN sg x ON x.n = e.u JOIN ap dx ON dx.s = x.s AND dx.n = x.n JOIN sg y ON y.s = e.v JOIN ap dy ON dy.s = y.s AND dy.n = y.n JOIN ap dz ON dz.s = x.s AND dz.n = y.n JOIN sg z ON z.s = x.s AND z.n = y.n WHERE dx.d + e.w + dy.d = dz.d AND x.s <> y.n GROUP BY 1, 2) SELECT least(u, v) AS u, greatest(u, v) AS v FROM b JOIN adj USING (u, v) GROUP BY 1, 2 ORDER BY sum(score) DESC, min(w), 1, 2 LIMIT 1")
def tr02_best_edge(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.operators.centrality import edge_betweenness

    e = kept(spark, d)
    return T.best_edge(e, edge_betweenness(e), 0.0).select("u", "v")


@query(f"{MST}, d AS (SELECT id FROM (SELECT u AS id FROM mst UNION ALL SELECT v FROM mst) GROUP BY id HAVING count(*) = 1) SELECT u, v, w FROM mst WHERE u IN (FROM d) OR v IN (FROM d)")
def tr04_sure_edges(spark: SparkSession, d: str) -> DataFrame:
    return T.sure_edges(written(T.minimum_spanning_tree(kept(spark, d)), "mst"))


@query(f"{MST} SELECT u, v, w FROM mst")
def tr05_finish_tree(spark: SparkSession, d: str) -> DataFrame:
    m = written(T.minimum_spanning_tree(kept(spark, d)), "mst")
    return T.finish_tree(m, m.where("u < 3"), 25)


@query(f"{MST} SELECT u, v, 0.5::DOUBLE AS w FROM mst")
def tr06_tree_of(spark: SparkSession, d: str) -> DataFrame:
    return T.tree_of(T.minimum_spanning_tree(kept(spark, d)), 0.5)


@query(Q.updated(3, 100))
def tr07_update_tree(spark: SparkSession, d: str) -> DataFrame:
    e = kept(spark, d)
    t = written(T.iterated_centrality_tree(e, "cluster_all", centers(spark), True), "ict")
    return picks(T.update_tree(e, t, centers(spark), cuts=3))


@query(Q.tree(Q.greedy("a", Q.NODES + 1)))
def tr08_exact_tree(spark: SparkSession, d: str) -> DataFrame:
    return picks(T.exact_tree(kept(spark, d)))


@query()
def tr09_flow_tree(spark: SparkSession, d: str) -> DataFrame:
    """Held against a brute force in the tests: SQL has no inverse."""
    return picks(T.exact_tree(kept(spark, d), scorer="flow", unit="m"))


@query(Q.tree(Q.merging("a")))
def tr10_merge_tree(spark: SparkSession, d: str) -> DataFrame:
    return picks(T.merge_tree(kept(spark, d)))


@query(Q.tree(Q.greedy("a", Q.NODES * (Q.NODES - 1) // 2 + 1)))
def tr11_dynamic_exact_tree(spark: SparkSession, d: str) -> DataFrame:
    return picks(T.exact_tree(kept(spark, d), dynamic=True, unit="m"))


@query(TREE25)
def tr12_approx_tree(spark: SparkSession, d: str) -> DataFrame:
    return shape(T.approx_tree(kept(spark, d), exact_below=10))


@query(Q.tree(Q.centroid("a", 0.0005)))
def tr13_centroid_tree(spark: SparkSession, d: str) -> DataFrame:
    return picks(T.centroid_tree(kept(spark, d), 0.0005))


@query(f"{GA} SELECT s AS id, round(avg(d), 6) AS far FROM ap GROUP BY s")
def tr14_centroid_order(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.operators.paths import apsp

    return r6(T.centroid_order(apsp(kept(spark, d))), "far")


@query(TREE25)
def tr15_rsp_tree(spark: SparkSession, d: str) -> DataFrame:
    return shape(T.rsp_tree(kept(spark, d)))


@query(f"{MST} SELECT u, v, w FROM mst")
def tr16_minimum_spanning_tree(spark: SparkSession, d: str) -> DataFrame:
    return T.minimum_spanning_tree(kept(spark, d))


@query(MST.replace("ORDER BY w, u, v", "ORDER BY w DESC, u, v") + " SELECT u, v, w FROM mst")
def tr17_maximum_spanning_tree(spark: SparkSession, d: str) -> DataFrame:
    return T.minimum_spanning_tree(kept(spark, d), largest=True)


@query(f"""WITH {M.PART_SQL}, n AS (SELECT u AS id FROM part_edges UNION SELECT v FROM part_edges),
best AS (SELECT id, min(w) AS w FROM (SELECT u AS id, w FROM part_edges UNION ALL SELECT v, w FROM part_edges) GROUP BY id)
SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM n) - 1 AS n_edges, 1::BIGINT AS n_components, (SELECT count(*) FROM best) AS holds_least""")
def tr16_parts_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree of the graph of parts and suppliers, which grows with the data; every node's least weight is on an edge of it."""
    e = written(M.part_supplier_edges(spark, d), "parts")
    t = written(T.minimum_spanning_tree(e), "mst")
    least = M.both_ways(e).groupBy("u").agg(F.min("w").alias("w"))
    held = M.both_ways(t).groupBy("u").agg(F.min("w").alias("w")).join(least, ["u", "w"]).agg(F.count("*").alias("holds_least"))
    return shape(t).crossJoin(held)  # one row each


@query("SELECT 2::BIGINT AS n_edges, 3::BIGINT AS n_nodes, 1::BIGINT AS n_components")
def tr18_representatives(spark: SparkSession, d: str) -> DataFrame:
    p, e = plane_knn(spark, d)
    return shape(T.representatives_tree(T.minimum_spanning_tree(e), p, some_centers(spark)))


@query("SELECT count(*) - 1 AS n_edges, count(*) AS n_nodes, 1::BIGINT AS n_components FROM embeddings")
def tr19_jitter_tree(spark: SparkSession, d: str) -> DataFrame:
    return shape(T.jitter_tree(M.plane_points(spark, d), 0.01))


@query("SELECT 14::BIGINT AS n_edges, 15::BIGINT AS n_nodes, 1::BIGINT AS n_components")
def tr20_subgraph_tree(spark: SparkSession, d: str) -> DataFrame:
    return shape(T.subgraph_tree(kept(spark, d), 0.6))


@query(TREE25)
def tr21_contraction_tree(spark: SparkSession, d: str) -> DataFrame:
    return shape(T.contraction_tree(kept(spark, d), 0.001))


@query(TREE25)
def tr22_ant_colony(spark: SparkSession, d: str) -> DataFrame:
    return shape(T.ant_colony(kept(spark, d), T.gilbert_steiner(0, 0.5)))


@query(TREE25)
def tr23_genetic(spark: SparkSession, d: str) -> DataFrame:
    return shape(T.genetic_search(kept(spark, d), T.centrality_cost(0.5)))


@query(f"{MST} SELECT u, v, w::DOUBLE AS w FROM mst")
def tr24_local_search(spark: SparkSession, d: str) -> DataFrame:
    """Under total weight the only tree that no swap helps is the least one, wherever the search begins."""
    e = kept(spark, d)
    star = [i for i, r in enumerate(e.orderBy("u", "v").select("u").collect()) if r.u == 0]  # 25 nodes
    return T.improved(e, star, T.centrality_cost(0.0))


@query("SELECT i AS tree, 24::BIGINT AS n_edges, 25::BIGINT AS n_nodes FROM range(8) t(i)")
def tr25_grown_trees(spark: SparkSession, d: str) -> DataFrame:
    t = written(T.grown(kept(spark, d), [0], 8), "grown")
    n = t.select("tree", F.explode(F.array("u", "v")).alias("id")).groupBy("tree").agg(F.countDistinct("id").alias("n_nodes"))
    return t.groupBy("tree").agg(F.count("*").alias("n_edges")).join(n, "tree")


@query(f"""{MST}, ta AS (SELECT u, v, w FROM mst UNION ALL SELECT v, u, w FROM mst),
far AS (WITH RECURSIVE r(a, b, w, n, f) AS (SELECT u, v, w, v, u FROM ta UNION ALL SELECT r.a, r.b, r.w, t.v, r.n FROM r JOIN ta t ON t.u = r.n WHERE t.v <> r.f) SELECT a, b, any_value(w) AS w, count(*) AS n, bool_or(n = 0) AS root FROM r GROUP BY ALL)
SELECT round(sum(w * sqrt(n)) FILTER (NOT root), 4) AS steiner, round(sum(w * sqrt(n * (25 - n))) FILTER (NOT root), 4) AS central FROM far""")
def tr26_tree_costs(spark: SparkSession, d: str) -> DataFrame:
    e = kept(spark, d)
    t = written(T.minimum_spanning_tree(e), "mst")
    a = T.tree_cost(e, t, T.gilbert_steiner(0, 0.5)).select(F.round("cost", 4).alias("steiner"))
    return a.crossJoin(T.tree_cost(e, t, T.centrality_cost(0.5)).select(F.round("cost", 4).alias("central")))  # one row each


# ---- 2.8 -----------------------------------------------------------------------------------------------------------------


@query("SELECT least(floor(sqrt((floor(log2(greatest(2, count(*) - 1))) + 1 + ln(10)) / 0.0009)), count(*))::BIGINT AS k FROM embeddings")
def cl01_representatives(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.lit(CL.representative_count(M.points(spark, d).count())).cast("long").alias("k"))


@query("SELECT 8::BIGINT AS centers, (SELECT count(*) FROM embeddings) AS labelled")
def cl02_k_means(spark: SparkSession, d: str) -> DataFrame:
    c, lab = CL.k_means(M.points(spark, d), 8)
    return c.agg(F.count("*").alias("centers")).crossJoin(lab.agg(F.count("*").alias("labelled")))  # one row each


@query("SELECT 4::BIGINT AS centers, 25::BIGINT AS labelled")
def cl03_graph_centers(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.operators.paths import apsp

    c, lab = CL.graph_centers(apsp(kept(spark, d)), 4)
    return c.agg(F.count("*").alias("centers")).crossJoin(lab.agg(F.count("*").alias("labelled")))


@query(f"WITH {PL}, m AS (SELECT label, [avg(pos[1]), avg(pos[2])] AS c FROM plane GROUP BY label), s AS (SELECT p.id, p.label, round(sum(list_distance(p.pos, m.c)), 9) AS s FROM plane p, m GROUP BY 1, 2) SELECT label, arg_max(id, (s, -id)) AS center_id FROM s GROUP BY label")
def cl04_farthest_members(spark: SparkSession, d: str) -> DataFrame:
    p = M.plane_points(spark, d)
    return CL.farthest_members(p, p)


@query(f"WITH {PL}, k AS (SELECT id, label FROM plane QUALIFY count(*) OVER (PARTITION BY label) >= 50) SELECT id AS old_id, row_number() OVER (ORDER BY id) - 1 AS id, dense_rank() OVER (ORDER BY label) - 1 AS label FROM k")
def cl05_filter(spark: SparkSession, d: str) -> DataFrame:
    return CL.filter_clusters(M.plane_points(spark, d), 50)


@query("SELECT (SELECT count(*) FROM embeddings) AS n, true AS large_enough")
def cl06_assign_small(spark: SparkSession, d: str) -> DataFrame:
    p = M.plane_points(spark, d)
    _, lab = CL.assign_small_clusters(p, p, 49)
    s = lab.groupBy("label").agg(F.count("*").alias("n"))
    return s.agg(F.sum("n").alias("n"), (F.min("n") > 49).alias("large_enough"))


@query("SELECT count(*) AS n, true AS has_labels FROM embeddings")
def cl07_tree_segments(spark: SparkSession, d: str) -> DataFrame:
    p, e = plane_knn(spark, d)
    _, lab = CL.tree_segments(T.minimum_spanning_tree(e), p, 5)
    return lab.agg(F.count("*").alias("n"), (F.countDistinct("label") > 1).alias("has_labels"))


@query("SELECT label, list_sort(list(vec_id)) AS ids FROM embeddings GROUP BY label")
def cl08_members(spark: SparkSession, d: str) -> DataFrame:
    return CL.members_of(M.plane_points(spark, d))


@query(f"WITH {P} SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, round(min(list_distance(a.pos, b.pos)), 6) AS d FROM points a, points b GROUP BY 1, 2")
def cl09_label_distances(spark: SparkSession, d: str) -> DataFrame:
    p = M.points(spark, d)
    return r6(CL.label_distances(p, p), "d")


# ---- 2.9 -----------------------------------------------------------------------------------------------------------------


@query("WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label::BIGINT AS label, n - 1 AS n_edges FROM s")
def pa01_sub_trees(spark: SparkSession, d: str) -> DataFrame:
    p = M.plane_points(spark, d)
    return PA.sub_trees(p, p.select("id", F.col("label").cast("long").alias("label")), 12).groupBy("label").agg(F.count("*").alias("n_edges"))


def forest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = written(M.plane_points(spark, d), "plane")
    return p, written(PA.sub_trees(p, p.select("id", F.col("label").cast("long").alias("label")), 12).select("u", "v", "w"), "forest")


@query("SELECT true AS holds_forest, true AS has_glue")
def pa02_patch(spark: SparkSession, d: str) -> DataFrame:
    p, f = forest(spark, d)
    g, glue, _ = PA.patch_forest(f, p, 1.5, 2.0)
    return f.join(g.select("u", "v"), ["u", "v"], "left_anti").agg((F.count("*") == 0).alias("holds_forest")).crossJoin(glue.agg((F.count("*") > 0).alias("has_glue")))


@query("SELECT true AS holds_forest, true AS has_sides")
def pa03_patch_boundaries(spark: SparkSession, d: str) -> DataFrame:
    p, f = forest(spark, d)
    g, sides, _ = PA.patch_boundaries(f, p, 1.5, 2.0)
    return f.join(g.select("u", "v"), ["u", "v"], "left_anti").agg((F.count("*") == 0).alias("holds_forest")).crossJoin(sides.agg((F.count("*") > 0).alias("has_sides")))


SEEDED = f"""{MST}, seeds AS (SELECT u, v FROM mst WHERE u < 5),
{Q.iterated("a", "SELECT u, v, w FROM nation_edges", "exact", seeds="seeds")}
SELECT u, v, step, round(score, 6) AS score FROM picksa WHERE step < 24 - (SELECT count(*) FROM seeds)"""


@query(SEEDED)
def pa04_fixed_patching(spark: SparkSession, d: str) -> DataFrame:
    """What is picked after the fixed edges."""
    e = kept(spark, d)
    seeds = written(T.minimum_spanning_tree(e).where("u < 5"), "seeds")
    t = picks(PA.patched_tree(e, seeds).where("not isnan(score) and score < double('infinity')"))
    return t.withColumn("step", F.col("step") - seeds.count())


FACTOR = "CASE WHEN mx > 0 THEN d / mx * 0.8 + 0.3 ELSE 1.0 END"


@query(f"""WITH {KNN}, nn AS (SELECT a.id, a.label AS c, arg_min(b.label, (list_distance(a.pos, b.pos), b.id)) AS o, min(list_distance(a.pos, b.pos)) AS d FROM points a JOIN points b ON a.label <> b.label GROUP BY 1, 2),
g AS (SELECT id, least(c, o) AS lo, greatest(c, o) AS hi FROM nn WHERE d <= (SELECT avg(w) FROM edges)),
c AS (SELECT lo, hi, list(m ORDER BY k) AS c FROM (SELECT lo, hi, k, avg(pos[k]) AS m FROM g JOIN points USING (id), range(1, 65) t(k) GROUP BY ALL) GROUP BY ALL),
e2 AS (SELECT id, lo, hi, list_distance(pos, c.c) AS d, max(list_distance(pos, c.c)) OVER (PARTITION BY lo, hi) AS mx FROM g JOIN points USING (id) JOIN c USING (lo, hi)),
f AS (SELECT id, lo, hi, {FACTOR} AS f FROM e2)
SELECT e.u, e.v, round(CASE WHEN a.lo = b.lo AND a.hi = b.hi THEN w * a.f * b.f ELSE w END, 6) AS w FROM edges e LEFT JOIN f a ON a.id = e.u LEFT JOIN f b ON b.id = e.v""")
def rw01_boundaries(spark: SparkSession, d: str) -> DataFrame:
    p = M.points(spark, d)
    return r6(PA.reweigh_boundaries(knn_edges(spark, d), p, p), "w")


@query(f"""WITH {KNN}, c AS (SELECT label, list(m ORDER BY k) AS c FROM (SELECT label, k, avg(pos[k]) AS m FROM points, range(1, 65) t(k) GROUP BY ALL) GROUP BY label),
e2 AS (SELECT id, label, list_distance(pos, c.c) AS d, max(list_distance(pos, c.c)) OVER (PARTITION BY label) AS mx FROM points JOIN c USING (label)), f AS (SELECT id, label, {FACTOR} AS f FROM e2)
SELECT e.u, e.v, round(CASE WHEN a.label = b.label THEN w * a.f * b.f ELSE w END, 6) AS w FROM edges e JOIN f a ON a.id = e.u JOIN f b ON b.id = e.v""")
def rw02_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = M.points(spark, d)
    return r6(PA.reweigh_clusters(knn_edges(spark, d), p, p), "w")


@query("SELECT count(*) AS n, true AS grew FROM embeddings")
def rw03_endpoints(spark: SparkSession, d: str) -> DataFrame:
    p, e = plane_knn(spark, d)
    t = written(T.minimum_spanning_tree(e), "mst")
    spine = PA.backbone(t).where("path = 0").select("id")
    w = PA.endpoint_weights(t, p, p.select("id", F.lit(1.0).alias("w")), spine)
    return w.agg(F.count("*").alias("n"), (F.max("w") > 1).alias("grew"))


BACKBONE = f"""{SIDES}, sc AS (SELECT a AS u, b AS v, far * (25 - far) AS s FROM sd),
top AS (SELECT u, v FROM sc WHERE u < v ORDER BY s DESC, u, v LIMIT 1),
wk AS (WITH RECURSIVE r(way, k, x, f) AS (SELECT 0, 0, u, v FROM top UNION ALL SELECT 1, 0, v, u FROM top UNION ALL
  SELECT way, k + 1, y, x FROM (SELECT r.way, r.k, r.x, sc.v AS y, row_number() OVER (PARTITION BY r.way, r.k ORDER BY sc.s DESC, sc.v) AS i FROM r JOIN sc ON sc.u = r.x AND sc.v <> r.f) WHERE i = 1) SELECT way, k, x FROM r)
SELECT row_number() OVER (ORDER BY CASE WHEN way = 0 THEN -k - 1 ELSE k END) - 1 AS place, x AS id FROM wk"""


@query(BACKBONE)
def bb01_backbone(spark: SparkSession, d: str) -> DataFrame:
    t = written(T.minimum_spanning_tree(kept(spark, d)), "mst")
    return PA.backbone(t).where("path = 0").select("place", "id")


@query(BACKBONE.rsplit("SELECT row_number()", 1)[0].rstrip() + """, lf AS (SELECT u AS id FROM ta GROUP BY u HAVING count(*) = 1)
SELECT x AS id, 'on' AS side FROM wk UNION ALL SELECT id, 'off' FROM lf WHERE id NOT IN (SELECT x FROM wk)""")
def bb02_split(spark: SparkSession, d: str) -> DataFrame:
    on, off = PA.split_backbone(written(T.minimum_spanning_tree(kept(spark, d)), "mst"), spark.range(25))
    return on.select("id", F.lit("on").alias("side")).unionByName(off.select("id", F.lit("off").alias("side")))


# ---- 2.10 ----------------------------------------------------------------------------------------------------------------


def _chain(spark: SparkSession, d: str, label: int) -> tuple[DataFrame, DataFrame]:
    """A path through one label's plane points in the order of ids."""
    from pyspark.sql import Window as W

    p = M.plane_points(spark, d).where(F.col("label") == label)
    nxt = F.lead("id").over(W.orderBy("id"))  # one label's few points
    return p, GR.weights_from_positions(p.withColumn("v", nxt).where("v is not null").select(F.col("id").alias("u"), "v"), p)


CHAIN = f"""WITH {PL}, pt AS (SELECT id, pos, label FROM plane WHERE label IN (1, 2)), ch AS (SELECT label, id AS u, lead(id) OVER w AS v, pos AS p, lead(pos) OVER w AS q FROM pt WINDOW w AS (PARTITION BY label ORDER BY id)), e AS (SELECT *, list_distance(p, q) AS w FROM ch WHERE v IS NOT NULL)"""


@query(f"{CHAIN}, m AS (SELECT pos, avg(w) AS mass FROM (SELECT u AS id, w FROM e WHERE label = 1 UNION ALL SELECT v, w FROM e WHERE label = 1) JOIN pt USING (id) GROUP BY id, pos UNION ALL SELECT [p[1] + (q[1] - p[1]) * (k / 4.0::DOUBLE), p[2] + (q[2] - p[2]) * (k / 4.0::DOUBLE)], w FROM e, range(1, 4) t(k) WHERE label = 1) SELECT round(pos[1], 6) AS x, round(pos[2], 6) AS y, round(mass, 6) AS mass FROM m")
def ot01_discretize(spark: SparkSession, d: str) -> DataFrame:
    p, t = _chain(spark, d, 1)
    return r6(OT.discretize(t, p, 5).select(F.col("pos")[0].alias("x"), F.col("pos")[1].alias("y"), "mass"), "x", "y", "mass")


@query(f"{CHAIN} SELECT u AS id, round(w / sum(w) OVER (), 9) AS mass FROM e WHERE label = 1")
def ot02_histogram(spark: SparkSession, d: str) -> DataFrame:
    _, t = _chain(spark, d, 1)
    return OT.histogram(t.select(F.col("u").alias("id"), F.col("w").alias("mass"))).withColumn("mass", F.round("mass", 9))


@query(f"{CHAIN} SELECT a.id AS i, b.id AS j, round(list_distance(a.pos, b.pos), 6) AS cost FROM pt a, pt b WHERE a.label = 1 AND b.label = 2")
def ot03_point_costs(spark: SparkSession, d: str) -> DataFrame:
    return r6(OT.point_costs(_chain(spark, d, 1)[0], _chain(spark, d, 2)[0]), "cost")


SEG = f"""{CHAIN}, s AS (SELECT a.u * 1000000 + a.v AS i, b.u * 1000000 + b.v AS j, a.p AS u1, a.q AS v1, list_distance(a.p, b.q) + list_distance(a.q, b.p) < list_distance(a.p, b.p) + list_distance(a.q, b.q) AS t, b.p, b.q FROM e a, e b WHERE a.label = 1 AND b.label = 2),
o AS (SELECT i, j, u1, v1, CASE WHEN t THEN q ELSE p END AS u2, CASE WHEN t THEN p ELSE q END AS v2 FROM s), z AS (SELECT i, j, v1[1]-v2[1] AS bx, v1[2]-v2[2] AS b_y, u1[1]-u2[1]-v1[1]+v2[1] AS ax, u1[2]-u2[2]-v1[2]+v2[2] AS ay FROM o)"""


@query(f"{SEG} SELECT i, j, round(sqrt(greatest(0.0, (ax*ax+ay*ay)/3 + ax*bx+ay*b_y + bx*bx+b_y*b_y)), 6) AS cost FROM z")
def ot05_edge_costs(spark: SparkSession, d: str) -> DataFrame:
    (p, t), (q, s) = _chain(spark, d, 1), _chain(spark, d, 2)
    return r6(OT.edge_costs(OT.tree_edges_located(t, p), OT.tree_edges_located(s, q)), "cost")


@query(f"{SEG} SELECT count(*) AS n, round(sum(sqrt(greatest(0.0, (ax*ax+ay*ay)/3 + ax*bx+ay*b_y + bx*bx+b_y*b_y))), 6) AS total FROM z")
def ot04_segment_distance(spark: SparkSession, d: str) -> DataFrame:
    (p, t), (q, s) = _chain(spark, d, 1), _chain(spark, d, 2)
    c = OT.edge_costs(OT.tree_edges_located(t, p), OT.tree_edges_located(s, q))
    return c.agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("total"))


def _hists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    (p, t), (q, s) = _chain(spark, d, 1), _chain(spark, d, 2)
    a, b = OT.tree_edges_located(t, p), OT.tree_edges_located(s, q)
    return written(OT.edge_costs(a, b), "costs"), written(OT.histogram(a.select("id", "mass")), "a"), written(OT.histogram(b.select("id", "mass")), "b")


def _edges_plan(spark: SparkSession, d: str) -> DataFrame:
    a, b = (OT.histogram(OT.tree_edges_located(t, p).select("id", F.concat("p", "q").alias("pos"), "mass")) for p, t in (_chain(spark, d, 1), _chain(spark, d, 2)))
    return OT.located_plan(a, b, OT.segment_distances)


@query("SELECT 1.0::DOUBLE AS mass, true AS positive")
def ot06_sinkhorn(spark: SparkSession, d: str) -> DataFrame:
    c, a, b = _hists(spark, d)
    plan = OT.earth_mover(c, a, b, 0.5, 5)
    return plan.agg(F.round(F.sum("flow"), 6).alias("mass"), (F.sum(F.col("flow") * F.col("cost")) > 0).alias("positive"))


@query("SELECT 1.0::DOUBLE AS mass, true AS positive")
def ot07_exact_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges_plan(spark, d).agg(F.round(F.sum("flow"), 6).alias("mass"), (F.sum(F.col("flow") * F.col("cost")) > 0).alias("positive"))


@query("SELECT 2000.0::DOUBLE AS total")
def ot08_flow_graph(spark: SparkSession, d: str) -> DataFrame:
    return OT.flow_graph(_edges_plan(spark, d)).agg(F.round(F.sum("w"), 3).alias("total"))


@query("""WITH x AS (SELECT embedding[1]::DOUBLE AS x, label FROM embeddings WHERE label IN (1, 2)), m AS (SELECT x, CASE WHEN label = 1 THEN 1.0 ELSE -1.0 END / count(*) OVER (PARTITION BY label) AS m FROM x),
f AS (SELECT x, sum(m) OVER (ORDER BY x) AS gap, lead(x) OVER (ORDER BY x) - x AS step FROM (SELECT x, sum(m) AS m FROM m GROUP BY x)) SELECT round(sum(abs(gap) * step), 6) AS distance FROM f""")
def ot07_exact_line(spark: SparkSession, d: str) -> DataFrame:
    """On a line the least cost is the area between the two distribution functions: the exact plan must cost as much."""
    p = M.points(spark, d).select("id", F.slice("pos", 1, 1).alias("pos"), "label")
    a, b = (written(p.where(F.col("label") == k).withColumn("mass", 1.0 / F.count("*").over(W.partitionBy("label"))), "cloud") for k in (1, 2))
    return OT.transport_cost(OT.located_plan(a, b)).select(F.round("distance", 6).alias("distance"))


# ---- 2.11 ----------------------------------------------------------------------------------------------------------------


@query(f"WITH {P}, e AS (SELECT id, k, pos[k] AS x FROM points, range(1, 65) t(k)), s AS (SELECT k, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY k) SELECT id, (k - 1)::INT AS k, round((x - m) / s, 6) AS z FROM e JOIN s USING (k)")
def fe01_standardize(spark: SparkSession, d: str) -> DataFrame:
    return FI.standardize(M.points(spark, d)).select("id", F.posexplode("pos").alias("k", "z")).select("id", "k", F.round("z", 6).alias("z"))


@query("SELECT count(*) AS n, 5 AS dims FROM embeddings")
def fe02_pca(spark: SparkSession, d: str) -> DataFrame:
    return FI.pca(M.points(spark, d), 5).agg(F.count("*").alias("n"), F.max(F.size("pos")).alias("dims"))


@query(f"WITH {P} SELECT round(avg(m), 6) AS mean_nn FROM (SELECT min(list_distance(a.pos, b.pos)) AS m FROM points a JOIN points b ON list_distance(a.pos, b.pos) > 0 GROUP BY a.id)")
def fe04_nearest_mean(spark: SparkSession, d: str) -> DataFrame:
    return r6(FI.mean_neighbour_distance(M.points(spark, d)), "mean_nn")


GRID = f"{PL}, b AS (SELECT min(pos[1]) AS x0, max(pos[1]) AS x1, min(pos[2]) AS y0, max(pos[2]) AS y1, 0.05 * (2 / sqrt(2)) * 0.9 AS a FROM plane), g AS (SELECT i * (ceil((y1 - y0) / a)::BIGINT + 1) + j AS id, [x0 + a * i, y0 + a * j] AS pos FROM b, range(1000) s(i), range(1000) t(j) WHERE i <= ceil((x1 - x0) / a) AND j <= ceil((y1 - y0) / a))"


@query(f"WITH {GRID} SELECT id, round(pos[1], 6) AS x, round(pos[2], 6) AS y FROM g")
def fe05_grid(spark: SparkSession, d: str) -> DataFrame:
    g = FI.grid(M.plane_points(spark, d), 0.05)
    return r6(g.select("id", F.col("pos")[0].alias("x"), F.col("pos")[1].alias("y")), "x", "y")


@query(f"WITH {GRID} SELECT g.id, count(p.id) AS n FROM g LEFT JOIN plane p ON list_distance(g.pos, p.pos) < 0.1 GROUP BY g.id")
def fe06_sphere_density(spark: SparkSession, d: str) -> DataFrame:
    p = M.plane_points(spark, d)
    return FI.sphere_density(written(FI.grid(p, 0.05), "grid"), p, 0.1)


@query(f"WITH {GRID} SELECT g.id, round(sum(exp(-50 * pow(list_distance(g.pos, p.pos), 2))), 6) AS density FROM g, plane p GROUP BY g.id")
def fe07_gauss_density(spark: SparkSession, d: str) -> DataFrame:
    p = M.plane_points(spark, d)
    return r6(FI.gauss_density(written(FI.grid(p, 0.05), "grid"), p, 50.0), "density")


@query("SELECT p_partkey AS id, (p_retailprice >= 950)::INT + (p_retailprice >= 1000)::INT AS level, round(pow(p_retailprice, 0.65), 6) AS powered FROM part")
def fe08_quantize(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), FI.quantize(F.col("p_retailprice"), [950.0, 1000.0]).alias("level"), F.round(F.pow("p_retailprice", F.lit(0.65)), 6).alias("powered"))


@query("SELECT 1 AS layer, 4::BIGINT AS n UNION ALL SELECT 2, 4 UNION ALL SELECT 3, 1")
def fe09_medial_axis(spark: SparkSession, d: str) -> DataFrame:
    """A square of five by five: its corners in each layer, then the middle."""
    px = spark.range(25).select(F.floor(F.col("id") / 5).alias("i"), (F.col("id") % 5).alias("j"), F.lit(True).alias("val"))
    return FI.medial_axis(px).groupBy("layer").agg(F.count("*").alias("n"))


@query(f"WITH {PL} SELECT round(stddev_pop(w), 6) AS sd, round(avg(w), 6) AS mean, round(avg((w <= 0.2)::INT), 6) AS share FROM (SELECT list_distance(a.pos, b.pos) AS w FROM plane a JOIN plane b ON a.id < b.id)")
def fe11_statistics(spark: SparkSession, d: str) -> DataFrame:
    return D.pairwise(M.plane_points(spark, d)).agg(F.round(F.stddev_pop("w"), 6).alias("sd"), F.round(F.avg("w"), 6).alias("mean"), F.round(F.avg((F.col("w") <= 0.2).cast("int")), 6).alias("share"))


@query("SELECT label, min(vec_id) AS first_id, row_number() OVER (ORDER BY min(vec_id)) - 1 AS place FROM embeddings GROUP BY label")
def fe12_first_appearance(spark: SparkSession, d: str) -> DataFrame:
    return FI.first_appearance(M.points(spark, d))


@query("SELECT event_id, round(CASE WHEN p > 4 THEN 8 - p ELSE p END, 6) AS x FROM (SELECT event_id, (((value + event_id * 0.37) % 8) + 8) % 8 AS p FROM events)")
def dy01_bounce(spark: SparkSession, d: str) -> DataFrame:
    return r6(load(spark, d, "events").select("event_id", FI.bounce(F.col("value"), F.lit(0.37), F.col("event_id"), 4.0).alias("x")), "x")


@query("SELECT (SELECT count(*) FROM embeddings) AS n, true AS moved")
def dy02_langevin(spark: SparkSession, d: str) -> DataFrame:
    p = M.plane_points(spark, d)
    j = FI.langevin(p).select("id", F.col("pos").alias("q")).join(p, "id")
    return j.agg(F.count("*").alias("n"), (F.max(D.euclid("pos", "q")) > 0).alias("moved"))


@query("SELECT 100::BIGINT AS n, true AS inside")
def dy03_move(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.sources.generators import create_points

    q = FI.move(create_points(spark, 100, "uniform"), "uniform", 13.0)
    return q.agg(F.count("*").alias("n"), F.min(F.col("pos")[0].between(0, 4) & F.col("pos")[1].between(0, 1)).alias("inside"))


# ---- 2.13 ----------------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    kind = F.when(F.col("event_id") % 11 == 0, "remove").when(F.col("event_id") % 3 == 0, "increment").otherwise("add")
    return e.select(F.col("event_id").alias("seq"), kind.alias("type"), (F.col("user_id") % 40).alias("u"), (F.col("event_id") % 37 + 40).alias("v"), F.col("value").alias("w"))


EVENTS = """ev AS (SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'remove' WHEN event_id % 3 = 0 THEN 'increment' ELSE 'add' END AS type, user_id % 40 AS u, event_id % 37 + 40 AS v, value AS w FROM events),
l AS (SELECT u, v, max(seq) AS aq, arg_max(type, seq) AS t, arg_max(w, seq) AS w FROM ev WHERE type <> 'increment' GROUP BY u, v),
i AS (SELECT e.u, e.v, sum(e.w) AS more FROM ev e LEFT JOIN l USING (u, v) WHERE type = 'increment' AND (aq IS NULL OR seq > aq) GROUP BY 1, 2),
st AS (SELECT coalesce(l.u, i.u) AS u, coalesce(l.v, i.v) AS v, CASE WHEN t <> 'remove' THEN w END AS b, more FROM l FULL JOIN i ON l.u = i.u AND l.v = i.v)"""


@query(f"WITH {EVENTS} SELECT u, v, round(coalesce(b, 0) + coalesce(more, 0), 4) AS w FROM st WHERE b IS NOT NULL OR more IS NOT NULL")
def st02_batch_update(spark: SparkSession, d: str) -> DataFrame:
    return ST.apply_events(ST.empty_edges(spark), _events(spark, d)).select("u", "v", F.round("w", 4).alias("w"))


@query(f"WITH {EVENTS} SELECT u, v, round(coalesce(b, 0) + coalesce(more, 0), 4) AS w FROM st WHERE b IS NOT NULL OR more IS NOT NULL")
def st01_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same events as a stream of three files in their order."""
    folder, e = scratch_path(spark, "events"), written(_events(spark, d), "events")
    n = e.agg(F.max("seq")).first()[0] + 1
    for k in range(3):
        e.where(F.floor(F.col("seq") * 3 / n) == k).coalesce(1).write.mode("append").parquet(folder)
    s = ST.GraphState(spark)
    s.replay(folder)
    return s.edges.select("u", "v", F.round("w", 4).alias("w"))


@query(f"{GA} SELECT a.s AS source, a.n AS id, least(a.d, x.d + 100 + y.d, p.d + 100 + q.d)::DOUBLE AS dist FROM ap a JOIN ap x ON x.s = a.s AND x.n = 3 JOIN ap y ON y.s = 17 AND y.n = a.n JOIN ap p ON p.s = a.s AND p.n = 17 JOIN ap q ON q.s = 3 AND q.n = a.n")
def st03_distance_state(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.operators.paths import apsp

    s = ST.DistanceState(apsp(kept(spark, d)))
    s.decrease(3, 17, 100.0)
    return s.dist


@query(f"WITH {EVENTS}, e AS (SELECT u, v FROM st WHERE b IS NOT NULL OR more IS NOT NULL), a AS (SELECT u AS id FROM e UNION ALL SELECT v FROM e) SELECT id, count(*) AS degree FROM a GROUP BY id")
def st02_measure_after_events(spark: SparkSession, d: str) -> DataFrame:
    """A measure kept up to date: replay and recompute agree."""
    s = ST.GraphState(spark, measure=GR.degrees)
    e = written(_events(spark, d), "events")
    s.update(e)
    return s.scores


@query("SELECT 100::BIGINT AS n, true AS inside")
def st04_motion(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.sources.generators import create_points

    ticks = create_points(spark, 100, "uniform").withColumn("t", (F.col("id") % 5).cast("double"))
    return ST.motion(ticks).agg(F.count("*").alias("n"), F.min(F.col("pos")[0].between(0, 4)).alias("inside"))
