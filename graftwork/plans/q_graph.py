"""Queries for sources, sinks, graph construction and edge primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graftwork import model as M
from graftwork.operators import construct as C
from graftwork.operators import distance as D
from graftwork.operators import graph as G
from graftwork.session import load, written

QUERIES, ORACLES = {}, {}
P, N, PL = M.POINTS_SQL, M.NATION_SQL, M.PLANE_SQL
KNN = f"""{P}, knn AS (SELECT a.id AS u, b.id AS v, list_distance(a.pos, b.pos) AS w,
  row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.pos, b.pos), b.id) AS rank FROM points a JOIN points b ON a.id <> b.id QUALIFY rank <= 11),
edges AS (SELECT least(u, v) AS u, greatest(u, v) AS v, min(w) AS w FROM knn GROUP BY 1, 2)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return written(C.knn_union(M.points(spark, d), 11), "knn11")


@query(f"WITH {KNN}, adj AS (SELECT u FROM edges UNION ALL SELECT v FROM edges) SELECT u AS id, count(*) AS degree, round((SELECT avg(w) FROM edges), 6) AS mean_w FROM adj GROUP BY u")
def m0_knn_degree(spark: SparkSession, d: str) -> DataFrame:
    e = knn_edges(spark, d)
    return r6(G.degrees(e).crossJoin(F.broadcast(e.agg(F.avg("w").alias("mean_w")))), "mean_w")  # one row


# ---- 2.1 sources -------------------------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS n FROM documents WHERE n_chars <= 1500 AND lang IN ('en', 'de', 'fr') GROUP BY 1")
def src04_row_filter(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents").where((F.col("n_chars") <= 1500) & F.col("lang").isin("en", "de", "fr"))
    return t.groupBy("lang").agg(F.count("*").alias("n"))


@query(f"WITH {P} SELECT id, label, round(pos[1], 6) AS x FROM points WHERE label IN (1, 3, 5, 7)")
def src01_dataset_registry(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.sources.datasets import Registry

    reg = Registry()
    reg.add("full", lambda: M.points(spark, d))
    reg.add("reduced", lambda: M.points(spark, d).where(F.col("label").isin(1, 3, 5, 7)))
    return reg.load("reduced").select("id", "label", F.round(F.col("pos")[0], 6).alias("x"))


@query("SELECT vec_id AS id, label FROM embeddings")
def src02_csv_scan(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.session import scratch_path
    from graftwork.sources.datasets import read_matrix_csv, read_obs_csv, write_matrix_csv

    p = M.points(spark, d)
    obs, mat = scratch_path(spark, "obs"), scratch_path(spark, "matrix")
    p.select("id", "label").write.option("header", True).csv(obs)
    write_matrix_csv(p, mat)
    return read_obs_csv(spark, obs, "id long, label int").join(read_matrix_csv(spark, mat).select("id"), "id")


@query("SELECT label FROM embeddings")
def src03_projection(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("label")


@query(f"WITH {P}, m AS (SELECT row_number() OVER (ORDER BY id) - 1 AS ord, id FROM points) SELECT m.ord, m.id, round(p.pos[2], 6) AS y FROM m JOIN points p USING (id)")
def src05_gather(spark: SparkSession, d: str) -> DataFrame:
    p = M.points(spark, d)
    m = p.select("id")
    m = m.withColumn("ord", (F.row_number().over(W.orderBy("id")) - 1).cast("long"))
    return m.join(p, "id").select("ord", "id", F.round(F.col("pos")[1], 6).alias("y"))


@query("SELECT vec_id AS id, label FROM embeddings")
def src06_cached_points(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.session import scratch_path
    from graftwork.sources.datasets import read_or_compute

    path = scratch_path(spark, "cache")
    read_or_compute(spark, path, lambda: M.points(spark, d))
    return read_or_compute(spark, path, lambda: 1 / 0).select("id", "label")


@query(f"WITH {N} SELECT u, v, w::DOUBLE AS w FROM nation_edges")
def src07_edge_list_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.session import scratch_path
    from graftwork.sources.edgelists import read_edge_list, write_edge_list

    path = scratch_path(spark, "tab-one")
    write_edge_list(M.nation_edges(spark, d), path, sep="\t", base=1)
    return read_edge_list(spark, path, sep="\t", base=1)


@query(f"WITH {N} SELECT u, v, w::DOUBLE AS w FROM nation_edges")
def src08_space_edge_list(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.session import scratch_path
    from graftwork.sources.edgelists import graph_path, load_graph, save_graph

    folder = scratch_path(spark, "graphs")
    save_graph(M.nation_edges(spark, d), folder, n=25, mode="trade", seed=1)
    assert graph_path(folder, n=25, mode="trade", seed=1).startswith(folder)
    return load_graph(spark, folder, n=25, mode="trade", seed=1)


@query("SELECT (a.i * 4.0 / 9) AS x, (b.i * 1.0 / 9) AS y FROM range(10) a(i), range(10) b(i)")
def src12_meshgrid(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.sources.generators import create_points

    return create_points(spark, 100, "meshgrid").select(F.col("pos")[0].alias("x"), F.col("pos")[1].alias("y"))


def _by_cloud(spark: SparkSession, kinds: list[str], n: int) -> DataFrame:
    from graftwork.sources.generators import create_points

    out = None
    for k in kinds:
        p = create_points(spark, n, k).withColumn("kind", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out


@query("SELECT * FROM (VALUES ('circle', 400::BIGINT), ('gauss', 400::BIGINT), ('line', 400::BIGINT), ('uniform', 400::BIGINT)) t(kind, n)")
def src12_random_points(spark: SparkSession, d: str) -> DataFrame:
    p = _by_cloud(spark, ["gauss", "uniform", "circle", "line"], 400)
    x, y = F.col("pos")[0], F.col("pos")[1]
    ok = F.when(F.col("kind") == "uniform", x.between(0, 4) & y.between(0, 1)).when(F.col("kind") == "circle", F.abs(F.sqrt(x * x + y * y) - 3.8) < 1e-9).when(F.col("kind") == "line", y == 1).otherwise(F.lit(True))
    return p.where(ok).groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE t(lv, x, y) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT lv + 1, x + sx / pow(2, lv + 1), y + sy / pow(2, lv + 1) FROM t, (VALUES (1),(-1)) a(sx), (VALUES (1),(-1)) b(sy) WHERE lv < 3)
SELECT round(x, 6) AS x, round(y, 6) AS y, count(*) AS n FROM t GROUP BY ALL""")
def src13_space_filling_tree(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.sources.generators import space_filling_tree

    p = space_filling_tree(spark, 3)
    return p.groupBy(F.round(F.col("pos")[0], 6).alias("x"), F.round(F.col("pos")[1], 6).alias("y")).agg(F.count("*").alias("n"))


@query("SELECT b AS branch, 250::BIGINT AS n FROM range(3) t(b)")
def src15_branching_points(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.sources.generators import branching

    return branching(spark, 3, 250, 2, seed=37).groupBy("branch").agg(F.count("*").alias("n"))


@query("SELECT 930::BIGINT AS n, 5::BIGINT AS slabs")
def src16_serpentines(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.sources.generators import serpentines

    return serpentines(spark).agg(F.count("*").alias("n"), F.countDistinct("slab").alias("slabs"))


@query()
def src17_microstructure(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.sources.generators import microstructure

    return microstructure(spark, 32)


@query("SELECT i, j, (0.2989 * (i * 8 % 256) + 0.5870 * (j * 8 % 256) + 0.1140 * 0 > 0) AS val FROM range(16) a(i), range(16) b(j)")
def src10_image_mask(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.sources.generators import luma_mask

    rgb = spark.range(256).select(F.floor(F.col("id") / 16).cast("long").alias("i"), (F.col("id") % 16).alias("j"))
    return luma_mask(rgb.select("i", "j", (F.col("i") * 8 % 256).alias("r"), (F.col("j") * 8 % 256).alias("g"), F.lit(0).alias("b")))


@query("SELECT 40::BIGINT AS n, 40::BIGINT AS distinct_n, true AS inside")
def src11_sample_mask(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.sources.generators import sample_mask

    px = spark.range(400).select(F.floor(F.col("id") / 20).cast("int").alias("i"), (F.col("id") % 20).cast("int").alias("j")).withColumn("val", (F.col("i") + F.col("j")) % 3 == 0)
    s = sample_mask(px, 40, seed=42)
    return s.agg(F.count("*").alias("n"), F.countDistinct("i", "j").alias("distinct_n"), F.min((F.col("i") + F.col("j")) % 3 == 0).alias("inside"))


@query("SELECT 200::BIGINT AS n, true AS inside")
def src14_default_points(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.sources.generators import create_points

    p = create_points(spark, 200, "uniform", seed=7)
    return p.agg(F.count("*").alias("n"), F.min(F.col("pos")[0].between(0, 4) & F.col("pos")[1].between(0, 1)).alias("inside"))


@query(f"WITH {KNN} SELECT 'knn' AS mode, u, v, round(w, 6) AS w FROM knn WHERE u < v AND rank <= 10 UNION ALL SELECT 'complete', a.id, b.id, round(list_distance(a.pos, b.pos), 6) FROM points a, points b WHERE a.id < b.id")
def src18_create_graph(spark: SparkSession, d: str) -> DataFrame:
    """Graphs by the names of their modes, over whole vectors."""
    p = M.points(spark, d)
    modes = [C.create_graph(p, m, k=10).select(F.lit(m).alias("mode"), "u", "v", "w") for m in ("knn", "complete")]
    return r6(modes[0].unionByName(modes[1]), "w")


# ---- 2.2 sinks ---------------------------------------------------------------------------------------------------


@query("SELECT vec_id AS id, label FROM embeddings")
def snk03_positions(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.session import scratch_path
    from graftwork.sources.edgelists import load_points, save_points

    folder = scratch_path(spark, "points")
    save_points(M.points(spark, d), folder, n=500, mode="all", seed=1)
    return load_points(spark, folder, n=500, mode="all", seed=1).select("id", "label")


@query(f"WITH {P}, e AS (SELECT unnest(range(1, len(pos) + 1)) AS dim, unnest(pos) AS x FROM points) SELECT dim, round(min(x) - 0.1 * (max(x) - min(x)), 6) AS lo, round(max(x) + 0.1 * (max(x) - min(x)), 6) AS hi FROM e GROUP BY dim")
def snk06_extents(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.functions.fields import extents

    return r6(extents(M.points(spark, d)).withColumn("dim", F.col("dim").cast("long")), "lo", "hi")


@query(f"WITH {KNN}, b AS (SELECT floor(w / 0.05)::BIGINT AS bin FROM edges) SELECT bin, count(*) AS n FROM b GROUP BY bin")
def snk08_histogram(spark: SparkSession, d: str) -> DataFrame:
    return knn_edges(spark, d).groupBy(F.floor(F.col("w") / 0.05).alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {P} SELECT label, min(id) AS first_id, dense_rank() OVER (ORDER BY min(id)) - 1 AS place FROM points GROUP BY label")
def snk05_label_order(spark: SparkSession, d: str) -> DataFrame:
    from graftwork.functions.fields import first_appearance

    return first_appearance(M.points(spark, d))


# ---- 2.3 construction --------------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT count(*) AS n, round(sum(w), 4) AS total FROM (SELECT list_distance(a.pos, b.pos) AS w FROM points a JOIN points b ON a.id < b.id)")
def gc01_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return D.pairwise(M.points(spark, d)).agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("total"))


@query(f"WITH {PL} SELECT a.id AS u, b.id AS v, round(list_distance(a.pos, b.pos), 6) AS w FROM plane a JOIN plane b ON a.id < b.id")
def gc02_complete(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.complete(M.plane_points(spark, d)), "w")


@query(f"WITH {PL} SELECT a.id AS u, b.id AS v, round(exp(2 * list_distance(a.pos, b.pos)) - 1, 6) AS w FROM plane a JOIN plane b ON a.id < b.id")
def gc03_complete_exp(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.complete(M.plane_points(spark, d), 2.0), "w")


@query(f"WITH {KNN} SELECT u, v, round(w, 6) AS w, rank::INT AS rank FROM knn")
def gc04_knn_directed(spark: SparkSession, d: str) -> DataFrame:
    return r6(D.knn(M.points(spark, d), 11), "w")


@query(f"WITH {KNN} SELECT u, v, round(w, 6) AS w FROM edges")
def gc05_knn_union(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.knn_union(M.points(spark, d), 11), "w")


@query(f"WITH {KNN} SELECT u, v, round(w, 6) AS w FROM knn WHERE u < v AND rank <= 10")
def gc06_knn_forward(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.knn_forward(M.points(spark, d), 10), "w")


@query(f"WITH {P} SELECT a.id AS u, b.id AS v, round(list_distance(a.pos, b.pos), 6) AS w FROM points a, points b QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.pos, b.pos), b.id) <= 5")
def gc07_knn_with_self(spark: SparkSession, d: str) -> DataFrame:
    return r6(D.knn(M.points(spark, d), 5, include_self=True).select("u", "v", "w"), "w")


@query()
def gc08_delaunay(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.delaunay(M.plane_points(spark, d)), "w")


@query(f"""WITH RECURSIVE {P}, knn AS (SELECT a.id AS u, b.id AS v, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.pos, b.pos), b.id) AS rank FROM points a JOIN points b ON a.id <> b.id QUALIFY rank <= 16),
both_ AS (SELECT u, v, rank FROM knn UNION ALL SELECT v, u, rank FROM knn), r(k, n) AS (SELECT k, (SELECT min(id) FROM points) FROM range(8, 17) t(k) UNION SELECT r.k, e.v FROM r JOIN both_ e ON e.u = r.n AND e.rank <= r.k),
least_ AS (SELECT min(k) AS k FROM (SELECT k FROM r GROUP BY k HAVING count(*) = (SELECT count(*) FROM points))) SELECT floor(1.33 * k)::BIGINT + 1 AS k FROM least_""")
def gc09_smallest_k(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.lit(C.smallest_connecting_k(M.points(spark, d))).cast("long").alias("k"))


@query(f"WITH {KNN} SELECT u, v, round(w, 6) AS w FROM edges")
def gc10_knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.knn_graph(M.points(spark, d))[0], "w")


@query(f"""WITH {PL}, x AS (SELECT a.label::BIGINT AS c, a.id AS u, b.id AS v, list_distance(a.pos, b.pos) AS w FROM plane a JOIN plane b ON a.label <> b.label)
SELECT c, u, v, round(w, 6) AS w FROM x QUALIFY row_number() OVER (PARTITION BY c ORDER BY x.w, u, v) <= 3""")
def gc11_patch(spark: SparkSession, d: str) -> DataFrame:
    """What one pass adds where each label is a component."""
    return r6(C.cross_pairs(M.plane_points(spark, d).select("id", "pos", F.col("label").cast("long").alias("c")), 3), "w")


@query("SELECT 1 AS connected")
def gc11_patched(spark: SparkSession, d: str) -> DataFrame:
    """All passes, from a graph of labels' chains."""
    p = M.plane_points(spark, d)
    nxt = F.lead("id").over(W.partitionBy("label").orderBy("id"))
    chain = written(p.withColumn("v", nxt).where("v is not null").select(F.col("id").alias("u"), "v", F.lit(0.0).alias("w")), "chain")
    return spark.range(1).select(F.lit(int(G.is_connected(C.patch(chain, p, 3), p))).alias("connected"))


DENS = f"""{KNN}, m AS (SELECT avg(w) AS m FROM edges), near AS (SELECT a.id AS u, b.id AS v FROM points a, points b, m WHERE list_distance(a.pos, b.pos) <= {{beta}} * m)"""


@query(f"WITH {DENS.format(beta=1)}, n AS (SELECT u AS id, pow(count(*), 2) AS s FROM near GROUP BY u) SELECT e.u, e.v, round(e.w / (a.s * b.s), 9) AS w FROM edges e JOIN n a ON a.id = e.u JOIN n b ON b.id = e.v")
def gc12_density_one(spark: SparkSession, d: str) -> DataFrame:
    return C.density_one(knn_edges(spark, d), M.points(spark, d), 1.0, 2.0).withColumn("w", F.round("w", 9))


@query(f"""WITH {DENS.format(beta=1)}, n AS (SELECT u AS id, count(*) AS n FROM near GROUP BY u),
b AS (SELECT e.u, e.v, count(y.v) AS k FROM edges e LEFT JOIN near x ON x.u = e.u LEFT JOIN near y ON y.u = e.v AND y.v = x.v GROUP BY 1, 2)
SELECT e.u, e.v, round(e.w * pow((p.n - k + 1) * (q.n - k + 1)::DOUBLE / ((k + 1) * (k + 1)), 0.5), 6) AS w FROM edges e JOIN b USING (u, v) JOIN n p ON p.id = e.u JOIN n q ON q.id = e.v""")
def gc13_density_two(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.density_two(knn_edges(spark, d), M.points(spark, d), 1.0, 0.5), "w")


def _first8(spark: SparkSession, d: str) -> DataFrame:
    return M.points(spark, d).select("id", F.slice("pos", 1, 8).alias("pos"))


def _pca_sql(knn: str, base: str, space: str) -> str:
    """SQL of the four modes, with the first eight components as the reduced space."""
    col = {"full": "pos", "red": "pos[1:8]"}
    return f"""WITH {P}, k AS (SELECT a.id AS u, b.id AS v FROM points a JOIN points b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.{col[knn]}, b.{col[knn]}), b.id) <= 6),
e AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM k), edges AS (SELECT e.u, e.v, list_distance(a.{col[base]}, b.{col[base]}) AS w FROM e JOIN points a ON a.id = e.u JOIN points b ON b.id = e.v), m AS (SELECT avg(w) AS m FROM edges),
near AS (SELECT a.id AS u, b.id AS v FROM points a, points b, m WHERE list_distance(a.{col[space]}, b.{col[space]}) <= m), n AS (SELECT u AS id, count(*) AS n FROM near GROUP BY u),
b AS (SELECT e.u, e.v, count(y.v) AS k FROM edges e LEFT JOIN near x ON x.u = e.u LEFT JOIN near y ON y.u = e.v AND y.v = x.v GROUP BY 1, 2)
SELECT e.u, e.v, round(e.w * pow((p.n - k + 1) * (q.n - k + 1)::DOUBLE / ((k + 1) * (k + 1)), 0.5), 6) AS w FROM edges e JOIN b USING (u, v) JOIN n p ON p.id = e.u JOIN n q ON q.id = e.v"""


@query(_pca_sql("red", "full", "full"))
def gc14_pca_knn_only(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.pca_graph(M.points(spark, d), _first8(spark, d), "PCA-k-nearest-only", 6, 1.0), "w")


@query(_pca_sql("full", "red", "red"))
def gc15_pca_distance_only(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.pca_graph(M.points(spark, d), _first8(spark, d), "PCA-distance-only", 6, 1.0), "w")


@query(_pca_sql("red", "red", "red"))
def gc16_pca_density_only(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.pca_graph(M.points(spark, d), _first8(spark, d), "PCA-density-only", 6, 1.0), "w")


@query(_pca_sql("red", "red", "red"))
def gc17_pca_full(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.pca_graph(M.points(spark, d), _first8(spark, d), "PCA", 6, 1.0), "w")


def _scaled_pca(spark: SparkSession, d: str, mode: str) -> DataFrame:
    """Scaling, PCA of the whole vectors and the graph, as the survey chains them; SQL can't say it."""
    from graftwork.functions import fields as FI

    return r6(C.pca_graph(*FI.scaled_and_reduced(M.points(spark, d)), mode, 6, 1.0), "w")


@query()
def gc14_scaled_pca_knn_only(spark: SparkSession, d: str) -> DataFrame:
    return _scaled_pca(spark, d, "PCA-k-nearest-only")


@query()
def gc15_scaled_pca_distance_only(spark: SparkSession, d: str) -> DataFrame:
    return _scaled_pca(spark, d, "PCA-distance-only")


@query()
def gc16_scaled_pca_density_only(spark: SparkSession, d: str) -> DataFrame:
    return _scaled_pca(spark, d, "PCA-density-only")


@query()
def gc17_scaled_pca_full(spark: SparkSession, d: str) -> DataFrame:
    return _scaled_pca(spark, d, "PCA")


@query(f"""WITH {PL}, pr AS (SELECT a.id AS u, b.id AS v, list_distance(a.pos, b.pos) AS w FROM plane a, plane b), m AS (SELECT 0.5 * avg(w) AS m FROM pr WHERE u < v),
n AS (SELECT u AS id, pow(count(*), 2) AS s FROM pr, m WHERE w <= m GROUP BY u), x AS (SELECT pr.u, pr.v, w / (a.s * b.s) AS w FROM pr JOIN n a ON a.id = pr.u JOIN n b ON b.id = pr.v WHERE pr.u <> pr.v),
k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY u ORDER BY w, v) <= 5) SELECT least(u, v) AS u, greatest(u, v) AS v, round(min(w), 9) AS w FROM k GROUP BY 1, 2""")
def gc18_recompute(spark: SparkSession, d: str) -> DataFrame:
    return C.recompute(M.plane_points(spark, d), 5, "density1", 0.5, 2.0).withColumn("w", F.round("w", 9))


@query(f"WITH {KNN}, t AS (SELECT *, ln(2) / (sqrt(2) - 1) AS th FROM edges) SELECT u, v, round(CASE WHEN w < th THEN exp(w) - 1 ELSE (exp(th) - 1) / (th * th) * w * w END, 6) AS w FROM t")
def gc19_break_triangles(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.break_triangles(knn_edges(spark, d)), "w")


@query(f"""WITH {PL}, l AS (SELECT label AS component, id, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS local FROM plane)
SELECT a.id AS u, b.id AS v, round(list_distance(p.pos, q.pos), 6) AS w FROM l a JOIN l b ON a.component = b.component AND b.local = a.local + 1 JOIN plane p ON p.id = a.id JOIN plane q ON q.id = b.id""")
def gc20_forest_edges(spark: SparkSession, d: str) -> DataFrame:
    p = M.plane_points(spark, d)
    ids = p.select(F.col("label").alias("component"), "id", (F.row_number().over(W.partitionBy("label").orderBy("id")) - 1).alias("local"))
    local = ids.select("component", F.col("local").alias("u"), (F.col("local") + 1).alias("v"))
    return r6(C.forest_edges(local, ids, p), "w")


@query(f"WITH {KNN}, k5 AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM knn WHERE rank <= 5) SELECT u, v, round(w, 6) AS w FROM edges ANTI JOIN k5 USING (u, v)")
def gc21_difference(spark: SparkSession, d: str) -> DataFrame:
    return r6(G.difference(knn_edges(spark, d), C.knn_union(M.points(spark, d), 5)), "w")


# ---- 2.4 primitives ----------------------------------------------------------------------------------------------


@query(f"WITH {N} SELECT min(w)::DOUBLE AS min_w, max(w)::DOUBLE AS max_w, round(avg(w), 6) AS mean_w, count(*) AS n_edges FROM nation_edges")
def gp01_weight_stats(spark: SparkSession, d: str) -> DataFrame:
    return r6(G.weight_stats(M.nation_edges(spark, d)), "mean_w")


@query(f"WITH {KNN} SELECT round(avg(w), 6) AS mean_w FROM edges")
def gp02_mean_weight(spark: SparkSession, d: str) -> DataFrame:
    return r6(G.weight_stats(knn_edges(spark, d)).select("mean_w"), "mean_w")


@query(f"WITH {N} SELECT round((SELECT min(w) FROM nation_edges) / (SELECT count(*) FROM (SELECT u FROM nation_edges UNION SELECT v FROM nation_edges)) / 4.0, 6) AS highway")
def gp03_highway(spark: SparkSession, d: str) -> DataFrame:
    return r6(G.highway_weight(M.nation_edges(spark, d)), "highway")


@query(f"WITH {M.PART_SQL}, a AS (SELECT u AS id FROM part_edges UNION ALL SELECT v FROM part_edges) SELECT id, count(*) AS degree FROM a GROUP BY id")
def gp04_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(M.part_supplier_edges(spark, d))


@query(f"WITH {M.PART_SQL} SELECT id FROM (SELECT u AS id FROM part_edges UNION ALL SELECT v FROM part_edges) GROUP BY id HAVING count(*) = 1")
def gp04_leaves(spark: SparkSession, d: str) -> DataFrame:
    return G.leaves(M.part_supplier_edges(spark, d))


@query(f"WITH {KNN} SELECT u, v, round(w, 6) AS w FROM edges")
def gp05_weights_from_positions(spark: SparkSession, d: str) -> DataFrame:
    return r6(G.weights_from_positions(knn_edges(spark, d), M.points(spark, d)), "w")


@query(f"WITH {N} SELECT u, v, 1000 * w AS scaled, round(1.0 / w, 9) AS inverse FROM nation_edges")
def gp06_scale_inverse(spark: SparkSession, d: str) -> DataFrame:
    return M.nation_edges(spark, d).select("u", "v", (1000 * F.col("w")).alias("scaled"), F.round(1 / F.col("w"), 9).alias("inverse"))


@query(f"WITH {N} SELECT u, v, u * 100 + v AS w FROM nation_edges")
def gp07_substitute(spark: SparkSession, d: str) -> DataFrame:
    e = M.nation_edges(spark, d)
    return G.substitute_weights(e, e.select(F.col("v").alias("u"), F.col("u").alias("v"), (F.col("u") * 100 + F.col("v")).alias("width")))


@query("SELECT DISTINCT least(user_id, event_id % 50) AS u, greatest(user_id, event_id % 50) AS v FROM events WHERE user_id <> event_id % 50")
def gp08_canonical(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select(F.col("user_id").alias("u"), (F.col("event_id") % 50).alias("v"), F.lit(1).alias("w"))
    return M.canonical(e).select("u", "v")


@query(f"WITH {M.PART_SQL}, i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT u AS id FROM part_edges UNION SELECT v FROM part_edges)) SELECT a.k AS u, b.k AS v, w FROM part_edges JOIN i a ON a.id = u JOIN i b ON b.id = v")
def gp09_compact(spark: SparkSession, d: str) -> DataFrame:
    return G.compact(M.part_supplier_edges(spark, d))


@query(f"WITH {N} SELECT u, v, w FROM nation_edges WHERE (u + v) % 3 > 0")
def gp10_used_edges(spark: SparkSession, d: str) -> DataFrame:
    e = M.nation_edges(spark, d)
    return G.used_edges(e, e.select("u", "v", ((F.col("u") + F.col("v")) % 3).alias("score")))


CC = """ lab AS (WITH RECURSIVE r(n, c) USING KEY (n) AS (SELECT id, id FROM nodes UNION SELECT a.v, min(r.c) FROM r JOIN adj a ON a.u = r.n JOIN recurring.r q ON q.n = a.v WHERE r.c < q.c GROUP BY a.v) SELECT n AS id, c AS component FROM r)"""


@query(f"WITH RECURSIVE {KNN}, sub AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM knn WHERE rank <= 2), nodes AS (SELECT id FROM points), adj AS (SELECT u, v FROM sub UNION ALL SELECT v, u FROM sub), {CC} SELECT id, component FROM lab")
def gp11_components(spark: SparkSession, d: str) -> DataFrame:
    p = M.points(spark, d)
    return G.components(C.knn_union(p, 2), p)


@query(f"WITH {N} SELECT u, v, (u % 5 = v % 5) AS cycle FROM nation_edges")
def gp12_cycles(spark: SparkSession, d: str) -> DataFrame:
    e = M.nation_edges(spark, d)
    chains = spark.range(20).select(F.col("id").alias("u"), (F.col("id") + 5).alias("v"))
    return G.closes_cycle(chains, e)


@query(f"WITH {N}, r AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey <= 2) SELECT u, v, w FROM nation_edges WHERE u IN (FROM r) AND v IN (FROM r)")
def gp15_subgraph(spark: SparkSession, d: str) -> DataFrame:
    ids = load(spark, d, "nation").where("n_regionkey <= 2").select(F.col("n_nationkey").cast("long").alias("id"))
    return G.subgraph(M.nation_edges(spark, d), ids)


@query(f"WITH {N} SELECT least(u % 5, v % 5) AS u, greatest(u % 5, v % 5) AS v, min(w) AS w FROM nation_edges WHERE u % 5 <> v % 5 GROUP BY 1, 2")
def gp16_contract(spark: SparkSession, d: str) -> DataFrame:
    return G.contract(M.nation_edges(spark, d), spark.range(25).select("id", (F.col("id") % 5).alias("component")))


@query(f"WITH {PL} SELECT id, unnest(range(0, len(pos))) AS k, round(unnest(pos), 6) AS x FROM plane")
def gp17_enumerate(spark: SparkSession, d: str) -> DataFrame:
    return M.plane_points(spark, d).select("id", F.posexplode("pos").alias("k", "x")).select("id", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"))
