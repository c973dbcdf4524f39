"""Queries on vectors and histograms."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from keyframe.operators import clusters as K
from keyframe.operators import joins as J
from keyframe.operators import pictures as P
from keyframe.operators import similarity as V
from keyframe.streaming import shared

from . import surrogates as X


def _vectors(spark, d):
    return X.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


_V = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
_COS = "(list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))))"


def _pairs(spark, d):
    """Vectors beside the one before of their label, by id."""
    v = J.previous(_vectors(spark, d), "label", "vec_id", ["vec"]).where("prev is not null")
    return v.withColumn("prev", F.col("prev.vec"))


def cosine_pairs(spark, d):
    """Neighbouring vectors of a label by id."""
    v = _pairs(spark, d)
    return v.select("vec_id", F.round(V.cosine(F.col("vec"), F.col("prev")), 6).alias("cos"))


def hist_bins(spark, d):
    return V.histogram(X.frames(spark, d), "video", F.least(F.floor(F.col("v") / 200), F.lit(49)), 50)


def hist_corr(spark, d):
    """Pearson correlation of event-type histograms (20 bins, zero-filled) of each video with all events'."""
    f = X.frames(spark, d).select("video", F.least(F.floor(F.col("k") / 5), F.lit(19)).alias("bin"))
    h = f.groupBy("video", "bin").agg(F.count("*").alias("n"))
    whole = f.groupBy("bin").agg(F.count("*").alias("m"))
    full = f.select("video").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    j = full.join(h, ["video", "bin"], "left").join(whole, "bin", "left").fillna(0)
    return j.groupBy("video").agg(F.round(V.whole_correlation("n", "m"), 6).alias("r"))


def _video(spark, d):
    """Vectors as frames of videos of 64, so that pairs are looked at within a video only, however many vectors there are."""
    return _vectors(spark, d).select("vec_id", "vec", F.floor(F.col("vec_id") / 64).alias("video"))


def near_dup(spark, d):
    return V.redundant(_vectors(spark, d), "label", "vec_id", "vec", 0.3)


def joint_hist(spark, d):
    """Counts of the joint histogram of three components (50 bins each) by video, and their share of the vector's length."""
    bins = [F.least(F.floor((c + 4) * 6.25), F.lit(49)) for c in (F.col("vec")[0], F.col("vec")[1], F.col("vec")[2])]
    at = bins[0] * 2500 + bins[1] * 50 + bins[2]
    return V.histogram(_video(spark, d), "video", at, 125000)


def sharpness(spark, d):
    """Variance of the Laplacian of 8 x 8 pictures, mirrored at the border."""
    return _vectors(spark, d).select("vec_id", F.round(V.laplacian_variance(F.col("vec"), 8), 6).alias("sharpness"))


def bright_box(spark, d):
    """Bounds (left, top, right, bottom) of the cells over 1.5 of 8 x 8 pictures; (0, 0, 1, 1) where there is none."""
    return _vectors(spark, d).select("vec_id", V.bounds(F.col("vec"), 8, F.lit(1.5)).alias("b")).select("vec_id", "b.*")


def picture_likeness(spark, d):
    """Likeness of each 8 x 8 picture to the one before it: structural similarity in windows of 7."""
    v = _pairs(spark, d)
    return v.select("vec_id", F.round(V.structural_similarity(F.col("vec"), F.col("prev")), 6).alias("ssim"))


def cluster_tree(spark, d):
    """Representatives of each video by breadth and depth; relevance follows from the id."""

    def run(frames):
        import numpy as np
        import pandas as pd

        from keyframe.operators import video as K

        for f in frames:
            out = []
            for video, ids, vecs in zip(f["video"], f["ids"], f["vecs"]):
                found = K.cluster_search(np.stack(list(vecs)), lambda rows, i=ids: [int(i[r]) % 3 + 1 for r in rows], seed=int(video))
                out += [(video, int(ids[r])) for r in found]
            yield pd.DataFrame(out, columns=["video", "vec_id"])

    rows = _video(spark, d).groupBy("video").agg(F.array_sort(F.collect_list(F.struct("vec_id", "vec"))).alias("a"))
    return rows.select("video", F.transform("a", lambda x: x["vec_id"]).alias("ids"), F.transform("a", lambda x: x["vec"]).alias("vecs")).mapInPandas(run, "video long, vec_id long")


def _seeds(spark, d):
    return _vectors(spark, d).where("vec_id < 8").select(F.col("vec_id").cast("int").alias("cluster"), F.col("vec").alias("c"))


def assign_centroid(spark, d):
    return V.assign(_vectors(spark, d), _seeds(spark, d), "vec_id", "vec")


def centroid(spark, d):
    return V.centroids(_vectors(spark, d), "label", "vec").select("label", F.col("i").alias("dim"), F.round("v", 6).alias("mean"))


def medoid(spark, d):
    return V.medoids(_vectors(spark, d), "label", "vec_id", "vec")


def medoid_euclid(spark, d):
    return V.nearest_to_centre(_vectors(spark, d), "label", "vec_id", "vec")


def channel_likeness(spark, d):
    """Likeness of each vector to the one before it: Pearson's r of three channels of 21 bins, averaged."""
    v = _pairs(spark, d)
    r = sum(V.pearson(F.slice("vec", 21 * c + 1, 21), F.slice("prev", 21 * c + 1, 21)) for c in range(3)) / 3
    return v.select("vec_id", F.round(r, 6).alias("r"))


def kmeans_fixed_init(spark, d):
    """Two unrolled rounds of cosine k-means from fixed seeds."""
    v, seeds = _vectors(spark, d), _seeds(spark, d)
    for _ in range(2):
        got = V.assign(v, seeds, "vec_id", "vec")
        long = V.components_of(v.join(got, "vec_id").select("cluster", "vec"), "vec").groupBy("cluster", "i").agg(F.avg("v").alias("v"))
        seeds = V.as_vectors(long, "cluster")
    return V.assign(v, seeds, "vec_id", "vec")


def kmeans_lloyd(spark, d):
    """Three rounds of cosine k-means over all vectors, from a drawn start."""
    got, _ = K.lloyd(spark, _vectors(spark, d), "vec_id", "vec", 8, f"{shared.folder(spark)}/lloyd-{uuid.uuid4().hex}", seed=1, rounds=3, tolerance=0.0)
    return got


def embedded_pictures(spark, d):
    """Unit vectors of all vectors under a fixed projection, as by a model that is loaded once and takes 32 at a time."""

    def make():
        import numpy as np

        i, j = np.ogrid[:64, :8]
        weights = (7 * i + 3 * j) % 5 - 2.0
        return lambda inputs: inputs @ weights

    got = P.embedded(_vectors(spark, d).select("vec_id", "vec"), make, content="vec", shape=[64])
    return got.select("vec_id", F.posexplode("vec").alias("dim", "v")).select("vec_id", "dim", F.round("v", 6).alias("v"))


def mse(spark, d):
    v = _pairs(spark, d)
    se = F.aggregate(F.zip_with("vec", "prev", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return v.select("vec_id", F.round(se / F.size("vec"), 6).alias("mse"))


def sharpness_1d(spark, d):
    w = Window.partitionBy("video").orderBy("idx")
    f = X.frames(spark, d).select("video", (F.lag("v").over(w) - 2 * F.col("v") + F.lead("v").over(w)).alias("l"))
    return f.where("l is not null").groupBy("video").agg(F.round(F.var_pop("l") / 10000, 4).alias("sharpness"))


QUERIES = {f.__name__: f for f in (cosine_pairs, hist_bins, hist_corr, near_dup, joint_hist, sharpness, bright_box, picture_likeness, cluster_tree, assign_centroid, centroid, medoid, medoid_euclid, channel_likeness, kmeans_fixed_init, kmeans_lloyd, embedded_pictures, mse, sharpness_1d)}
_NEXT = "v.vec_id, row_number() OVER (PARTITION BY v.vec_id ORDER BY round(-" + _COS.format("v.vec", "s.c") + ", 9), s.cluster) AS r, s.cluster"
_SEED = f"{_V}, s0 AS (SELECT CAST(vec_id AS INT) AS cluster, vec AS c FROM v WHERE vec_id < 8), a0 AS (SELECT * FROM (SELECT {_NEXT} FROM v, s0 s) WHERE r = 1)"


def _round(i):
    return f""", m{i} AS (SELECT a.cluster, u.k, avg(v.vec[u.k]) AS x FROM a{i - 1} a JOIN v ON v.vec_id = a.vec_id, unnest(range(1, 65)) AS u(k) GROUP BY ALL),
      s{i} AS (SELECT cluster, list(x ORDER BY k) AS c FROM m{i} GROUP BY cluster), a{i} AS (SELECT * FROM (SELECT {_NEXT} FROM v, s{i} s) WHERE r = 1)"""


SQL = {
    "cosine_pairs": f"{_V}, p AS (SELECT vec_id, vec, lag(vec) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM v) SELECT vec_id, round({_COS.format('vec', 'prev')}, 6) AS cos FROM p WHERE prev IS NOT NULL",
    "hist_bins": f"WITH {X.FRAMES}, h AS (SELECT video, CAST(least(v // 200, 49) AS BIGINT) AS bin, count(*) AS n FROM frames GROUP BY ALL) SELECT video, bin, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY video)), 6) AS norm FROM h",
    "hist_corr": f"""WITH {X.FRAMES}, f AS (SELECT video, least(k // 5, 19) AS bin FROM frames), h AS (SELECT video, bin, count(*) AS n FROM f GROUP BY ALL), w AS (SELECT bin, count(*) AS m FROM f GROUP BY ALL),
      x AS (SELECT video, b AS bin FROM (SELECT DISTINCT video FROM f), range(20) AS t(b)), c AS (SELECT x.video, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM x LEFT JOIN h ON h.video = x.video AND h.bin = x.bin LEFT JOIN w ON w.bin = x.bin),
      s AS (SELECT video, count(*) * sum(n * m) - sum(n) * sum(m) AS xy, count(*) * sum(n * n) - sum(n) * sum(n) AS xx, count(*) * sum(m * m) - sum(m) * sum(m) AS yy FROM c GROUP BY video)
      SELECT video, round(CASE WHEN xy = 0 OR xx = 0 OR yy = 0 THEN 0.0::DOUBLE ELSE CAST(xy AS DOUBLE) / (sqrt(CAST(xx AS DOUBLE)) * sqrt(CAST(yy AS DOUBLE))) END, 6) AS r FROM s""",
    "near_dup": f"{_V} SELECT DISTINCT a.label, a.vec_id FROM v a JOIN v b ON a.label = b.label AND b.vec_id < a.vec_id WHERE {_COS.format('a.vec', 'b.vec')} >= 0.3",
    "joint_hist": f"{_V}, h AS (SELECT vec_id // 64 AS video, CAST(least(floor((vec[1] + 4) * 6.25), 49) * 2500 + least(floor((vec[2] + 4) * 6.25), 49) * 50 + least(floor((vec[3] + 4) * 6.25), 49) AS BIGINT) AS bin, count(*) AS n FROM v GROUP BY ALL) SELECT video, bin, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY video)), 6) AS norm FROM h",
    "sharpness": f"{_V}, l AS (SELECT vec_id, list_transform(range(64), lambda i: vec[CASE WHEN i < 8 THEN i + 8 ELSE i - 8 END + 1] + vec[CASE WHEN i >= 56 THEN i - 8 ELSE i + 8 END + 1] + vec[CASE WHEN i % 8 = 0 THEN i + 1 ELSE i - 1 END + 1] + vec[CASE WHEN i % 8 = 7 THEN i - 1 ELSE i + 1 END + 1] - 4 * vec[i + 1]) AS l FROM v) SELECT vec_id, round(list_aggregate(l, 'var_pop'), 6) AS sharpness FROM l",
    "bright_box": f"{_V}, b AS (SELECT vec_id, list_filter(range(64), lambda i: vec[i + 1] > 1.5::DOUBLE) AS b FROM v) SELECT vec_id, CAST(coalesce(list_min(list_transform(b, lambda i: i % 8)), 0) AS INT) AS left_px, CAST(coalesce(list_min(b) // 8, 0) AS INT) AS top_px, CAST(coalesce(list_max(list_transform(b, lambda i: i % 8)) + 1, 1) AS INT) AS right_px, CAST(coalesce(list_max(b) // 8 + 1, 1) AS INT) AS bottom_px FROM b",
    "assign_centroid": f"{_SEED} SELECT vec_id, cluster FROM a0",
    "centroid": f"{_V} SELECT label, CAST(k - 1 AS INT) AS dim, round(avg(vec[k]), 6) AS mean FROM v, unnest(range(1, 65)) AS u(k) GROUP BY ALL",
    "medoid": f"{_V}, m AS (SELECT label, k, avg(vec[k]) AS x FROM v, unnest(range(1, 65)) AS u(k) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY k) AS c FROM m GROUP BY label) SELECT label, vec_id FROM (SELECT v.label, v.vec_id, row_number() OVER (PARTITION BY v.label ORDER BY round(1 - {_COS.format('v.vec', 'c.c')}, 9), v.vec_id) AS r FROM v JOIN c ON c.label = v.label) WHERE r = 1",
    "medoid_euclid": f"{_V}, m AS (SELECT label, k, avg(vec[k]) AS x FROM v, unnest(range(1, 65)) AS u(k) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY k) AS c FROM m GROUP BY label) SELECT label, vec_id FROM (SELECT v.label, v.vec_id, row_number() OVER (PARTITION BY v.label ORDER BY round(power(list_distance(v.vec, c.c), 2), 9), v.vec_id) AS r FROM v JOIN c ON c.label = v.label) WHERE r = 1",
    "channel_likeness": f"{_V}, p AS (SELECT vec_id, vec, lag(vec) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM v), c AS (SELECT vec_id, ch, corr(vec[ch * 21 + j + 1], prev[ch * 21 + j + 1]) AS r FROM p, unnest(range(3)) AS a(ch), unnest(range(21)) AS b(j) WHERE prev IS NOT NULL GROUP BY ALL) SELECT vec_id, round(avg(r), 6) AS r FROM c GROUP BY vec_id",
    "kmeans_fixed_init": f"{_SEED}{_round(1)}{_round(2)} SELECT vec_id, cluster FROM a2",
    "embedded_pictures": f"{_V}, p AS (SELECT vec_id, list_transform(range(8), lambda j: list_sum(list_transform(range(64), lambda i: vec[i + 1] * ((7 * i + 3 * j) % 5 - 2)))) AS x FROM v) SELECT vec_id, CAST(j AS INT) AS dim, round(x[j + 1] / sqrt(list_dot_product(x, x)), 6) AS v FROM p, unnest(range(8)) AS u(j)",
    "kmeans_lloyd": f"{_V}, s0 AS (SELECT CAST(row_number() OVER (ORDER BY m) - 1 AS INT) AS cluster, vec AS c FROM (SELECT vec, md5('1:' || vec_id) AS m FROM v ORDER BY m LIMIT 8)), a0 AS (SELECT * FROM (SELECT {_NEXT} FROM v, s0 s) WHERE r = 1){_round(1)}{_round(2)} SELECT vec_id, cluster FROM a2",
    "mse": f"{_V}, p AS (SELECT vec_id, vec, lag(vec) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM v) SELECT vec_id, round(power(list_distance(vec, prev), 2) / 64, 6) AS mse FROM p WHERE prev IS NOT NULL",
    "sharpness_1d": f"WITH {X.FRAMES}, l AS (SELECT video, lag(v) OVER w - 2 * v + lead(v) OVER w AS l FROM frames WINDOW w AS (PARTITION BY video ORDER BY idx)) SELECT video, round(var_pop(l) / 10000, 4) AS sharpness FROM l WHERE l IS NOT NULL GROUP BY video",
}
