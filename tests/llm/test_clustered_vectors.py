"""The k-means tree where vectors have structure: few leaves are enough; in a leaf that holds a third of all rows nothing is lost."""

import numpy as np
from pyspark.sql import functions as F

from lantern.llm import kmeans_tree


def test_few_leaves_of_clustered_vectors(spark):
    r = np.random.default_rng(7)
    centres = r.normal(size=(40, 24))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    own = np.where(r.random(6000) < 1 / 3, 0, r.integers(0, 40, 6000))  # one cluster holds a third
    x = centres[own] + 0.15 * r.normal(size=(6000, 24))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    how = kmeans_tree.Tree(block=256)
    root, n_leaves = kmeans_tree.grown(x.astype(np.float64), how)
    leaf = kmeans_tree.leaves_of(root, x.astype(np.float64))
    indexed = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x.astype(float), leaf, strict=True))], "vec_id long, v array<double>, leaf long")
    visits = kmeans_tree._calibrated(indexed.filter(F.col("vec_id") % 20 == 0).select("vec_id", "v"), indexed, root, n_leaves, how)
    assert n_leaves > 20 and visits < n_leaves / 2, (visits, n_leaves)
    got, y = kmeans_tree.search(df, how=how).toPandas(), x.astype(np.float64)
    hit = 0
    for q in range(0, 6000, 20):
        score = y @ y[q]
        score[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(6000), -score))[:20]) & set(got[got.query_id == q].vec_id))
    assert hit / (300 * 20) >= 0.9
