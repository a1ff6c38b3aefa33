"""The arithmetic of action-unit graphs, without any trained weights.

knn_adjacency works on a table of nodes; the other functions on arrays, for use in user-supplied stages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Nodes of a graph that are compared with as many others in one task, and rows of one product of matrices.
BLOCK, TILE = 8192, 512
#: Similarities are rounded to 9 decimals: those less than this apart may tie.
TIE = 1e-9
#: Main units of which each has a left and a right side unit.
SIDED = (0, 1, 2, 4, 7, 8, 11)


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors by length, padded with zeros, and their lengths; -1 for those that are NULL or have a NULL."""
    rows = column.combine_chunks().cast(pa.list_(pa.float64()))
    flat, at = rows.values, rows.offsets.to_numpy()
    size = np.diff(at)
    holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    x = np.zeros((len(rows), max(int(size.max(initial=0)), 1)))
    values = flat.to_numpy(zero_copy_only=False)
    place = np.arange(x.shape[1])[None] < size[:, None]
    x[place] = values[np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
    whole = rows.is_valid().to_numpy(zero_copy_only=False) & (holes[at[1:]] == holes[at[:-1]])
    return x, np.where(whole, size, -1)


def _nearest(a: pa.Table, b: pa.Table, k: int, by: str, schema: pa.Schema) -> pa.Table:
    """Of all pairs of a row of a and one of b those that may be among the k most similar of b, ties among them, with exact dot products.

    Products of matrices differ from sums in order by rounding, so a margin is kept; what is kept is summed in order.
    """
    if not len(a) or not len(b):
        return schema.empty_table()
    (x, m), (y, n) = _vectors(a["vector"]), _vectors(b["vector"])
    width = max(x.shape[1], y.shape[1])
    x, y = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, y))
    out = []
    with np.errstate(all="ignore"):
        lengths = [np.sqrt((v * v).sum(1)) for v in (x, y)]
        longest = np.nan_to_num(lengths[1], nan=0, posinf=0).max(initial=0)
        margin = 2 * TIE + 8 * width * np.finfo(float).eps * lengths[0] * longest
        margin = np.where(np.isfinite(margin), margin, np.inf)
        plain = n[0] >= 0 and (m == n[0]).all() and (n == n[0]).all() and all((v < 1e150).all() for v in lengths)
        for i in range(0, len(x), TILE):
            keys = x[i : i + TILE] @ y.T
            if not plain:  # NaN is the greatest, NULL the least
                keys = np.where((m[i : i + TILE, None] == n) & (n >= 0), np.where(np.isnan(keys), np.inf, keys), -np.inf)
            least = np.partition(keys, len(y) - k, axis=1)[:, len(y) - k] if len(y) > k else np.full(len(keys), -np.inf)
            least = np.where(np.isposinf(least), least, least - margin[i : i + TILE])
            src, dst = np.nonzero(keys >= least[:, None])
            sim = np.zeros(len(src))
            for j in range(width):
                sim += x[i + src, j] * y[dst, j]
            out.append(pa.table([a[by].take(i + src), a["node"].take(i + src), b["node"].take(dst), pa.array(sim, mask=(m[i + src] != n[dst]) | (n[dst] < 0))], schema=schema))
    return pa.concat_tables(out)


def knn_adjacency(nodes: DataFrame, k: int, by: str = "graph", node: str = "node", vector: str = "vector") -> DataFrame:
    """(by, src, dst): dst is as similar to src, by dot product, as its k-th most similar node or more; ties all count.

    A node is one of its own neighbours' candidates. All pairs of a graph are compared, as products of matrices of some
    BLOCK nodes each; only the k best of a block, with their ties, leave it, so pairs are neither shipped nor sorted.
    """
    sizes = nodes.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = nodes.select(by, F.col(node).alias("node"), F.col(vector).alias("vector")).join(sizes, by).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda i, j: rows.select(*[c.alias(n) for c, n in ((F.col(by), by), (i, "i"), (j, "j"), (F.col("node"), "node"), (F.col("vector"), "vector"))])
    a, b = side(F.col("own"), other), side(other, F.col("own"))
    kinds = dict(rows.dtypes)
    out = f"`{by}` {kinds[by]}, src {kinds['node']}, dst {kinds['node']}, dot double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.schema.field("node").type
        return _nearest(left, right, k, by, pa.schema([(by, left.schema.field(by).type), ("src", ids), ("dst", ids), ("dot", pa.float64())]))

    best = a.groupBy(by, "i", "j").cogroup(b.groupBy(by, "i", "j")).applyInArrow(run, out)
    place = F.rank().over(Window.partitionBy(by, "src").orderBy(F.desc("sim")))
    sims = best.select(by, "src", "dst", F.round("dot", 9).alias("sim"))
    return sims.withColumn("place", place).where(F.col("place") <= k).select(by, "src", "dst")


def normalise_digraph(edges: DataFrame, by: str = "graph") -> DataFrame:
    """edges with ``weight``: 1 over the roots of the out-degrees of both ends. Edges to nodes without edges are left out.

    edges may be costly, so they are made once: each tells its degree to the edges that end where it begins.
    """
    whole = edges.select(by, "src", "dst").dropna(subset=[by, "src"])
    out = whole.withColumn("a", F.count(F.lit(1)).over(Window.partitionBy(by, "src")))
    told = F.array(F.struct(F.col("dst").alias("node"), F.lit(False).alias("own")), F.struct(F.col("src").alias("node"), F.lit(True).alias("own")))
    ends = out.select("*", F.inline(told))
    ends = ends.withColumn("b", F.max(F.when(F.col("own"), F.col("a"))).over(Window.partitionBy(by, "node"))).where(~F.col("own") & F.col("b").isNotNull())
    return ends.select(by, "src", "dst", (1 / F.sqrt(F.col("a").cast("double")) / F.sqrt(F.col("b").cast("double"))).alias("weight"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def unit_activations(x: np.ndarray, main: np.ndarray, side: np.ndarray, sided: tuple = SIDED) -> np.ndarray:
    """Cosine similarities of node features (batch, nodes, size) to prototypes, negative parts of which are cut: main units, then sides."""
    cosine = lambda a, b: (_unit(a) * _unit(np.maximum(b, 0))).sum(-1)
    return np.concatenate([cosine(x, main), cosine(np.repeat(x[:, list(sided)], 2, axis=1), side)], axis=1)


def cross_attention(y: np.ndarray, x: np.ndarray, q: np.ndarray, k: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Attention of queries from y to keys and values from x, scaled by the root of the keys' size."""
    keys = x @ k
    logits = (y @ q) @ np.swapaxes(keys, -1, -2) / np.sqrt(keys.shape[-1])
    p = np.exp(logits - logits.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True) @ (x @ v)


def gated_edges(edge: np.ndarray, source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edge features with those of both ends added, and gates: their logistic values, of unit sum over each node's edges."""
    new = edge + source + target
    gate = 1 / (1 + np.exp(-new))
    return new, gate / (gate.sum(-2, keepdims=True) + 1e-6)
