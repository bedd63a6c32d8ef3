"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors become one. The rest of a label is dealt into tiles of bounded size; every
pair of tiles is one task-sized product of int8 codes. With u = s*q + e and |u| = |v| = 1,

    |u.v - (s q).(t r)| <= |e_u| * |t r| + |e_v|,

so a pair whose code product plus this bound stays below the threshold cannot be a link,
and only the others are computed in double precision. A tile pair reports link counts and a
spanning star per local group, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmend.llm.common import pick
from rowmend.llm.components import connected
from rowmend.sources.workspace import written

TILE_ROWS = 1024
LEVELS = 127
# Float32 sums of int8 products are exact below 2**24.
EXACT_DIMS = (1 << 24) // (LEVELS * LEVELS)
# For rounding in the bound itself and in the double product.
SLACK = 1e-9
# Distinct tile pairs in a shuffle are mixed by hash, so no order of them is hot.
PAIR_SCHEMA = "rep long, n long, root long"


def usable(rows: DataFrame) -> DataFrame:
    """Vectors that can link: labelled, of finite components, not zero."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite
        & F.exists("vector", lambda x: x != 0))


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, residual norms) of unit vectors; codes are whole numbers within int8."""
    scale = np.abs(vectors).max(axis=1) / LEVELS
    codes = np.rint(vectors / scale[:, None])
    residual = np.linalg.norm(vectors - codes * scale[:, None], axis=1)
    return codes.astype(np.int8), scale, residual


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps tiny and huge vectors finite.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def code_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 codes, as doubles."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_DIMS):
        part = slice(at, at + EXACT_DIMS)
        total += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return total


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two tiles have cosine >= threshold; both hold vectors as doubles."""
    ua, ub = unit(a), unit(b)
    (qa, sa, ea), (qb, sb, eb) = quantised(ua), quantised(ub)
    # |s q| <= 1 + |e|.
    bound = ea[:, None] * (1 + eb)[None, :] + eb[None, :] + SLACK
    possible = code_product(qa, qb) * sa[:, None] * sb[None, :] + bound >= threshold
    linked = np.zeros_like(possible)
    rows, columns = np.flatnonzero(possible.any(axis=1)), np.flatnonzero(possible.any(axis=0))
    if len(rows):
        norms = np.linalg.norm(a[rows], axis=1)[:, None] * np.linalg.norm(b[columns], axis=1)[None, :]
        plain = np.isfinite(norms) & (norms > 0)
        with np.errstate(all="ignore"):
            exact = np.where(plain, (a[rows] @ b[columns].T) / norms, ua[rows] @ ub[columns].T)
        linked[np.ix_(rows, columns)] = possible[np.ix_(rows, columns)] & (exact >= threshold)
    return linked


def spanning_roots(linked: np.ndarray, ids: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reached by each row and each column over the links between them."""
    top, left = ids.copy(), other.copy()
    rows, columns = np.nonzero(linked)
    while len(rows):
        new_top, new_left = top.copy(), left.copy()
        np.minimum.at(new_top, rows, left[columns])
        np.minimum.at(new_left, columns, new_top[rows])
        if (new_top == top).all() and (new_left == left).all():
            break
        top, left = new_top, new_left
    return top, left


def pair_of_tiles(key: tuple, table: pa.Table, threshold: float) -> pa.Table:
    """Link counts and local roots of the vectors of one or two tiles."""
    first, second = key[-2].as_py(), key[-1].as_py()
    tile = table.column("tile").to_numpy()
    rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
    flat = table.column("vector").combine_chunks()
    vectors = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rep), -1)
    one, two = np.flatnonzero(tile == first), np.flatnonzero(tile == second)
    linked = tile_links(vectors[one], vectors[two], threshold)
    if first == second:
        np.fill_diagonal(linked, False)
    top, left = spanning_roots(linked, rep[one], rep[two])
    parts = [(rep[one], linked @ copies[two], top)]
    if first != second:
        parts.append((rep[two], copies[one] @ linked, left))
    ids, n, root = (np.concatenate(x) for x in zip(*parts))
    kept = n > 0
    return pa.table({"rep": ids[kept].astype(np.int64), "n": n[kept].astype(np.int64), "root": root[kept].astype(np.int64)})


def similar_vectors(classes: DataFrame, threshold: float) -> DataFrame:
    """(rep, n, root) per vector and tile pair with links; `classes` holds label, dims, rep, copies, vector."""
    sizes = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / TILE_ROWS).alias("tiles"))
    placed = classes.join(sizes, ["label", "dims"]).withColumn("tile", F.pmod(F.xxhash64("rep"), "tiles"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    paired = placed.withColumn("other", other).select(
        "label", "dims", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"),
        "tile", "rep", "copies", "vector")
    return paired.groupBy("label", "dims", "first", "second").applyInArrow(
        lambda key, table: pair_of_tiles(key, table, threshold), PAIR_SCHEMA)


def near_vectors(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) per row; vectors link within a label at cosine >= threshold.

    A vector that is null, zero or holds null or non-finite components, and one without label
    or id, links with nothing: no links, its own component, kept. Vectors of unequal length
    do not link. Equal vectors link, and count as one in the products. Rows that share an id
    are one node and are all returned. The threshold must be positive. Other columns are not
    read; an empty table gives an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    rows = pick(df, id=id_col, vector=vector_col, label=label_col).withColumn("id", F.col("id").cast("long"))
    good = usable(rows).withColumn("dims", F.size("vector"))
    classes = written(good.groupBy("label", "dims", "vector").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors")
    found = written(similar_vectors(classes, threshold), "tiles")
    links = found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    # Rows that share an id but not a vector join their classes.
    roots = connected(links).select(F.col("node").alias("rep"), "root")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    member = classes.join(counts, "rep", "left").join(roots, "rep", "left").select(
        "label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.coalesce("root", "rep").alias("component"))
    joined = rows.join(member, ["label", "vector"], "left")
    component = F.coalesce("component", "id")
    return joined.select(
        "id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
