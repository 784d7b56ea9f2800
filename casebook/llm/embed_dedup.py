"""Embedding near-deduplication by int8 tile products with error bounds.

Equal vectors are one class with a multiplicity.  Classes are numbered by their least id and dealt to blocks of
about ``BLOCK`` vectors by a hash, and every pair of blocks is one tile, of bounded size.  The larger a block, the fewer
copies of it travel, one for each other block.  In a tile, vectors are scaled by a power of two, so that no norm leaves the range of doubles, and
those of unit length are quantised to int8, u = s q + e, and the products of the int8
vectors, exact as they stay below 2**24, bound each cosine: it lies within |e_u| + |s q_u| |e_v| of the quantised one.  Pairs whose
upper bound is below the threshold are done, those whose lower bound is not below it are
links, and only what is left is recomputed in double precision.  A tile returns how many links each
vector has and a spanning forest of the links.

Cases: vectors that are null, empty or zero, or hold null or non-finite components, link with
nothing; vectors of different length never link; rows that repeat a vec_id are vectors of their own,
and each gets the links and the component of its vector; null ids take no part; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, store

#: Vectors of a block, and its bytes as doubles, at most about; a task holds two.
BLOCK, BLOCK_BYTES = 16_384, 32 << 20
STRIP = 512


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, exactly, so that the largest component is between a half and one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _quantised(x: np.ndarray):
    """Int8 rows, their scales, the norms of the quantised rows and of the errors, for rows scaled to unit length."""
    u = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    error = np.sqrt(((u - back) ** 2).sum(axis=1)) + 1e-12
    return q, scale, np.sqrt((back**2).sum(axis=1)), error


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: parts of up to 1024 components stay below 2**24 in single precision."""
    out = None
    for k in range(0, a.shape[1], 1024):
        part = a[:, k : k + 1024].astype(np.float32, copy=False) @ b[:, k : k + 1024].astype(np.float32, copy=False).T
        out = part if out is None else out.astype(np.float64) + part
    return out


def compare(x: np.ndarray, y: np.ndarray, x_times: np.ndarray, y_times: np.ndarray, least: float, same: bool):
    """Links of the rows of ``x`` with those of ``y``: how many each has, by multiplicity, and a forest of (row of x, row of y)."""
    qx, sx, hx, ex = _quantised(x)
    qy, sy, _, ey = (qx, sx, hx, ex) if same else _quantised(y)
    nx, ny = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, y))
    n_x, n_y, kept = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
    single, qy = sy.astype(np.float32), qy.astype(np.float32)
    for k in range(0, len(x), STRIP):
        s = slice(k, min(k + STRIP, len(x)))
        near = _products(qx[s], qy)
        near *= single
        slack = ex[s] + hx[s] * ey.max() + 2e-6
        maybe = near >= ((least - slack) / sx[s]).astype(near.dtype)[:, None]
        i, j = np.nonzero(maybe)
        if not len(i):
            continue
        value, bound = near[i, j].astype(np.float64) * sx[s][i], ex[s][i] + hx[s][i] * ey[j] + 2e-6
        open_ = np.flatnonzero((value - bound < least) & (value + bound >= least))
        linked = value - bound >= least
        for c in range(0, len(open_), 50_000):
            o = open_[c : c + 50_000]
            linked[o] = np.einsum("ij,ij->i", x[k + i[o]], y[j[o]]) / (nx[k + i[o]] * ny[j[o]]) >= least
        if same:
            linked &= i + k != j
        i, j = i[linked] + k, j[linked]
        n_x += np.bincount(i, y_times[j], len(x)).astype(np.int64)
        if not same:
            n_y += np.bincount(j, x_times[i], len(y)).astype(np.int64)
        # rows of y follow those of x, so one forest serves both
        kept.append(components.forest(np.stack([i, j if same else j + len(x)], axis=1)))
    links = components.forest(np.concatenate(kept)) if kept else np.zeros((0, 2), np.int64)
    return n_x, n_y, links


def _vectors(ids_and_vectors):
    for pdf in ids_and_vectors:
        rows = []
        for i, known, v in zip(pdf["vec_id"], pdf["known"], pdf["v"], strict=True):
            raw = None
            if v is not None and len(v):
                x = np.asarray(v, np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    raw = x.tobytes()
            rows.append((i, known, raw and hashlib.blake2b(raw, digest_size=16).digest(), len(raw) // 8 if raw else None, raw))
        yield pd.DataFrame(rows, columns=["vec_id", "known", "same", "dim", "raw"]).astype({"dim": "Int64"})


def link(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    spark = vectors.sparkSession
    plain = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("vec_id"), F.col(id_col).isNotNull().alias("known"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = store.materialize(plain.mapInPandas(_vectors, "vec_id long, known boolean, same binary, dim long, raw binary"), "vectors")
    scratch = store.Scratch(spark, "tiles")
    known = rows.where("same is not null and known")
    # classes are numbered in the order of their least ids, so that the least number in a component tells its least id
    lead = known.groupBy("same").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"), F.max("dim").alias("dim"))
    lead = scratch.store(lead.orderBy("id", "same").withColumn("node", F.monotonically_increasing_id()), "lead")
    about = lead.agg(F.count("*"), F.max("dim")).first()
    blocks = store.parts(about[0], max(1, min(BLOCK, BLOCK_BYTES // (8 * (about[1] or 1)))))
    one = known.join(lead.select(F.col("same").alias("_same"), "id", "times", "node"), (F.col("same") == F.col("_same")) & (F.col("vec_id") == F.col("id")))
    dealt = one.select("node", "times", "dim", "raw", "same").dropDuplicates(["node"]).withColumn("block", F.pmod(F.xxhash64("same"), F.lit(blocks)))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["raw"]), np.float64)
        with np.errstate(over="ignore"):
            short = x.astype(np.float32)
        raw = short.tobytes() if np.array_equal(short.astype(np.float64), x) else x.tobytes()
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "n": [len(pdf)], "nodes": [pdf["node"].to_numpy(np.int64).tobytes()], "times": [pdf["times"].to_numpy(np.int64).tobytes()], "raw": [raw]})

    tiles = scratch.store(dealt.groupBy("dim", "block").applyInPandas(packed, "dim long, block long, n long, nodes binary, times binary, raw binary"), "blocks")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other")
    met = tiles.select("*", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        parts = {}
        for r in pdf.itertuples():
            kind = np.float32 if len(r.raw) == 4 * r.n * r.dim else np.float64
            parts[r.block] = (np.frombuffer(r.nodes, np.int64), np.frombuffer(r.times, np.int64), _scaled(np.frombuffer(r.raw, kind).reshape(r.n, r.dim).astype(np.float64)))
        if low not in parts or high not in parts:
            return pd.DataFrame({"node": [], "n": [], "other": []})
        (ia, ta, xa), (ib, tb, xb) = parts[low], parts[high]
        na, nb, links = compare(xa, xb, ta, tb, least, low == high)
        both = ia if low == high else np.concatenate((ia, ib))
        n = na if low == high else np.concatenate((na, nb))
        some = np.flatnonzero(n)
        others = pd.array(np.concatenate((np.zeros(len(some), np.int64), both[links[:, 1]])), dtype="Int64")
        others[: len(some)] = pd.NA
        return pd.DataFrame({"node": np.concatenate((both[some], both[links[:, 0]])), "n": np.concatenate((n[some], np.zeros(len(links), np.int64))), "other": others})

    found = scratch.store(met.groupBy("dim", "low", "high").applyInPandas(compared, "node long, n long, other long"), "found")
    counts = scratch.store(found.where("other is null").groupBy(F.col("node").alias("_counted")).agg(F.sum("n").alias("far")), "counts")
    comps = components.components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = comps.join(lead.select("node", F.col("id").alias("c")), F.col("component") == F.col("node")).select(F.col("id").alias("_node"), "c")
    out = lead.join(counts, F.col("node") == F.col("_counted"), "left").join(named, F.col("node") == F.col("_node"), "left")
    out = store.materialize(out.select(F.col("same").alias("_same"), (F.coalesce("far", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("c", "id").alias("c")), "about")
    scratch.clear()
    done = known.join(out, F.col("same") == F.col("_same"), "left").select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    # rows that take no part don't meet as one null key
    own = F.when(F.col("known"), F.col("vec_id"))
    done = done.union(rows.where("same is null or not known").select(own, F.lit(0).cast("long"), own))
    return done.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
