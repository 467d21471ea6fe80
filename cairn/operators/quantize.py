"""Product quantisation, scalar codecs and k-means.

Codebooks are small and fixed in size (subspaces x 256 x width), so they are broadcast; rows are
encoded in Arrow batches. Training takes a deterministic sample of bounded size.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import matrix

#: Rows that codebooks are trained on, at most.
TRAIN_ROWS = 65_536


@dataclass(frozen=True)
class Codebook:
    """Centroids [subspace, code, dimension of the subspace] and an optional rotation y = x R."""

    centroids: np.ndarray
    rotation: np.ndarray | None = None

    @property
    def m(self) -> int:
        return self.centroids.shape[0]

    def turned(self, x: np.ndarray) -> np.ndarray:
        return x if self.rotation is None else x @ self.rotation

    def encode(self, x: np.ndarray) -> np.ndarray:
        x = self.turned(x).reshape(len(x), self.m, -1)
        out = np.empty((len(x), self.m), np.int16)
        for j in range(self.m):
            d = ((x[:, j, None, :] - self.centroids[j][None]) ** 2).sum(2) if len(x) else np.zeros((0, 1))
            out[:, j] = d.argmin(1) if len(x) else 0
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Vectors in rotated space."""
        return np.concatenate([self.centroids[j][codes[:, j]] for j in range(self.m)], axis=1)

    def restored(self, codes: np.ndarray) -> np.ndarray:
        """Vectors as they were before the rotation."""
        y = self.decode(codes)
        return y if self.rotation is None else y @ self.rotation.T

    def rounded(self, form: str = "f16") -> "Codebook":
        """As it is after being stored: float16, or int8 with a scale a subspace (half away from zero)."""
        if form == "f16":
            return Codebook(half_round_trip(self.centroids).astype(np.float64), self.rotation)
        if form != "int8":
            raise ValueError(f"unknown codebook storage {form}")
        scale = np.abs(self.centroids).max((1, 2), keepdims=True) / 127
        safe = np.where(scale > 0, scale, 1)
        q = np.sign(self.centroids) * np.floor(np.abs(self.centroids / safe) + 0.5)
        return Codebook(np.clip(q, -127, 127) * safe, self.rotation)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centroids=self.centroids, **({} if self.rotation is None else {"rotation": self.rotation}))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Codebook":
        z = np.load(io.BytesIO(data))
        return cls(z["centroids"], z["rotation"] if "rotation" in z.files else None)

    def tables(self, q: np.ndarray, metric: str) -> np.ndarray:
        """[query, subspace, code]: squared distances for l2, else minus products, plus 1 in subspace 0."""
        q = self.turned(q).reshape(len(q), self.m, -1)
        if metric == "l2":
            return ((q[:, :, None, :] - self.centroids[None]) ** 2).sum(3)
        t = -np.einsum("qjd,jcd->qjc", q, self.centroids)
        t[:, 0] += 1
        return t


def default_m(dim: int) -> int:
    """Subspaces: 64 or else 32 if that divides the dimension."""
    for m in (64, 32):
        if dim % m == 0:
            return m
    raise ValueError(f"give pq_m for {dim} dimensions")


def sample(df: DataFrame, id_col: str, rows: int = TRAIN_ROWS, seed: int = 42) -> DataFrame:
    """A deterministic sample: the ``rows`` ids that hash lowest."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(rows)


def kmeans(x: np.ndarray, k: int, iterations: int = 25, seed: int = 42) -> np.ndarray:
    """Lloyd's iterations after k-means++; with no more than k points these are the centroids. An empty
    cluster takes the point that lies farthest from its centroid."""
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return np.concatenate([x, np.repeat(x[-1:], k - len(x), axis=0)])
    centres = np.empty((k, x.shape[1]))
    centres[0] = x[rng.integers(len(x))]
    near = ((x - centres[0]) ** 2).sum(1)
    for j in range(1, k):
        total = near.sum()
        pick = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
        centres[j] = x[pick]
        near = np.minimum(near, ((x - centres[j]) ** 2).sum(1))
    last = None
    for _ in range(iterations):
        d = (centres**2).sum(1)[None] - 2 * x @ centres.T
        own = d.argmin(1)
        if last is not None and (own == last).all():
            break
        last = own
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        far = d[np.arange(len(x)), own] + (x**2).sum(1)
        for j in np.flatnonzero(n == 0):
            pick = int(far.argmax())
            sums[j], n[j], far[pick] = x[pick], 1, -1
        centres = sums / n[:, None]
    return centres


def train_pq(df: DataFrame, m: int, id_col: str = "vec_id", vec_col: str = "embedding", codes: int = 256, iterations: int = 25, seed: int = 42, rotation: np.ndarray | None = None) -> Codebook:
    """One k-means a subspace, each in its own group of a bounded sample."""
    taken = sample(df.select(id_col, vec_col), id_col)
    dim = len(taken.first()[vec_col])
    if dim % m:
        raise ValueError(f"{m} subspaces don't divide {dim} dimensions")
    width = dim // m

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = np.stack(rows["v"].to_numpy()).astype(np.float64)
            x = x if rotation is None else x @ rotation
            for j in range(m):
                yield pd.DataFrame({"sub": j, "id": rows["id"], "v": list(x[:, j * width : (j + 1) * width])})

    def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        c = kmeans(np.stack(rows["v"].to_numpy()), codes, iterations, seed + key[0])
        return pd.DataFrame({"sub": key[0], "code": range(codes), "v": list(c)})

    parts = taken.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInPandas(run, "sub int, id long, v array<double>")
    got = parts.groupBy("sub").applyInPandas(train, "sub int, code int, v array<double>").collect()
    out = np.zeros((m, codes, width))
    for r in got:
        out[r["sub"], r["code"]] = r["v"]
    return Codebook(out, rotation)


def nearest_orthogonal(a: np.ndarray) -> np.ndarray:
    """The orthogonal matrix nearest to ``a``: UV' of its singular value decomposition."""
    u, _, v = np.linalg.svd(a)
    return u @ v


def train_opq(df: DataFrame, m: int, rounds: int = 4, id_col: str = "vec_id", vec_col: str = "embedding", codes: int = 256, seed: int = 42, rows: int = 20_000) -> Codebook:
    """Alternate codebooks and rotations on a bounded sample, then train on the rotated vectors."""
    x = np.array([r[0] for r in sample(df.select(vec_col, id_col), id_col, rows, seed).select(vec_col).collect()], np.float64)
    r = np.eye(x.shape[1])
    width = x.shape[1] // m
    for t in range(rounds):
        y = x @ r
        book = Codebook(np.stack([kmeans(y[:, j * width : (j + 1) * width], codes, 4, seed + j + t) for j in range(m)]))
        r = nearest_orthogonal(x.T @ book.decode(book.encode(y)))
    return train_pq(df, m, id_col, vec_col, codes, 25, seed, r)


def first_rows_codebook(df: DataFrame, m: int, codes: int, id_col: str = "vec_id", vec_col: str = "embedding") -> Codebook:
    """A codebook without training: the subvectors of the rows with the smallest ids."""
    x = np.array([r[0] for r in df.orderBy(id_col).limit(codes).select(F.col(vec_col).cast("array<double>")).collect()], np.float64)
    return Codebook(np.ascontiguousarray(x.reshape(len(x), m, -1).transpose(1, 0, 2)))


def pq_encode(df: DataFrame, book: Codebook, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, code array<smallint>)."""
    shared = df.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            codes = own.encode(matrix(batch.column(1), own.centroids.shape[0] * own.centroids.shape[2]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * own.m), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "code"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, "id long, code array<smallint>").withColumnRenamed("id", id_col)


def half_round_trip(x: np.ndarray) -> np.ndarray:
    """Through float16, to the nearest even."""
    return x.astype(np.float32).astype(np.float16).astype(np.float32)


#: Forms that an index stores vectors in.
STORED = ("none", "int8", "f16", "f32")


def pack_vectors(x: np.ndarray, form: str) -> list[bytes]:
    """Rows as bytes: float32, float16, or a float32 scale and int8 values (half to even)."""
    x = np.asarray(x, np.float32)
    if form == "int8":
        top = np.abs(x).max(1, initial=0)
        scale = np.where(top > 0, top / np.float32(127), 1).astype("<f4")
        q = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
        return [s.tobytes() + r.tobytes() for s, r in zip(scale, q, strict=True)]
    if form not in ("f16", "f32"):
        raise ValueError(f"vectors can't be stored as {form}")
    return [r.tobytes() for r in x.astype("<f2" if form == "f16" else "<f4")]


def unpack_vectors(rows: list[bytes], form: str, dim: int) -> np.ndarray:
    """float32 rows of what ``pack_vectors`` gave."""
    flat = b"".join(rows)
    if form == "int8":
        whole = np.frombuffer(flat, np.uint8).reshape(len(rows), dim + 4)
        scale = np.ascontiguousarray(whole[:, :4]).view("<f4")
        return (np.ascontiguousarray(whole[:, 4:]).view(np.int8) * scale).astype(np.float32)
    return np.frombuffer(flat, "<f2" if form == "f16" else "<f4").reshape(len(rows), dim).astype(np.float32)


def packed(df: DataFrame, vec_col: str, form: str) -> DataFrame:
    """``df`` with the vectors in their stored form, as bytes; without them for "none"."""
    if form == "none":
        return df.drop(vec_col)

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else pack_vectors(np.asarray(x)[None], form)[0] for x in v], dtype=object)

    return df.withColumn(vec_col, pack(F.col(vec_col).cast("array<float>")))


def unpacked(df: DataFrame, vec_col: str, form: str, dim: int) -> DataFrame:
    """``df`` with stored vectors as array<float>."""

    @F.pandas_udf("array<float>")
    def unpack(v: pd.Series) -> pd.Series:
        rows = iter(unpack_vectors([x for x in v if x is not None], form, dim))
        return pd.Series([None if x is None else next(rows) for x in v], dtype=object)

    return df.withColumn(vec_col, unpack(F.col(vec_col)))


def centroid_form(n_lists: int, given: str = "auto") -> str:
    """How coarse centroids are stored: product codes from 1,024 lists on, else int8."""
    return given if given != "auto" else "pq" if n_lists >= 1024 else "int8"


def quantize_centroids(x: np.ndarray, bits: int = 8) -> np.ndarray:
    """Rows through int8 or int4 with a float16 scale (half away from zero)."""
    top = 127 if bits == 8 else 7
    scale = half_round_trip(np.abs(x).max(1, keepdims=True) / top)
    safe = np.where(scale > 0, scale, 1)
    q = np.sign(x) * np.floor(np.abs(x / safe) + 0.5)
    return np.clip(q, -top, top) * safe


def pack_residual(buckets: np.ndarray, bits: int) -> bytes:
    """Bucket numbers, each with its low bit first, packed high bit of the byte first."""
    spread = (buckets[:, None] >> np.arange(bits)) & 1
    return np.packbits(spread.astype(np.uint8).ravel()).tobytes()


def unpack_residual(data: bytes, n: int, bits: int) -> np.ndarray:
    spread = np.unpackbits(np.frombuffer(data, np.uint8))[: n * bits].reshape(n, bits)
    return (spread.astype(np.int64) << np.arange(bits)).sum(1)


def pack_ids(ids: list[int], bits: int) -> bytes:
    """Little-endian bit stream of n-bit numbers."""
    stream = sum(i << (k * bits) for k, i in enumerate(ids))
    return stream.to_bytes((len(ids) * bits + 7) // 8, "little")


def unpack_ids(data: bytes, n: int, bits: int) -> list[int]:
    stream = int.from_bytes(data, "little")
    return [stream >> (k * bits) & ((1 << bits) - 1) for k in range(n)]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])
