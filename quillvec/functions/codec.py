"""Vector codec in NumPy: rotation, quantisation, bit packing, sketches, and how a query is scored against packed codes.

The Arrow functions of ``operators.search`` and ``operators.index`` call these on whole batches; ``exprs`` has the same
steps as Catalyst expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quillvec.config import IndexConfig

TINY, WHOLE_ROTATION, BLOCK = 1e-12, 2048, 512


def _haar(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def rotation(dim: int, seed: int = 42, kind: str = "haar") -> np.ndarray:
    """An orthogonal matrix, the same for the same arguments; in blocks beyond 2048 dimensions.

    ``srht`` is the Hadamard matrix scaled to length one (dim must be a power of two), with signs flipped by the seed;
    seed 0 flips none, so that SQL can write it down.
    """
    if dim < 1:
        raise ValueError("there must be at least one dimension")
    if kind == "identity":
        return np.eye(dim, dtype=np.float32)
    if kind == "srht":
        if dim & (dim - 1):
            raise ValueError("srht needs a power of two")
        i = np.arange(dim)
        signs = 1 - 2 * (np.bitwise_count(i[:, None] & i[None, :]) & 1).astype(np.float64)
        flips = np.ones(dim) if seed == 0 else np.random.default_rng(seed).choice([-1.0, 1.0], dim)
        return (signs * flips / np.sqrt(dim)).astype(np.float32)
    if dim <= WHOLE_ROTATION:
        return _haar(dim, seed)
    out = np.zeros((dim, dim), np.float32)
    for start in range(0, dim, BLOCK):
        end = min(dim, start + BLOCK)
        out[start:end, start:end] = _haar(end - start, seed + start)
    return out


def normalize_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero."""
    x = np.atleast_2d(np.asarray(x, np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), TINY)


def _checked(bits: int, value_range: float = 1.0) -> int:
    if bits not in (2, 3, 4):
        raise ValueError("bits must be 2, 3 or 4")
    if not value_range > 0:
        raise ValueError("value_range must be positive")
    return 2**bits - 1


def bytes_per_vector(dim: int, bits: int) -> int:
    _checked(bits)
    if dim < 1:
        raise ValueError("there must be at least one dimension")
    return (dim * bits + 7) // 8


def levels_of(x: np.ndarray, bits: int = 3, value_range: float = 1.0) -> np.ndarray:
    """uint8 levels: clipped, scaled, rounded half to even."""
    top = _checked(bits, value_range)
    x = np.clip(np.atleast_2d(np.asarray(x, np.float64)), -value_range, value_range)
    return np.rint(np.round((x + value_range) / (2 * value_range) * top, 9)).astype(np.uint8)


def pack(levels: np.ndarray, bits: int) -> np.ndarray:
    """Rows of bytes, the least significant bit of the first level first."""
    _checked(bits)
    planes = (levels[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(len(levels), -1), axis=1, bitorder="little")


def unpack(codes: np.ndarray, dim: int, bits: int) -> np.ndarray:
    codes = np.atleast_2d(codes)
    if codes.shape[1] != bytes_per_vector(dim, bits):
        raise ValueError("codes have the wrong width")
    planes = np.unpackbits(codes, axis=1, bitorder="little", count=dim * bits).reshape(len(codes), dim, bits)
    out = planes[:, :, 0].copy()
    for b in range(1, bits):
        out |= planes[:, :, b] << np.uint8(b)
    return out


def quantize(x: np.ndarray, bits: int = 3, value_range: float = 1.0) -> np.ndarray:
    return pack(levels_of(x, bits, value_range), bits)


def dequantize(codes: np.ndarray, dim: int, bits: int = 3, value_range: float = 1.0) -> np.ndarray:
    top = _checked(bits, value_range)
    return (unpack(codes, dim, bits).astype(np.float64) / top * 2 * value_range - value_range).astype(np.float32)


def lookup_table(query: np.ndarray, bits: int, value_range: float = 1.0) -> np.ndarray:
    """float64[dim, levels]: what each level of each dimension adds to the score."""
    top = _checked(bits, value_range)
    grid = np.arange(top + 1) / top * 2 * value_range - value_range
    return np.outer(np.asarray(query, np.float64), grid)


def score_by_table(codes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    levels = unpack(codes, len(table), bits)
    return table[np.arange(len(table))[None], levels].sum(1)


def compressed_dot(query: np.ndarray, codes: np.ndarray, dim: int, bits: int = 3, value_range: float = 1.0) -> np.ndarray:
    """Dot products of one packed query with packed rows, both quantised."""
    query = np.atleast_2d(query)
    if len(query) != 1:
        raise ValueError("one query at a time")
    return score_by_table(codes, lookup_table(dequantize(query, dim, bits, value_range)[0], bits, value_range), bits)


def affine(queries: np.ndarray, bits: int, value_range: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of prepared queries: a score is levels @ weights + bias. This is the production scorer."""
    top = _checked(bits, value_range)
    q = np.atleast_2d(np.asarray(queries, np.float64))
    return (q * 2 * value_range / top).T, -value_range * q.sum(1)


def sketch(rotated: np.ndarray) -> np.ndarray:
    """One bit a dimension, set where it isn't negative; the most significant bit first, padded with zeros."""
    return np.packbits(np.atleast_2d(rotated) >= 0, axis=1)


def hamming(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(sketches, one)).sum(1, dtype=np.int32)


def prepare(queries: np.ndarray, config: IndexConfig, matrix: np.ndarray) -> np.ndarray:
    """Queries as the index sees them: normalised and rotated, not quantised."""
    q = np.atleast_2d(np.asarray(queries, np.float64))
    if q.ndim != 2 or q.shape[1] != config.dim:
        raise ValueError(f"queries must have {config.dim} dimensions")
    if config.normalize:
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), TINY)
    # rounded, so that no order of summation can move a value across the border of a level
    return np.round(q @ matrix.T.astype(np.float64), 9)


def encode(vectors: np.ndarray, config: IndexConfig, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, sketches) of rows."""
    rotated = prepare(vectors, config, matrix)
    return quantize(rotated, config.bits, config.value_range), sketch(rotated)


def matrix_of(column: pa.Array, dim: int, kind=np.float32) -> np.ndarray:
    """An Arrow list column as rows; a null or wrongly long vector is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("a vector is null")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dim or (len(column) and (np.diff(column.offsets.to_numpy()) != dim).any()):
        raise ValueError(f"vectors must have {dim} dimensions")
    return flat.reshape(len(column), dim).astype(kind, copy=False)


def bytes_of(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow binary column of equally long values as rows of bytes."""
    if len(column) == 0:
        return np.zeros((0, width), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.reshape(len(column), width)


def binary_of(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow binary column."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])
