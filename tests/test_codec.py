import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillvec.config import IndexConfig
from quillvec.functions import codec


@pytest.mark.parametrize("kind, dim", [("haar", 24), ("srht", 64), ("identity", 5)])
def test_rotation_is_orthogonal_and_repeatable(kind, dim):
    a = codec.rotation(dim, 7, kind)
    assert np.allclose(a @ a.T, np.eye(dim), atol=1e-5) and np.array_equal(a, codec.rotation(dim, 7, kind))


def test_large_rotation_is_in_blocks():
    a = codec.rotation(2100, 3)
    assert np.count_nonzero(a[:512, 512:]) == 0 and np.allclose(a @ a.T, np.eye(2100), atol=1e-4)


@given(bits=st.sampled_from([2, 3, 4]), dim=st.integers(1, 40), seed=st.integers(0, 99))
@settings(max_examples=40, deadline=None)
def test_pack_round_trip(bits, dim, seed):
    levels = np.random.default_rng(seed).integers(0, 2**bits, (5, dim)).astype(np.uint8)
    codes = codec.pack(levels, bits)
    assert codes.shape[1] == codec.bytes_per_vector(dim, bits) and np.array_equal(codec.unpack(codes, dim, bits), levels)


@pytest.mark.parametrize("bits", [2, 3, 4])
@pytest.mark.parametrize("dim", [8, 16, 64, 100])
def test_scorers_agree(bits, dim):
    rng = np.random.default_rng(42)
    x, q = rng.uniform(-1, 1, (20, dim)), rng.uniform(-1, 1, dim)
    codes = codec.quantize(x, bits)
    naive = codec.dequantize(codes, dim, bits).astype(float) @ q
    weights, bias = codec.affine(q, bits)
    assert np.allclose(codec.score_by_table(codes, codec.lookup_table(q, bits), bits), naive, atol=1e-4)
    assert np.allclose((codec.unpack(codes, dim, bits) @ weights + bias)[:, 0], naive, atol=1e-4)


def test_quantize_rules():
    assert np.abs(codec.dequantize(codec.quantize([[2.0, -3.0]], 4), 2, 4) - [[1, -1]]).max() < 1e-6
    x = np.random.default_rng(7).uniform(-1, 1, (8, 12))
    assert np.abs(codec.dequantize(codec.quantize(x, 3), 12, 3) - x).max() <= 0.3
    assert np.array_equal(codec.normalize_rows(np.zeros((1, 4))), np.zeros((1, 4)))
    for wrong in (lambda: codec.quantize(x, 5), lambda: codec.quantize(x, 3, 0), lambda: codec.rotation(0), lambda: codec.compressed_dot(codec.quantize(x), codec.quantize(x), 12), lambda: IndexConfig(0), lambda: IndexConfig(4, bits=1), lambda: IndexConfig(4, shard_size=0)):
        with pytest.raises(ValueError):
            wrong()


def test_hamming_and_sketch():
    s = codec.sketch(np.array([[1.0, -1, 0, 2, -3, 1, 1, 1, -1]]))
    assert s.tolist() == [[0b10110111, 0]] and codec.hamming(s, np.array([255, 128], np.uint8)).tolist() == [3]
