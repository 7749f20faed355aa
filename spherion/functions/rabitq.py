"""Randomized-rotation scalar quantization in numpy: rotation, 1-bit codes with bounds, 1/2-bit, 4-bit and 8-bit codes."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

#: The seed bytes and rounds of the generator of sign bits, and sign bits per pass.
SEED, ROUNDS, PASS_BITS = bytes([7] * 32), 12, 65536


def chacha_words(blocks: int, seed: bytes = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """Keystream words of ChaCha with a 64-bit block counter and stream 0, all blocks at once."""
    state = np.zeros((16, blocks), np.uint32)
    state[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    state[4:12] = np.frombuffer(seed, "<u4")[:, None]
    state[12] = np.arange(blocks, dtype=np.uint64).astype(np.uint32)
    x = state.copy()

    def turn(v, n):
        return (v << np.uint32(n)) | (v >> np.uint32(32 - n))

    columns = [(k, 4 + k, 8 + k, 12 + k) for k in range(4)]
    diagonals = [(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4) for k in range(4)]
    for quarter in (columns + diagonals) * (rounds // 2):
        a, b, c, d = quarter
        for into, other, mixed, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            x[into] += x[other]
            x[mixed] = turn(x[mixed] ^ x[into], n)
    return (x + state).T.ravel()


@lru_cache(1)
def sign_passes() -> np.ndarray:
    """Four rows of signs, +1 or -1: the low byte of each keystream word gives eight, low bit first."""
    low = (chacha_words(4 * PASS_BITS // 8 // 16) & 0xFF).astype(np.uint8)
    return 1.0 - 2.0 * np.unpackbits(low, bitorder="little").reshape(4, PASS_BITS)


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def _pass(x: np.ndarray, k: int, back: bool) -> np.ndarray:
    """Signs, a Hadamard transform of the first (even pass) or last power of two, a mix of halves; or its inverse."""
    n = x.shape[1]
    power = 1 << (n.bit_length() - 1)
    part = slice(0, power) if k % 2 == 0 else slice(n - power, n)
    signs = sign_passes()[k, :n]

    def mix(x):
        if n == power:
            return x
        m = n // 2
        out = x.copy()
        out[:, :m], out[:, n - m :] = (x[:, :m] + x[:, n - m :]) / np.sqrt(2), (x[:, :m] - x[:, n - m :]) / np.sqrt(2)
        return out

    if back:
        x = mix(x).copy()
        x[:, part] = _hadamard(x[:, part])
        return x * signs
    x = x * signs
    x[:, part] = _hadamard(x[:, part])
    return mix(x)


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows rotated by a fixed orthogonal map."""
    x = np.atleast_2d(np.asarray(x, np.float64))
    for k in range(4):
        x = _pass(x, k, False)
    return x


def rotate_back(x: np.ndarray) -> np.ndarray:
    x = np.atleast_2d(np.asarray(x, np.float64))
    for k in reversed(range(4)):
        x = _pass(x, k, True)
    return x


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    """The map of ``rotate`` as a matrix: ``x @ rotation(dim)`` equals it but for rounding, and is faster for many rows."""
    return rotate(np.eye(dim))


# One bit

def binary_code(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Signs (True where not negative) and the factors of the estimator, for rows of rotated vectors."""
    n = x.shape[1]
    square, total = (x * x).sum(1), np.abs(x).sum(1)
    length = np.sqrt(square)
    with np.errstate(invalid="ignore", divide="ignore"):
        x0 = total / length / np.sqrt(n)
        error = length * np.sqrt(np.maximum(1 / (x0 * x0) - 1, 0)) / np.sqrt(max(n - 1, 1))
        ip = square / total
    signs = ~np.signbit(x)
    return signs, {"dis_u_2": square, "factor_cnt": 2.0 * signs.sum(1) - n, "factor_ip": np.nan_to_num(ip), "factor_err": np.nan_to_num(error)}


def binary_estimate(metric: str, signs: np.ndarray, factors: dict, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rough, error) of squared L2 (``l2``) or minus the inner product (``ip``) to a rotated query."""
    inner = factors["factor_ip"] * (np.where(signs, 1.0, -1.0) @ query)
    length = np.sqrt(query @ query)
    if metric == "l2":
        return factors["dis_u_2"] + query @ query - 2 * inner, 2 * factors["factor_err"] * length
    return -inner, factors["factor_err"] * length


def binary_products(signs: np.ndarray, factors: dict, queries: np.ndarray) -> np.ndarray:
    """Estimated inner products with several rotated queries, a row per query."""
    return (queries @ np.where(signs, 1.0, -1.0).T) * factors["factor_ip"]


def lower_bound(metric: str, signs, factors, query, epsilon: float = 1.9) -> np.ndarray:
    rough, error = binary_estimate(metric, signs, factors, query)
    return rough - epsilon * error


# More bits

def _best_scale(o: np.ndarray, bits: int) -> float:
    """The scale at which the rounded-down lattice point is closest in angle, over all scales at which a code changes."""
    steps = np.arange(1, 1 << (bits - 1))
    if not len(steps):
        return float(np.finfo(np.float32).eps)
    positive = np.flatnonzero(o > 0)
    at = (steps[None, :] / o[positive, None]).ravel()
    gain = np.repeat(o[positive], len(steps))
    level = np.tile(steps, len(positive))
    order = np.argsort(at, kind="stable")
    top = 0.5 * o.sum() + np.cumsum(gain[order])
    bottom = 0.25 * len(o) + np.cumsum(2.0 * level[order])
    quality = np.concatenate([[0.5 * o.sum() / np.sqrt(0.25 * len(o))], top / np.sqrt(bottom)])
    k = int(np.argmax(quality))
    return (0.0 if k == 0 else float(at[order][k - 1])) + float(np.finfo(np.float32).eps)


def lattice_code(x: np.ndarray, bits: int, exhaustive: bool | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Unsigned codes of rows of rotated vectors.  Up to two bits search the scale, more take 2^(bits-1) / max|o|."""
    if not 1 <= bits <= 8:
        raise ValueError("bits must be from 1 to 8")
    exhaustive = bits <= 2 if exhaustive is None else exhaustive
    square = (x * x).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = np.nan_to_num(x / np.sqrt(square)[:, None])
        scale = np.array([_best_scale(np.abs(u), bits) for u in unit]) if exhaustive else np.nan_to_num((1 << (bits - 1)) / np.abs(unit).max(1), posinf=0.0)
    half = 1 << (bits - 1)
    code = (np.clip(np.floor(unit * scale[:, None]), -half, half - 1) + half).astype(np.uint8)
    lattice = code.astype(np.float64) - ((1 << bits) - 1) / 2
    return code, {"sum_of_x2": square, "norm_of_lattice": np.sqrt((lattice * lattice).sum(1)), "sum_of_code": code.sum(1, dtype=np.float64), "sum_of_abs_x": np.abs(x).sum(1)}


def code_distance(metric: str, bits: int, a: tuple, b: tuple) -> np.ndarray:
    """Distance in code space of rows with equal places.  ``cosine`` is minus the cosine, without the one."""
    (x, mx), (y, my) = a, b
    h = ((1 << bits) - 1) / 2
    inner = (x.astype(np.float64) * y).sum(1) - h * (mx["sum_of_code"] + my["sum_of_code"]) + x.shape[1] * h * h
    with np.errstate(invalid="ignore", divide="ignore"):
        sx, sy = np.sqrt(mx["sum_of_x2"]) / mx["norm_of_lattice"], np.sqrt(my["sum_of_x2"]) / my["norm_of_lattice"]
        if metric == "ip":
            return -inner * sx * sy
        if metric == "cosine":
            return -inner / (mx["norm_of_lattice"] * my["norm_of_lattice"])
    return np.sqrt(np.maximum(mx["sum_of_x2"] + my["sum_of_x2"] - 2 * inner * sx * sy, 0))


def quantize(x: np.ndarray, bits: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    return lattice_code(rotate(x), bits)


def dequantize(code: np.ndarray, factors: dict, bits: int) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        scale = np.sqrt(factors["sum_of_x2"]) / factors["norm_of_lattice"]
    return rotate_back((code - ((1 << bits) - 1) / 2) * scale[:, None])


def pack(code: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of rows of codes: a byte each, or for four bits two in a byte, low half first."""
    if bits == 8:
        return code
    if code.shape[1] % 2:
        code = np.hstack([code, np.zeros((len(code), 1), np.uint8)])
    return code[:, ::2] | (code[:, 1::2] << 4)


def unpack(packed: np.ndarray, bits: int, dim: int) -> np.ndarray:
    if bits == 8:
        return packed[:, :dim]
    return np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)[:, :dim]


# Text and binary forms

FIELDS = ("sum_of_x2", "norm_of_lattice", "sum_of_code", "sum_of_abs_x")


def format_code(factors: dict[str, float], code: np.ndarray) -> str:
    return "(" + ", ".join(f"{np.float32(factors[f])}" for f in FIELDS) + ")[" + ", ".join(map(str, code.tolist())) + "]"


def parse_code(text: str, bits: int = 8) -> tuple[dict[str, float], np.ndarray]:
    m = re.fullmatch(r"\s*\(([^()]*)\)\s*\[([^\[\]]*)\]\s*", text)
    numbers = [float(np.float32(v)) for v in m[1].split(",")] if m else []
    codes = [int(v) for v in m[2].split(",")] if m and m[2].strip() else []
    if len(numbers) != 4 or not 1 <= len(codes) <= 65535 or not all(0 <= c < 1 << bits for c in codes):
        raise ValueError("incorrect quantized vector")
    return dict(zip(FIELDS, numbers)), np.array(codes, np.uint8)


def send_code(factors: dict[str, float], code: np.ndarray, bits: int = 8) -> bytes:
    """Big-endian dimension and factors, then the packed code."""
    return struct.pack(">I4f", len(code), *(factors[f] for f in FIELDS)) + pack(code[None, :], bits).tobytes()


def receive_code(data: bytes, bits: int = 8) -> tuple[dict[str, float], np.ndarray]:
    dim, *numbers = struct.unpack_from(">I4f", data)
    packed = np.frombuffer(data, np.uint8, offset=20)
    if not 1 <= dim <= 65535 or len(packed) != (dim if bits == 8 else (dim + 1) // 2):
        raise ValueError("incorrect quantized vector")
    return dict(zip(FIELDS, numbers)), unpack(packed[None, :], bits, dim)[0]
