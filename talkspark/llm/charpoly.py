"""Exact spectra of integer symmetric matrices: characteristic polynomial, real roots, null spaces.

The polynomial is found modulo many primes (Hessenberg reduction) and put together by Chinese
remaindering.  All its roots are real, so the sign changes of a Taylor shift count the roots above
a point exactly (Descartes), and bisection isolates them.  Vectors come from inverse iteration in
fixed-point integers.  Matrices are as wide as the vectors, never as long as the data.
"""

from __future__ import annotations

import math

import numpy as np

PRIME_BITS = 31


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all n below 3,215,031,751."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7) if n != p):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (0, 1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            continue
        return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes under 2^31 whose product has more than ``bits`` bits."""
    out, product, n = [], 1, (1 << PRIME_BITS) - 1
    while product.bit_length() <= bits:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def coefficient_bits(d: int, trace: int) -> int:
    """Bits that hold twice any coefficient of det(xI - A), A positive semidefinite: e_k <= C(d, k) (trace / d)^k."""
    most = max(math.comb(d, k) * trace**k // d**k for k in range(d + 1))
    return most.bit_length() + 3


def modular(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo ``p`` of det(xI - a), lowest first; ``a`` holds residues as int64."""
    h, d = a % p, len(a)
    for m in range(1, d - 1):
        pivots = np.flatnonzero(h[m:, m - 1])
        if not len(pivots):
            continue
        i = m + int(pivots[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        weight, run = np.zeros(k, np.int64), 1
        weight[k - 1] = h[k - 1, k - 1]
        for i in range(k - 2, -1, -1):
            run = run * int(h[i + 1, i]) % p
            if not run:
                break
            weight[i] = run * int(h[i, k - 1]) % p
        poly[k, 1:] = poly[k - 1, :-1]
        poly[k] = (poly[k] - (weight[:, None] * poly[:k] % p).sum(0)) % p
    return poly[d]


def remaindered(residues: dict[int, list[int]]) -> list[int]:
    """The integers of least size with the given residues: ``residues`` maps a prime to a list."""
    product = math.prod(residues)
    total = [0] * len(next(iter(residues.values())))
    for p, values in residues.items():
        others = product // p
        lift = others * pow(others, -1, p)
        total = [t + int(v) * lift for t, v in zip(total, values)]
    return [t - product if t > product // 2 else t for t in (t % product for t in total)]


def trimmed(f: list[int]) -> list[int]:
    while f and f[-1] == 0:
        f = f[:-1]
    return f


def primitive(f: list[int]) -> list[int]:
    f = trimmed(f)
    content = math.gcd(*f) if f else 1
    return [c // content * (1 if f[-1] > 0 else -1) for c in f]


def common(f: list[int], g: list[int]) -> list[int]:
    """Greatest common divisor of two integer polynomials, primitive."""
    f, g = primitive(f), primitive(g)
    while g:
        rest = list(f)
        while len(rest) >= len(g):
            lead = rest[-1]
            rest = [c * g[-1] for c in rest]
            at = len(rest) - len(g)
            for i, c in enumerate(g):
                rest[at + i] -= lead * c
            rest = trimmed(rest[:-1])
        f, g = g, primitive(rest)
    return f


def quotient(f: list[int], g: list[int]) -> list[int]:
    """f / g where that is exact up to a rational factor; primitive."""
    scale = g[-1] ** max(0, len(f) - len(g) + 1)
    rest, out = [c * scale for c in f], []
    while len(rest) >= len(g):
        out.append(rest[-1] // g[-1])
        at = len(rest) - len(g)
        for i, c in enumerate(g):
            rest[at + i] -= out[-1] * c
        rest.pop()
    return primitive(out[::-1])


def derivative(f: list[int]) -> list[int]:
    return [k * c for k, c in enumerate(f)][1:]


def coprime_with_derivative(f: list[int], p: int) -> bool:
    """Whether f has no double root modulo p, which proves that it has none at all."""
    a, b = [c % p for c in f], [c % p for c in derivative(f)]
    if not a[-1] or not trimmed(b):
        return False
    b = trimmed(b)
    while b:
        inverse = pow(b[-1], -1, p)
        while len(a) >= len(b):
            lead = a[-1] * inverse % p
            at = len(a) - len(b)
            for i, c in enumerate(b):
                a[at + i] = (a[at + i] - lead * c) % p
            a = trimmed(a)
        a, b = b, a
    return len(a) == 1


def squarefree(f: list[int]) -> list[tuple[list[int], int]]:
    """Factors without double roots, each with the multiplicity of its roots in f."""
    if any(coprime_with_derivative(f, p) for p in primes(90)):
        return [(primitive(f), 1)]
    out, rest, times = [], primitive(f), 1
    shared = common(rest, derivative(rest))
    flat = quotient(rest, shared)
    while len(flat) > 1:
        deeper = common(flat, shared)
        own = quotient(flat, deeper)
        if len(own) > 1:
            out.append((own, times))
        shared, flat, times = quotient(shared, deeper), deeper, times + 1
    return out


def shifted(f: list[int], by: int) -> list[int]:
    """Coefficients of f(x + by)."""
    out = list(f)
    for i in range(len(out) - 1):
        for k in range(len(out) - 2, i - 1, -1):
            out[k] += by * out[k + 1]
    return out


def above(f: list[int], point: int) -> int:
    """Number of roots of a real-rooted f that are greater than ``point``."""
    signs = [c > 0 for c in shifted(f, point) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def scaled(f: list[int], bits: int) -> list[int]:
    """A polynomial whose roots are 2^bits times those of f."""
    top = len(f) - 1
    return [c << bits * (top - k) for k, c in enumerate(f)]


def isolate(f: list[int], most: int, high: int) -> list[tuple[int, int, int]]:
    """(low, high, bits) for each of the ``most`` largest positive roots of f, all real and simple.

    A root lies in (low, high] / 2^bits and no other does.
    """
    out: list[tuple[int, int, int]] = []
    work = [(0, high, 0, above(f, 0), above(f, high))]
    held = {0: f}
    while work and len(out) < most:
        low, high, bits, at_low, at_high = work.pop()
        if at_low - at_high == 1:
            out.append((low, high, bits))
        elif at_low > at_high:
            if high - low < 2:
                low, high, bits = low << 16, high << 16, bits + 16
            g = held.setdefault(bits, scaled(f, bits))
            middle = (low + high) // 2
            at = above(g, middle)
            work += [(low, middle, bits, at_low, at), (middle, high, bits, at, at_high)]
    return out


def value(f: list[int], x: int) -> int:
    out = 0
    for c in reversed(f):
        out = out * x + c
    return out


def refine(f: list[int], low: int, high: int, bits: int, to: int) -> int:
    """The root of (low, high] / 2^bits as an integer over 2^to, at most one unit above it."""
    if to > bits:
        low, high, bits = low << to - bits, high << to - bits, to
    g = scaled(f, bits)
    rising = value(g, high) > 0 or (value(g, high) == 0 and value(g, low) < 0)
    while high - low > 1:
        middle = (low + high) // 2
        v = value(g, middle)
        if v == 0:
            return middle
        if (v > 0) == rising:
            high = middle
        else:
            low = middle
    return high


def largest_roots(f: list[int], most: int, trace: int) -> list[tuple[int, int, int]]:
    """(root, bits, multiplicity) of the largest positive roots, falling, ``most`` with multiplicity.

    A root is an integer over 2^bits, so exact that the error is under 2^-80 of its size and of the
    distance to the next root.
    """
    zeros = next((k for k, c in enumerate(f) if c), len(f))
    if zeros >= len(f) - 1:
        return []
    found = [(g, times, piece) for g, times in squarefree(f[zeros:]) for piece in isolate(g, most + 1, trace)]
    to = 64
    while True:
        roots = sorted(((refine(g, low, high, bits, to + bits), to + bits, times) for g, times, (low, high, bits) in found), key=lambda r: -(r[0] << 8192 >> r[1]))
        widest = max(r[1] for r in roots)
        even = [r[0] << widest - r[1] for r in roots]
        gaps = [a - b for a, b in zip(even, even[1:])] + [even[-1]]
        if min(gaps) >> 80 + widest - min(r[1] for r in roots) > 0:
            break
        to *= 2
    out, have = [], 0
    for root, bits, times in roots:
        if have >= most:
            break
        out.append((root, bits, times))
        have += times
    return out


def null_space(a: np.ndarray, root: int, bits: int, dimension: int) -> np.ndarray:
    """Orthonormal eigenvectors (rows, doubles) of the integer matrix ``a`` at root / 2^bits.

    Inverse iteration: LU with row exchange of a - root, twice solved, all in integers with
    ``bits`` and guard bits after the point.
    """
    d = len(a)
    work = 2 * bits + 2 * int(max(abs(int(v)) for v in a.flat)).bit_length() + 128
    m = np.array([[int(v) << work for v in row] for row in a], dtype=object)
    for i in range(d):
        m[i, i] -= root << work - bits
    order = np.arange(d)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
        if pivot != k:
            m[[k, pivot]] = m[[pivot, k]]
            order[[k, pivot]] = order[[pivot, k]]
        if m[k, k] == 0:
            m[k, k] = 1  # the root is exact: the least unit stands for zero
        if k + 1 < d:
            factor = np.array([(int(v) << work) // int(m[k, k]) for v in m[k + 1 :, k]], dtype=object)
            m[k + 1 :, k + 1 :] -= (factor[:, None] * m[k, k + 1 :][None, :]) >> work
            m[k + 1 :, k] = factor
    rng = np.random.default_rng(d)
    block = [np.array([int(v) << work - 32 for v in rng.integers(-(1 << 31), 1 << 31, d)], dtype=object) for _ in range(dimension)]
    for _ in range(2):
        block = _orthonormal([_solve(m, order, v, work) for v in block], work)
    out = np.array([[int(v) / (1 << work) for v in row] for row in block])
    sign = np.sign(out[np.arange(dimension), np.abs(out).argmax(1)])
    return out * sign[:, None]


def _solve(lu: np.ndarray, order: np.ndarray, right: np.ndarray, work: int) -> np.ndarray:
    x = right[order].copy()
    for k in range(len(x) - 1):
        x[k + 1 :] -= (lu[k + 1 :, k] * x[k]) >> work
    for k in range(len(x) - 1, -1, -1):
        x[k] = (int(x[k]) << work) // int(lu[k, k])
        x[:k] -= (lu[:k, k] * x[k]) >> work
    return x


def _orthonormal(block: list[np.ndarray], work: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for v in block:
        top = max(abs(int(x)) for x in v)
        v = np.array([(int(x) << work) // top for x in v], dtype=object)
        for _ in range(2):
            for u in out:
                v = v - ((u * (int((u * v).sum()) >> work)) >> work)
        norm = math.isqrt(int((v * v).sum()))
        out.append(np.array([(int(x) << work) // norm for x in v], dtype=object))
    return out
