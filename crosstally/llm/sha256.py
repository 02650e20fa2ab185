"""SHA-256 over many messages at once, with states that can be stored and resumed.

``hashlib`` can copy a running hash but not store it; here a state is eight 32-bit words, a row of an
array, so that it travels between tasks. Messages are whole blocks of 64 bytes, which the hexadecimal
text of a digest is.
"""

from __future__ import annotations

import math

import numpy as np

BLOCK, STATE = 64, 32


def _primes(count: int) -> list[int]:
    found: list[int] = []
    n = 2
    while len(found) < count:
        if all(n % p for p in found):
            found.append(n)
        n += 1
    return found


def _fraction(prime: int, root: int) -> int:
    """The first 32 bits after the point of a prime's square or cube root, as the standard has it."""
    scaled = prime << (32 * root)
    if root == 2:
        return math.isqrt(scaled) & 0xFFFFFFFF
    low = round(scaled ** (1 / 3))
    while low**3 > scaled:
        low -= 1
    while (low + 1) ** 3 <= scaled:
        low += 1
    return low & 0xFFFFFFFF


START = np.array([_fraction(p, 2) for p in _primes(8)], np.uint32)
_ROUND = [np.uint32(_fraction(p, 3)) for p in _primes(64)]


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def resumed(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The states (n, 8) after one more block each; ``blocks``: (n, 64) bytes."""
    words = np.ascontiguousarray(blocks).view(">u4").astype(np.uint32).T
    w = [np.ascontiguousarray(words[i]) for i in range(16)]
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w.append(
            w[i - 16] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))) + w[i - 7]
            + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10)))
        )
    a, b, c, d, e, f, g, h = (np.ascontiguousarray(states[:, i]) for i in range(8))
    for i in range(64):
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[i] + w[i]
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def begun(n: int) -> np.ndarray:
    return np.repeat(START[None, :], n, axis=0)


def last_block(length: int) -> np.ndarray:
    """The padding after ``length`` bytes of whole blocks."""
    block = np.zeros(BLOCK, np.uint8)
    block[0] = 0x80
    block[-8:] = np.frombuffer((8 * length).to_bytes(8, "big"), np.uint8)
    return block


_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def told(states: np.ndarray) -> np.ndarray:
    """Ended states as lowercase hexadecimal text, (n, 64) bytes."""
    raw = states.astype(">u4").view(np.uint8).reshape(len(states), STATE)
    return np.stack([_DIGITS[raw >> 4], _DIGITS[raw & 15]], axis=2).reshape(len(states), BLOCK)


def stored_states(states: np.ndarray) -> np.ndarray:
    """States as rows of 32 bytes."""
    return states.astype(">u4").view(np.uint8).reshape(len(states), STATE)


def read_states(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view(">u4").astype(np.uint32).reshape(-1, 8)
