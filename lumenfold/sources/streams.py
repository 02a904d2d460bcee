"""First draws of many random streams at once: numpy's seed sequence and PCG64 as array operations.

``states`` seeds a generator for each name as ``numpy.random.default_rng(SeedSequence([seed, *words]))`` does, the words
being the first four of the name's SHA-256; ``first`` is the first 64 bits of each. A draw of one number from each stream is
an expression over these, where numpy makes and seeds an object for each.
"""

from __future__ import annotations

import hashlib

# Constants of the seed sequence and of PCG64 (XSL-RR, 128 bits of state).
INIT_A, MULT_A = 0x43B0D7E5, 0x931E8875
INIT_B, MULT_B = 0x8B51F9DD, 0x58F38DED
MIX_L, MIX_R, SHIFT, POOL = 0xCA01F9DD, 0x4973F715, 16, 4
PCG_HIGH, PCG_LOW = 2549297995355413924, 4865540595714422341


def words_of(names: list[str]):
    """The first four big-endian words of each name's SHA-256, one row a name."""
    import numpy as np

    return np.frombuffer(b"".join(hashlib.sha256(n.encode()).digest()[:16] for n in names), ">u4").reshape(len(names), 4).astype(np.uint32)


class _Hash:
    """The running constant of the seed sequence's hash."""

    def __init__(self, start: int, factor: int):
        self.now, self.factor = start, factor

    def __call__(self, value):
        import numpy as np

        value = value ^ np.uint32(self.now)
        self.now = self.now * self.factor & 0xFFFFFFFF
        value = value * np.uint32(self.now)
        return value ^ (value >> np.uint32(SHIFT))


def _mixed(x, y):
    import numpy as np

    out = np.uint32(MIX_L) * x - np.uint32(MIX_R) * y
    return out ^ (out >> np.uint32(SHIFT))


def seeds(seed: int, words):
    """Four 64-bit seed words for each row of words."""
    import numpy as np

    entropy = [np.full(len(words), seed, np.uint32), *words.T]
    step = _Hash(INIT_A, MULT_A)
    pool = [step(x) for x in entropy[:POOL]]
    for source in range(POOL):
        for target in range(POOL):
            if source != target:
                pool[target] = _mixed(pool[target], step(pool[source]))
    for x in entropy[POOL:]:
        for target in range(POOL):
            pool[target] = _mixed(pool[target], step(x))
    step = _Hash(INIT_B, MULT_B)
    out = [step(pool[k % POOL]).astype(np.uint64) for k in range(8)]
    return [low | high << np.uint64(32) for low, high in zip(out[::2], out[1::2])]


def _times(high, low):
    """A 128-bit number times the multiplier of PCG64."""
    import numpy as np

    mask, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a, b, c, d = low >> half, low & mask, np.uint64(PCG_LOW >> 32), np.uint64(PCG_LOW & 0xFFFFFFFF)
    middle = a * d + (b * d >> half)
    other = b * c + (middle & mask)
    carried = a * c + (middle >> half) + (other >> half)
    return carried + high * np.uint64(PCG_LOW) + low * np.uint64(PCG_HIGH), low * np.uint64(PCG_LOW)


def _plus(high, low, more_high, more_low):
    import numpy as np

    out = low + more_low
    return high + more_high + (out < low).astype(np.uint64), out


def states(seed: int, names: list[str]):
    """Of each stream, the state and the increment of PCG64 after seeding, as high and low words."""
    import numpy as np

    with np.errstate(over="ignore"):
        start_high, start_low, turn_high, turn_low = seeds(seed, words_of(names))
        step_high, step_low = turn_high << np.uint64(1) | turn_low >> np.uint64(63), turn_low << np.uint64(1) | np.uint64(1)
        # from zero, a step leaves the increment
        high, low = _plus(step_high, step_low, start_high, start_low)
        return *_plus(*_times(high, low), step_high, step_low), step_high, step_low


def first(seed: int, names: list[str]):
    """The first 64 random bits of each stream."""
    import numpy as np

    with np.errstate(over="ignore"):
        high, low, step_high, step_low = states(seed, names)
        high, low = _plus(*_times(high, low), step_high, step_low)
        turn, bits = high >> np.uint64(58), high ^ low
        return bits >> turn | bits << (np.uint64(64) - turn & np.uint64(63))


def uniform(seed: int, names: list[str]):
    """``random()`` of each stream."""
    import numpy as np

    return (first(seed, names) >> np.uint64(11)).astype(float) * 2.0**-53


def below(seed: int, names: list[str], n: int):
    """``integers(0, n)`` of each stream, for n under 2 ** 32."""
    import numpy as np

    product = (first(seed, names) & np.uint64(0xFFFFFFFF)) * np.uint64(n)
    out = (product >> np.uint64(32)).astype(np.int64)
    for k in np.flatnonzero((product & np.uint64(0xFFFFFFFF)) < np.uint64((2**32 - n) % n)):  # one in billions draws again
        out[k] = next(generators(seed, [names[k]])).integers(0, n)
    return out


def generators(seed: int, names: list[str]):
    """A generator at the start of each stream, one after the other (it is one object that moves on)."""
    import numpy as np

    bits = np.random.PCG64(0)
    made = np.random.Generator(bits)
    for high, low, step_high, step_low in zip(*(x.tolist() for x in states(seed, names))):
        bits.state = {"bit_generator": "PCG64", "state": {"state": high << 64 | low, "inc": step_high << 64 | step_low}, "has_uint32": 0, "uinteger": 0}
        yield made
