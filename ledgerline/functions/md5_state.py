"""MD5 whose state can be handed on, so that a text too long for one task goes through several, one after the other.

``hashlib`` keeps its state to itself; the functions of the libcrypto it is linked with do not. Where they are missing, as in a Python linked without
them, the same state is carried on in Python, which is slow.
"""

from __future__ import annotations

import ctypes
import math
import struct

#: A, B, C, D, the length in bits, the block begun, and how many bytes of it there are: libcrypto's MD5_CTX.
LAYOUT = struct.Struct("=4IQ64sI")
START = LAYOUT.pack(0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0, b"", 0)
SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]


def _library() -> ctypes.CDLL | None:
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        library.MD5_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        return library
    except (ImportError, OSError, AttributeError):
        return None


def _block(sums: tuple[int, ...], block: bytes) -> tuple[int, ...]:
    words = struct.unpack("<16I", block)
    a, b, c, d = sums
    for k in range(64):
        if k < 16:
            f, at = (b & c) | (~b & d), k
        elif k < 32:
            f, at = (d & b) | (~d & c), (5 * k + 1) % 16
        elif k < 48:
            f, at = b ^ c ^ d, (3 * k + 5) % 16
        else:
            f, at = c ^ (b | (~d & 0xFFFFFFFF)), 7 * k % 16
        f = (a + f + SINES[k] + words[at]) & 0xFFFFFFFF
        a, d, c, b = d, c, b, (b + (f << SHIFTS[k] | f >> 32 - SHIFTS[k])) & 0xFFFFFFFF
    return tuple((x + y) & 0xFFFFFFFF for x, y in zip(sums, (a, b, c, d)))


class Md5:
    """An MD5 from its beginning, or from a state."""

    def __init__(self, state: bytes = START, native: bool = True) -> None:
        self._state = ctypes.create_string_buffer(state, LAYOUT.size)
        self._library = _library() if native else None

    @property
    def state(self) -> bytes:
        return self._state.raw

    @property
    def empty(self) -> bool:
        return self.state == START

    def update(self, data: bytes) -> None:
        if self._library is not None:
            self._library.MD5_Update(self._state, data, len(data))
            return
        *sums, bits, begun, n = LAYOUT.unpack(self.state)
        left, at = begun[:n] + data, 0
        while len(left) - at >= 64:
            sums = _block(tuple(sums), left[at : at + 64])
            at += 64
        self._state.raw = LAYOUT.pack(*sums, (bits + 8 * len(data)) % 2**64, left[at:], len(left) - at)

    def hexdigest(self) -> str:
        bits, n = LAYOUT.unpack(self.state)[4::2]
        ended = Md5(self.state, self._library is not None)
        ended.update(b"\x80" + b"\0" * ((55 - n) % 64) + struct.pack("<Q", bits))
        return struct.pack("<4I", *LAYOUT.unpack(ended.state)[:4]).hex()
