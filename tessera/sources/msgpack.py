"""A small MessagePack codec: nil, booleans, integers, text, bytes, lists and maps, each in its shortest form."""

from __future__ import annotations

import struct

#: Nesting beyond this is refused, so that hostile input can't exhaust the stack.
DEPTH = 64


def _sized(n: int, fix: tuple[int, int] | None, wider: list[tuple[int, str]]) -> bytes:
    if fix and n < fix[1]:
        return bytes([fix[0] | n])
    for code, form in wider:
        if n < 1 << 8 * struct.calcsize(form):
            return struct.pack(">B" + form, code, n)
    raise ValueError("too long for MessagePack")


def dumps(v) -> bytes:
    if v is None:
        return b"\xc0"
    if isinstance(v, bool):
        return b"\xc3" if v else b"\xc2"
    if isinstance(v, int):
        if v >= 0:
            return _sized(v, (0, 128), [(0xCC, "B"), (0xCD, "H"), (0xCE, "I"), (0xCF, "Q")])
        if v >= -32:
            return struct.pack(">b", v)
        for code, form in ((0xD0, "b"), (0xD1, "h"), (0xD2, "i"), (0xD3, "q")):
            if v >= -(1 << 8 * struct.calcsize(form) - 1):
                return struct.pack(">B" + form, code, v)
        raise ValueError("integer out of range")
    if isinstance(v, str):
        raw = v.encode()
        return _sized(len(raw), (0xA0, 32), [(0xD9, "B"), (0xDA, "H"), (0xDB, "I")]) + raw
    if isinstance(v, (bytes, bytearray)):
        return _sized(len(v), None, [(0xC4, "B"), (0xC5, "H"), (0xC6, "I")]) + bytes(v)
    if isinstance(v, (list, tuple)):
        return _sized(len(v), (0x90, 16), [(0xDC, "H"), (0xDD, "I")]) + b"".join(map(dumps, v))
    if isinstance(v, dict):
        return _sized(len(v), (0x80, 16), [(0xDE, "H"), (0xDF, "I")]) + b"".join(dumps(k) + dumps(x) for k, x in v.items())
    raise TypeError(f"no MessagePack form of {type(v).__name__}")


_NUMBERS = {0xCA: "f", 0xCB: "d", 0xCC: "B", 0xCD: "H", 0xCE: "I", 0xCF: "Q", 0xD0: "b", 0xD1: "h", 0xD2: "i", 0xD3: "q"}
_LENGTHS = {0xC4: ("bin", "B"), 0xC5: ("bin", "H"), 0xC6: ("bin", "I"), 0xD9: ("str", "B"), 0xDA: ("str", "H"), 0xDB: ("str", "I"), 0xDC: ("list", "H"), 0xDD: ("list", "I"), 0xDE: ("map", "H"), 0xDF: ("map", "I")}


def loads(data: bytes):
    """The one value that data holds; ValueError if it is cut, of another type or followed by more."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("MessagePack is cut")
        at += n
        return data[at - n : at]

    def number(form: str):
        return struct.unpack(">" + form, take(struct.calcsize(form)))[0]

    def value(depth: int):
        if depth > DEPTH:
            raise ValueError("MessagePack is nested too deeply")
        b = take(1)[0]
        if b < 0x80:
            return b
        if b >= 0xE0:
            return b - 256
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b]
        if b in _NUMBERS:
            return number(_NUMBERS[b])
        if b < 0xC0:
            kind, n = ("map", b & 15) if b < 0x90 else ("list", b & 15) if b < 0xA0 else ("str", b & 31)
        elif b in _LENGTHS:
            kind, form = _LENGTHS[b]
            n = number(form)
        else:
            raise ValueError(f"MessagePack type {b:#x} is not supported")
        if kind == "bin":
            return take(n)
        if kind == "str":
            return take(n).decode()
        if kind == "list":
            return [value(depth + 1) for _ in range(n)]
        pairs = [(value(depth + 1), value(depth + 1)) for _ in range(n)]
        if any(not isinstance(k, (str, int)) for k, _ in pairs):
            raise ValueError("MessagePack map key is not text or a number")
        return dict(pairs)

    out = value(0)
    if at != len(data):
        raise ValueError("bytes after the MessagePack value")
    return out
