"""The binary layout of block files and block lists, as the public format description has it.

Whole numbers are packed into big-endian 64-bit words: a 4-bit selector tells how many values of how many bits follow, or
that one value is repeated. Floats are kept as the XOR with the value before; booleans as bits; single numbers as
base-128 varints. Words are decoded all at once by selector, not value by value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SECOND = 1_000_000_000
FLOAT, BOOL = 2, 5

# Bits of a value by selector, 1 to 14; selector 15 repeats a 32-bit value up to 2**28 - 1 times.
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
COUNTS = np.array([0, *(60 // BITS[1:15]), 0])
REPEAT, REPEAT_BITS, MOST_REPEATS, DATA_BITS = 15, 32, (1 << 28) - 1, 60


class FormatError(ValueError):
    """Bytes that aren't a block or block list."""


# -- varints


def varint(value: int) -> bytes:
    """Seven bits a byte, lowest first; zero has no bytes at all in this format's writer, but one is as readable."""
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise FormatError(f"no varint ends before byte {at}")
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


# -- packed whole numbers


def pack(values: np.ndarray) -> bytes:
    """Words of as many values as fit, or repeats where those hold more."""
    v = np.asarray(values, np.uint64)
    if not len(v):
        return b""
    if int(v.max()) >> DATA_BITS:
        raise FormatError("a value has more than 60 bits")
    sizes = np.array([max(1, int(x).bit_length()) for x in v.tolist()])
    ends = np.r_[np.flatnonzero(v[1:] != v[:-1]) + 1, len(v)]
    run_end = np.repeat(ends, np.diff(np.r_[0, ends]))
    out, i, n = [], 0, len(v)
    while i < n:
        selector = next(s for s in range(1, 15) if sizes[i : i + COUNTS[s]].max() <= BITS[s])
        held = min(int(COUNTS[selector]), n - i)
        same = min(int(run_end[i]) - i, MOST_REPEATS)
        if same > held and sizes[i] <= REPEAT_BITS:
            out.append(REPEAT << DATA_BITS | same << REPEAT_BITS | int(v[i]))
            i += same
            continue
        word, bits = selector, int(BITS[selector])
        for x in v[i : i + held].tolist():
            word = word << bits | x
        unused = DATA_BITS - held * bits
        out.append(word << unused)
        i += held
    return np.array(out, np.uint64).astype(">u8").tobytes()


def unpack(data: bytes, at: int, count: int) -> tuple[np.ndarray, int]:
    """``count`` values and the place behind their words."""
    if count == 0:
        return np.zeros(0, np.uint64), at
    words = np.frombuffer(data, ">u8", (len(data) - at) // 8, at).astype(np.uint64)
    selector = (words >> np.uint64(DATA_BITS)).astype(np.int64)
    payload = words & np.uint64((1 << DATA_BITS) - 1)
    held = np.where(selector == REPEAT, (payload >> np.uint64(REPEAT_BITS)).astype(np.int64), COUNTS[selector])
    total = np.cumsum(held)
    used = int(np.searchsorted(total, count)) + 1
    if used > len(words) or (held[:used] == 0).any():
        raise FormatError(f"{count} values aren't in the words from byte {at}")
    out = np.empty(int(total[used - 1]), np.uint64)
    start = total[:used] - held[:used]
    for s in np.unique(selector[:used]):
        mine = np.flatnonzero(selector[:used] == s)
        if s == REPEAT:
            for w in mine:
                out[start[w] : total[w]] = payload[w] & np.uint64((1 << REPEAT_BITS) - 1)
            continue
        bits, n = int(BITS[s]), int(COUNTS[s])
        shifts = np.uint64(DATA_BITS) - np.arange(1, n + 1, dtype=np.uint64) * np.uint64(bits)
        parts = (payload[mine][:, None] >> shifts[None, :]) & np.uint64((1 << bits) - 1)
        out[start[mine][:, None] + np.arange(n)] = parts
    return out[:count], at + used * 8


# -- floats and booleans


def pack_floats(values: np.ndarray) -> bytes:
    """The first value whole, then for each: 0 if it is the same; else 1, and 0 with the bits in the last window, or 1 with
    a window of its own (6 bits of leading zeros, 6 of length less one).
    """
    raw = np.asarray(values, np.float64).view(np.uint64).tolist()
    bits = [f"{raw[0]:064b}"]
    window = None
    for before, now in zip(raw, raw[1:], strict=False):
        x = before ^ now
        if not x:
            bits.append("0")
            window = None
            continue
        lead, trail = 64 - x.bit_length(), (x & -x).bit_length() - 1
        if window and lead >= window[0] and trail >= window[1]:
            lead, trail = window
            bits.append("10")
        else:
            window = (lead, trail)
            bits.append(f"11{lead:06b}{63 - lead - trail:06b}")
        bits.append(f"{x >> trail:0{64 - lead - trail}b}")
    text = "".join(bits)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def unpack_floats(data: bytes, at: int, count: int) -> tuple[np.ndarray, int]:
    place = at * 8

    def take(n: int) -> int:
        nonlocal place
        byte = place >> 3
        chunk = data[byte : byte + 9]
        if place + n > len(data) * 8:
            raise FormatError("floats end too soon")
        value = int.from_bytes(chunk.ljust(9, b"\0"), "big") >> (72 - (place & 7) - n) & ((1 << n) - 1)
        place += n
        return value

    out = [take(64)]
    lead = length = 0
    while len(out) < count:
        x = 0
        if take(1):
            if take(1):
                lead, length = take(6), take(6) + 1
            x = take(length) << (64 - lead - length)
        out.append(out[-1] ^ x)
    return np.array(out, np.uint64).view(np.float64), -(-place // 8)


def unpack_bools(data: bytes, at: int, count: int) -> tuple[np.ndarray, int]:
    size = -(-count // 8)
    if at + size > len(data):
        raise FormatError("booleans end too soon")
    return np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count).astype(bool), at + size


# -- blocks


def encode_block(ts: np.ndarray, fields: list[np.ndarray]) -> bytes:
    """One block of sorted times and float or boolean fields."""
    ts = np.asarray(ts, np.int64)
    if not len(ts) or (np.diff(ts) < 0).any():
        raise FormatError("a block needs times in order")
    out = [varint(len(ts)), bytes([len(fields), *(BOOL if f.dtype == bool else FLOAT for f in fields)]), int(ts[0]).to_bytes(8, "big")]
    if len(ts) > 1:
        below = (ts[1:] % SECOND).astype(np.uint64)
        shared = int(np.bitwise_or.reduce(below))
        zeros = (shared & -shared).bit_length() - 1 if shared else 0
        out += [pack(np.diff(ts // SECOND)), bytes([zeros]), pack(below >> np.uint64(zeros))]
    for f in fields:
        out.append(np.packbits(f).tobytes() if f.dtype == bool else pack_floats(f))
    return b"".join(out)


def block_types(data: bytes) -> list[int]:
    """The types of a block's fields."""
    _, at = read_varint(data, 0)
    if at >= len(data) or at + 1 + data[at] > len(data):
        raise FormatError("a block's head is cut off")
    return list(data[at + 1 : at + 1 + data[at]])


def decode_block(data: bytes, wanted: set[int] | None = None) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Times and fields; a field not ``wanted`` is None, and is only decoded if a later one is."""
    count, at = read_varint(data, 0)
    types = block_types(data)
    at += 1 + len(types)
    if at + 8 > len(data) or not count:
        raise FormatError("a block's head is cut off")
    head, at = int.from_bytes(data[at : at + 8], "big"), at + 8
    ts = np.array([head], np.int64)
    if count > 1:
        steps, at = unpack(data, at, count - 1)
        zeros, at = data[at], at + 1
        below, at = unpack(data, at, count - 1)
        # only zeros below the second have no common number of trailing zeros; any shift of them is zero
        below = below << np.uint64(zeros if zeros < 64 else 0)
        seconds = head // SECOND + np.cumsum(steps.astype(np.int64))
        ts = np.r_[ts, seconds * SECOND + below.astype(np.int64)]
    last = max(wanted, default=-1) if wanted is not None else len(types) - 1
    fields: list[np.ndarray | None] = [None] * len(types)
    for i, kind in enumerate(types[: last + 1]):
        if kind not in (FLOAT, BOOL):
            raise FormatError(f"fields of type {kind} aren't stored")
        values, at = (unpack_floats if kind == FLOAT else unpack_bools)(data, at, count)
        fields[i] = values if wanted is None or i in wanted else None
    return ts, fields


# -- block lists


@dataclass
class BlockList:
    updated_nanos: int
    since: np.ndarray
    until: np.ndarray
    timestamps: np.ndarray


def encode_list(listed: BlockList) -> bytes:
    """Blocks by ascending end; starts may step back, which differences of this format can't say: they are refused."""
    out = [listed.updated_nanos.to_bytes(8, "big"), varint(len(listed.since))]
    for column in (listed.since, listed.until):
        steps = np.diff(np.asarray(column, np.int64))
        if (steps < 0).any():
            raise FormatError("block times must ascend")
        out += [varint(int(column[0])), pack(steps)]
    return b"".join([*out, pack(listed.timestamps)])


def decode_list(data: bytes) -> BlockList:
    updated, (n, at) = int.from_bytes(data[:8], "big"), read_varint(data, 8)
    columns = []
    for _ in range(2):
        head, at = read_varint(data, at)
        steps, at = unpack(data, at, n - 1)
        columns.append(head + np.r_[0, np.cumsum(steps.astype(np.int64))])
    timestamps, _ = unpack(data, at, n)
    return BlockList(updated, *columns, timestamps.astype(np.int64))
