"""Native file formats: write-ahead log, table file, filter block and manifest, read and written byte by byte.

These functions handle one file or one record; ``connectors`` runs them over many files in Spark.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import dropwhile

import pyarrow as pa

from tidemark.functions import bloom
from tidemark.functions.bytes import (
    crc32c,
    crc32c_all,
    decode_internal_key,
    encode_internal_key,
    internal_separator,
    internal_successor,
    mask,
    prefixed,
    read_prefixed,
    read_varint,
    unmask,
    varint,
)
from tidemark.schema import DELETE, LEVELS, NEWEST, PUT

# Fixed values of the formats.
LOG_BLOCK = 32 * 1024
LOG_HEADER = 7
FULL, FIRST, MIDDLE, LAST = 0, 1, 2, 3
RAW, SNAPPY = 0, 1
RESTART_INTERVAL = 16
FOOTER_BYTES = 48
MAGIC = 1646
FILTER_RANGE_BITS = 11
FILTER_NAME = "filter.tidemark.BloomFilter"


@dataclass(frozen=True)
class FilterPolicy:
    """How filters of one name are built from keys and bits a key, and asked for a key."""

    build: Callable[[list[bytes], int], bytes]
    may_match: Callable[[bytes, bytes], bool]


#: Policies by the name that a table file gives for its filter.
FILTERS: dict[str, FilterPolicy] = {}


def register_filter(name: str, policy: FilterPolicy) -> None:
    """Make filters of this name known, for files of any origin."""
    FILTERS[name] = policy


register_filter(FILTER_NAME, FilterPolicy(lambda keys, bits: bloom.build(keys, bits), lambda key, f: bool(bloom.may_match([key], [f])[0])))


# --- batches


def encode_batch(start: int, elements: Iterable[tuple[int, bytes, bytes | None]]) -> bytes:
    """``elements``: (op, key, value); a delete's value is not written."""
    elements = list(elements)
    out = [struct.pack("<Q", start), varint(len(elements))]
    for op, key, value in elements:
        out += [bytes([op]), prefixed(key)]
        if op == PUT:
            out.append(prefixed(value or b""))
    return b"".join(out)


def decode_batch(data: bytes) -> tuple[int, list[tuple[int, bytes, bytes | None]]]:
    if len(data) < 9:
        raise ValueError("batch cut off")
    start = struct.unpack_from("<Q", data)[0]
    n, at = read_varint(data, 8, 32)
    out = []
    for _ in range(n):
        if at >= len(data):
            raise ValueError("batch cut off")
        op = data[at]
        if op not in (DELETE, PUT):
            raise ValueError(f"unknown operation {op}")
        key, at = read_prefixed(data, at + 1)
        value = None
        if op == PUT:
            value, at = read_prefixed(data, at)
        out.append((op, key, value))
    return start, out


# --- write-ahead log


def encode_log(records: Iterable[bytes], offset: int = 0) -> bytes:
    """Records as they stand in a log from ``offset`` on: fragments that never cross a block of 32 KiB."""
    out = bytearray()
    at = offset % LOG_BLOCK
    for record in records:
        rest, begun = memoryview(record), False
        while True:
            room = LOG_BLOCK - at
            if room < LOG_HEADER:
                out += bytes(room)
                at, room = 0, LOG_BLOCK
            part = rest[: room - LOG_HEADER]
            rest = rest[len(part) :]
            kind = (LAST if begun else FULL) if not len(rest) else (MIDDLE if begun else FIRST)
            out += struct.pack("<IHB", mask(crc32c(bytes(part))), len(part), kind) + part
            at += LOG_HEADER + len(part)
            begun = True
            if not len(rest):
                break
    return bytes(out)


def decode_log(data: bytes) -> Iterator[bytes]:
    """Records of a log. A torn end is dropped; a record with a damaged or misplaced fragment is left out whole."""
    at, parts = 0, None
    while at + LOG_HEADER <= len(data):
        room = LOG_BLOCK - at % LOG_BLOCK
        if room < LOG_HEADER:
            at += room
            continue
        checksum, length, kind = struct.unpack_from("<IHB", data, at)
        if length > room - LOG_HEADER:  # damaged length: nothing more of this block can be trusted
            at += room
            parts = None
            continue
        body = data[at + LOG_HEADER : at + LOG_HEADER + length]
        if len(body) < length:
            return
        at += LOG_HEADER + length
        if crc32c(body) != unmask(checksum) or kind > LAST:
            parts = None
        elif kind == FULL:
            parts = None
            yield body
        elif kind == FIRST:
            parts = [body]
        elif parts is not None:
            parts.append(body)
            if kind == LAST:
                yield b"".join(parts)
                parts = None


# --- blocks of a table file


def encode_block(entries: Iterable[tuple[bytes, bytes]], restart: int = RESTART_INTERVAL) -> bytes:
    out, restarts, last, n = bytearray(), [0], b"", 0
    for key, value in entries:
        shared = 0
        if n == restart:
            restarts.append(len(out))
            n = 0
        else:
            limit = min(len(last), len(key))
            while shared < limit and last[shared] == key[shared]:
                shared += 1
        out += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        last = key
        n += 1
    return bytes(out) + b"".join(struct.pack("<I", r) for r in restarts) + struct.pack("<I", len(restarts))


def _restarts(data: bytes) -> tuple[int, int]:
    """(number of restarts, where the entries end)."""
    if len(data) < 4:
        raise ValueError("block cut off")
    n = struct.unpack_from("<I", data, len(data) - 4)[0]
    end = len(data) - 4 - 4 * n
    if end < 0:
        raise ValueError("block has more restarts than room")
    return n, end


def _entries_from(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
    """Entries from a restart on."""
    last = b""
    while at < end:
        shared, at = read_varint(data, at, 32)
        fresh, at = read_varint(data, at, 32)
        size, at = read_varint(data, at, 32)
        if shared > len(last) or at + fresh + size > end:
            raise ValueError("entry cut off")
        last = last[:shared] + data[at : at + fresh]
        yield last, data[at + fresh : at + fresh + size]
        at += fresh + size


def decode_block(data: bytes) -> list[tuple[bytes, bytes]]:
    return list(_entries_from(data, 0, _restarts(data)[1]))


def seek_block(data: bytes, target, order: Callable) -> list[tuple[bytes, bytes]]:
    """Entries from the first whose ``order(key)`` is not below the target, found by halving the restarts."""
    n, end = _restarts(data)
    offset = lambda i: struct.unpack_from("<I", data, end + 4 * i)[0]
    below = lambda i: order(next(_entries_from(data, offset(i), end), (b"",))[0]) < target
    lo, hi = 0, n  # restarts before lo begin below the target, those from hi on do not
    while lo < hi and end:
        middle = (lo + hi) // 2
        lo, hi = (middle + 1, hi) if below(middle) else (lo, middle)
    entries = _entries_from(data, offset(max(0, lo - 1)) if n else 0, end)
    return list(dropwhile(lambda e: order(e[0]) < target, entries))


_FRAME = 65536


def _framed(parts: list[bytes], sums: list[int]) -> bytes:
    codec, out = pa.Codec("snappy"), [b"\xff\x06\x00\x00sNaPpY"]
    for part, crc in zip(parts, sums):
        small = codec.compress(part, asbytes=True)
        kind, body = (0, small) if len(small) < len(part) else (1, part)
        out.append(bytes([kind]) + (len(body) + 4).to_bytes(3, "little") + struct.pack("<I", mask(crc)) + body)
    return b"".join(out)


def _parts(data: bytes) -> list[bytes]:
    return [data[i : i + _FRAME] for i in range(0, len(data), _FRAME)]


def snappy_frames(data: bytes) -> bytes:
    """``data`` in the framing format of snappy."""
    parts = _parts(data)
    return _framed(parts, [crc32c(p) for p in parts])


def _unframed(data: bytes) -> tuple[list[bytes], list[int]]:
    """(parts, their checksums as stored)."""
    codec, parts, sums, at = pa.Codec("snappy"), [], [], 0
    while at + 4 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind in (0, 1):
            part = bytes(body[4:])
            if kind == 0:
                part = codec.decompress(part, decompressed_size=read_varint(part, 0, 32)[0], asbytes=True)
            parts.append(part)
            sums.append(unmask(struct.unpack_from("<I", body)[0]))
        elif 2 <= kind <= 0x7F:
            raise ValueError("frame of unknown kind")
    return parts, sums


def unsnappy_frames(data: bytes) -> bytes:
    parts, sums = _unframed(data)
    if crc32c_all(parts).tolist() != sums:
        raise ValueError("checksum of a frame is wrong")
    return b"".join(parts)


def _stored(blocks: list[bytes], compress: bool = True) -> list[bytes]:
    """Blocks as they are stored: compressed where that saves an eighth, then kind and checksum.

    Checksums are computed for all blocks together.
    """
    small = blocks
    if compress:
        parts = [_parts(block) for block in blocks]
        sums = iter(crc32c_all([p for ps in parts for p in ps]).tolist())
        small = [_framed(ps, [next(sums) for _ in ps]) for ps in parts]
    tails = [s + bytes([SNAPPY]) if compress and len(s) < len(block) - len(block) // 8 else block + bytes([RAW]) for s, block in zip(small, blocks)]
    return [tail + struct.pack("<I", mask(crc)) for tail, crc in zip(tails, crc32c_all(tails).tolist())]


def _load_all(data: bytes, handles: list[tuple[int, int]]) -> list[bytes]:
    """The blocks at the handles, checksums verified for all of them together."""
    if any(len(data) < at + size + 5 for at, size in handles):
        raise ValueError("block cut off")
    tails = [data[at : at + size + 1] for at, size in handles]
    if crc32c_all(tails).tolist() != [unmask(struct.unpack_from("<I", data, at + size + 1)[0]) for at, size in handles]:
        raise ValueError("checksum of a block is wrong")
    if any(tail[-1] not in (RAW, SNAPPY) for tail in tails):
        raise ValueError("block of unknown compression")
    framed = {i: _unframed(tail[:-1]) for i, tail in enumerate(tails) if tail[-1] == SNAPPY}
    if crc32c_all([p for ps, _ in framed.values() for p in ps]).tolist() != [s for _, sums in framed.values() for s in sums]:
        raise ValueError("checksum of a frame is wrong")
    return [b"".join(framed[i][0]) if i in framed else tail[:-1] for i, tail in enumerate(tails)]


def _load(data: bytes, handle: tuple[int, int]) -> bytes:
    return _load_all(data, [handle])[0]


def _handle(at: int, size: int) -> bytes:
    return varint(at) + varint(size)


def _read_handle(data: bytes, at: int = 0) -> tuple[tuple[int, int], int]:
    a, at = read_varint(data, at)
    b, at = read_varint(data, at)
    return (a, b), at


# --- filter block


def encode_filter_block(blocks: list[tuple[int, list[bytes]]], bits_per_key: int = 10, policy: FilterPolicy | None = None) -> bytes:
    """``blocks``: (offset of a data block, its user keys). One filter for each 2 KiB of offsets, empty ones too."""
    by_range: dict[int, list[bytes]] = {}
    for at, keys in blocks:
        by_range.setdefault(at >> FILTER_RANGE_BITS, []).extend(keys)
    build = (policy or FILTERS[FILTER_NAME]).build
    filters = [build(by_range[i], bits_per_key) if i in by_range else b"" for i in range(max(by_range) + 1)] if by_range else []
    offsets, at = [], 0
    for f in filters:
        offsets.append(at)
        at += len(f)
    return b"".join(filters) + b"".join(struct.pack("<I", o) for o in [*offsets, at]) + bytes([FILTER_RANGE_BITS])


def decode_filter_block(data: bytes) -> tuple[list[bytes], int]:
    """(filters, bits of the range of offsets that each covers)."""
    if len(data) < 5:
        raise ValueError("filter block cut off")
    bits, start = data[-1], struct.unpack_from("<I", data, len(data) - 5)[0]
    n = (len(data) - 5 - start) // 4
    if n < 0:
        raise ValueError("filter block cut off")
    ends = [struct.unpack_from("<I", data, start + 4 * i)[0] for i in range(n)] + [start]
    return [data[ends[i] : ends[i + 1]] for i in range(n)], bits


def filter_may_match(filters: list[bytes], bits: int, offset: int, key: bytes, policy: FilterPolicy | None = None) -> bool:
    """Whether the filter over ``offset`` may hold the key. An empty filter holds none; a missing one may hold any."""
    i = offset >> bits
    if i >= len(filters):
        return True
    return bool(filters[i]) and (policy or FILTERS[FILTER_NAME]).may_match(key, filters[i])


# --- table file


def encode_table(entries: Iterable[tuple[bytes, int, int, bytes | None]], *, block_bytes: int = 4096, bits_per_key: int = 10, filter_name: str = FILTER_NAME) -> bytes:
    """Entries (key, seq, op, value) in internal order as a table file; out of order raises ValueError."""
    blocks: list[tuple[list[tuple[bytes, bytes]], list[bytes]]] = []  # entries as written, user keys
    ends: list[tuple] = []  # first and last entry of each block
    size, last = block_bytes, None
    for key, seq, op, value in entries:
        if last is not None and (key, -seq) <= (last[0], -last[1]):
            raise ValueError(f"{key!r} @ {seq} is out of order")
        if size >= block_bytes:
            blocks.append(([], []))
            ends.append(((key, seq, op), (key, seq, op)))
            size = 0
        last = (key, seq, op)
        entry = (encode_internal_key(*last), value or b"")
        blocks[-1][0].append(entry)
        blocks[-1][1].append(key)
        ends[-1] = (ends[-1][0], last)
        size += len(entry[0]) + len(entry[1]) + 3
    out = bytearray()

    def put(stored: bytes) -> bytes:
        out.extend(stored)
        return _handle(len(out) - len(stored), len(stored) - 5)

    index: list[tuple[bytes, bytes]] = []
    filters: list[tuple[int, list[bytes]]] = []
    for i, ((_, keys), stored) in enumerate(zip(blocks, _stored([encode_block(of) for of, _ in blocks]))):
        filters.append((len(out), keys))
        bound = internal_separator(ends[i][1], ends[i + 1][0]) if i + 1 < len(ends) else internal_successor(ends[i][1])
        index.append((encode_internal_key(*bound), put(stored)))
    filter_handle = put(_stored([encode_filter_block(filters, bits_per_key, FILTERS.get(filter_name))], compress=False)[0])
    meta = put(_stored([encode_block([(filter_name.encode(), filter_handle)])])[0])
    top = put(_stored([encode_block(index, restart=1)])[0])
    footer = meta + top
    return bytes(out) + footer + bytes(FOOTER_BYTES - 8 - len(footer)) + struct.pack("<Q", MAGIC)


@dataclass
class Table:
    """An opened table file. Its filter is used when its name is registered; one that cannot be read is done without."""

    data: bytes
    magic: int = MAGIC
    index: list = field(init=False)
    filters: tuple | None = field(init=False, default=None)
    policy: FilterPolicy | None = field(init=False, default=None)

    def __post_init__(self):
        if len(self.data) < FOOTER_BYTES:
            raise ValueError("table file cut off")
        footer = self.data[-FOOTER_BYTES:]
        if struct.unpack_from("<Q", footer, 40)[0] != self.magic:
            raise ValueError("not a table file")
        meta, at = _read_handle(footer)
        top, _ = _read_handle(footer, at)
        self.index = [(decode_internal_key(k), _read_handle(v)[0]) for k, v in decode_block(_load(self.data, top))]
        try:
            for name, handle in decode_block(_load(self.data, meta)):
                if policy := FILTERS.get(name.decode(errors="replace")):
                    self.filters, self.policy = decode_filter_block(_load(self.data, _read_handle(handle)[0])), policy
        except ValueError:
            self.filters = self.policy = None

    def _block(self, i: int) -> bytes:
        return _load(self.data, self.index[i][1])

    def _first_block(self, key: bytes, seq: int) -> int:
        """The first block whose last entry is not before the one asked for."""
        return bisect_left(self.index, (key, -seq), key=lambda e: (e[0][0], -e[0][1]))

    def entries(self) -> Iterator[tuple[bytes, int, int, bytes | None]]:
        """All entries; the whole file is verified first."""
        for block in _load_all(self.data, [handle for _, handle in self.index]):
            yield from map(_entry, decode_block(block))

    def scan(self, key: bytes | None = None, reverse: bool = False) -> Iterator[tuple[bytes, int, int, bytes | None]]:
        """Entries (key, seq, op, value) from the key on, or backwards from before it; all of them without a key.

        Block after block is read as the scan gets there.
        """
        start = 0 if key is None else self._first_block(key, NEWEST)
        if not reverse:
            for i in range(start, len(self.index)):
                block = self._block(i)
                part = decode_block(block) if i > start or key is None else seek_block(block, key, lambda k: decode_internal_key(k)[0])
                yield from map(_entry, part)
        else:
            for i in range(min(start, len(self.index) - 1) if key is not None else len(self.index) - 1, -1, -1):
                for e in map(_entry, reversed(decode_block(self._block(i)))):
                    if key is None or e[0] < key:
                        yield e

    def get(self, key: bytes, snapshot: int) -> tuple[int, int, bytes | None] | None:
        """(seq, op, value) of the newest entry of the key up to the snapshot; None when the file has none."""
        i = self._first_block(key, snapshot)
        if i == len(self.index) or self.filters and not filter_may_match(*self.filters, self.index[i][1][0], key, self.policy):
            return None

        def place(internal: bytes) -> tuple[bytes, int]:
            k, seq, _ = decode_internal_key(internal)
            return k, -seq

        found = seek_block(self._block(i), (key, -snapshot), place)
        if found and (e := _entry(found[0]))[0] == key:
            return e[1:]
        return None


def _entry(raw: tuple[bytes, bytes]) -> tuple[bytes, int, int, bytes | None]:
    key, seq, op = decode_internal_key(raw[0])
    return key, seq, op, raw[1] if op == PUT else None


# --- manifest edits

_WAL, _FILE, _SEQUENCE, _POINTER, _DELETED, _NEW, _PREV_WAL = 2, 3, 4, 5, 6, 7, 9


@dataclass
class Edit:
    """One change of the file set: scalars that are set, pointers, deleted and new files."""

    wal_number: int | None = None
    prev_wal_number: int | None = None
    curr_file_number: int | None = None
    prev_sequence_number: int | None = None
    pointers: list[tuple[int, tuple[bytes, int, int]]] = field(default_factory=list)
    deleted: list[tuple[int, int]] = field(default_factory=list)
    added: list[tuple[int, int, int, tuple[bytes, int, int], tuple[bytes, int, int]]] = field(default_factory=list)


def encode_edit(e: Edit) -> bytes:
    out = []
    for tag, value in ((_WAL, e.wal_number), (_PREV_WAL, e.prev_wal_number), (_FILE, e.curr_file_number), (_SEQUENCE, e.prev_sequence_number)):
        if value is not None:
            out += [varint(tag), varint(value)]
    for level, key in e.pointers:
        out += [varint(_POINTER), varint(level), prefixed(encode_internal_key(*key))]
    for level, number in e.deleted:
        out += [varint(_DELETED), varint(level), varint(number)]
    for level, number, size, lo, hi in e.added:
        out += [varint(_NEW), varint(level), varint(number), varint(size), prefixed(encode_internal_key(*lo)), prefixed(encode_internal_key(*hi))]
    return b"".join(out)


def decode_edit(data: bytes) -> Edit:
    e, at = Edit(), 0

    def level(at: int) -> tuple[int, int]:
        n, at = read_varint(data, at, 32)
        if n >= LEVELS:
            raise ValueError(f"no level {n}")
        return n, at

    scalars = {_WAL: "wal_number", _PREV_WAL: "prev_wal_number", _FILE: "curr_file_number", _SEQUENCE: "prev_sequence_number"}
    while at < len(data):
        tag, at = read_varint(data, at, 32)
        if tag in scalars:
            value, at = read_varint(data, at)
            setattr(e, scalars[tag], value)
        elif tag == _POINTER:
            lv, at = level(at)
            key, at = read_prefixed(data, at)
            e.pointers.append((lv, decode_internal_key(key)))
        elif tag == _DELETED:
            lv, at = level(at)
            number, at = read_varint(data, at)
            e.deleted.append((lv, number))
        elif tag == _NEW:
            lv, at = level(at)
            number, at = read_varint(data, at)
            size, at = read_varint(data, at)
            lo, at = read_prefixed(data, at)
            hi, at = read_prefixed(data, at)
            e.added.append((lv, number, size, decode_internal_key(lo), decode_internal_key(hi)))
        else:
            raise ValueError(f"unknown tag {tag}")
    return e
