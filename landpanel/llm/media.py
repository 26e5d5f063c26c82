"""Operator 9: media columns in ISO media containers.

`describe` walks the nested boxes of a container column, decodes the sample tables (sizes, chunk offsets, samples per
chunk, durations, sync samples) and stores codec, duration and the byte ranges of the key frames without decoding any
payload. Containers in fragments are read too: the runs of samples behind the first index are added to its tables, with
the defaults of the track and of the fragment. `pack` writes a container around a payload, with 8-bit samples in frames of 192; `unpack` gives the payload
back from the byte ranges that the sample tables name.

Defined results: a null or empty container, or one without a media track, has null codec and no samples; of several
tracks the first that can be read is described, and `tracks` gives all; a duration of 0 in the header is replaced by the
sum of the samples' durations; a box that is cut short or claims more bytes than there are ends the walk at that level; repeated and equal rows give equal results;
an empty table gives an empty result; other columns are not read. A container is one cell, so its size is bounded by a
cell's; tables are decoded with NumPy in one pass.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import by_blocks, text_or_empty

FRAME, RATE, PER_CHUNK, KEY_EVERY = 192, 48_000, 64, 16
#: Boxes that hold boxes (fixed values of ISO/IEC 14496-12).
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pack_payload(payload: bytes) -> bytes:
    """A container with one sound track of raw 8-bit samples; nothing in it depends on the time of writing."""
    frames = len(payload) // FRAME
    if frames * FRAME != len(payload) or not frames:
        raise ValueError("a payload is a positive multiple of the frame")
    chunks, last = -(-frames // PER_CHUNK), frames % PER_CHUNK or PER_CHUNK
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    stsc = [(1, PER_CHUNK, 1)] if last == PER_CHUNK or chunks == 1 else [(1, PER_CHUNK, 1), (chunks, last, 1)]
    stsc = [(1, last, 1)] if chunks == 1 else stsc
    keys = range(1, frames + 1, KEY_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))

    def moov(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        at = [first + k * PER_CHUNK * FRAME for k in range(chunks)]
        table = full(b"co64", struct.pack(f">I{chunks}Q", chunks, *at)) if wide else full(b"stco", struct.pack(f">I{chunks}I", chunks, *at))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            table,
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, len(payload), 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, len(payload), 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")
    large = len(payload) + 8 >= 1 << 32
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(head) + len(moov(0)) + len(mdat)
    if first + len(payload) >= 1 << 32:
        first = len(head) + len(moov(first)) + len(mdat)
    return head + moov(first) + mdat + payload


def boxes(data: memoryview, start: int, end: int):
    """(kind, body start, end) of the boxes of one level."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield kind, body, start + size
        start += size


def walk(data: memoryview, start: int, end: int, found: dict, tracks: list, depth: int = 0) -> None:
    for kind, a, b in boxes(data, start, end):
        into = found
        if kind == b"trak":
            tracks.append(into := {})
        if kind in NESTED and depth < 16:
            walk(data, a, b, into, tracks, depth + 1)
        else:
            into.setdefault(kind, (a, b))


def numbers(data: memoryview, span: tuple[int, int] | None, kind: str, skip: int, columns: int) -> np.ndarray:
    """The rows of a table after its count; a count beyond the box is cut to what is there."""
    if span is None or span[0] + skip > span[1]:
        return np.empty((0, columns), np.int64)
    count = struct.unpack_from(">I", data, span[0] + skip - 4)[0]
    width = np.dtype(kind).itemsize * columns
    count = min(count, (span[1] - span[0] - skip) // width)
    return np.frombuffer(data, kind, count * columns, span[0] + skip).reshape(-1, columns).astype(np.int64)


def read_track(data: memoryview, t: dict) -> dict | None:
    if b"stsd" not in t or b"mdhd" not in t or t[b"stsd"][1] - t[b"stsd"][0] < 16 or t[b"mdhd"][1] - t[b"mdhd"][0] < 24:
        return None
    codec = bytes(data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16]).decode("latin-1")
    a = t[b"mdhd"][0]
    scale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 and t[b"mdhd"][1] - a >= 32 else struct.unpack_from(">II", data, a + 12)
    stts = numbers(data, t.get(b"stts"), ">u4", 8, 2)
    fixed, n = struct.unpack_from(">II", data, t[b"stsz"][0] + 4) if b"stsz" in t and t[b"stsz"][1] - t[b"stsz"][0] >= 12 else (0, 0)
    n = min(n, len(data))
    sizes = np.full(n, fixed, np.int64) if fixed else compact(data, t[b"stz2"]) if b"stz2" in t else numbers(data, t.get(b"stsz"), ">u4", 12, 1)[:, 0]
    offsets = numbers(data, t[b"co64"], ">u8", 8, 1)[:, 0] if b"co64" in t else numbers(data, t.get(b"stco"), ">u4", 8, 1)[:, 0]
    stsc = numbers(data, t.get(b"stsc"), ">u4", 8, 3)
    per = np.zeros(len(offsets), np.int64)
    for k in range(len(stsc)):
        per[max(0, stsc[k, 0] - 1) :] = stsc[k, 1]
    chunk = np.repeat(np.arange(len(offsets)), np.minimum(per, len(sizes)))[: len(sizes)]
    sizes = sizes[: len(chunk)]
    before = np.concatenate([[0], np.cumsum(sizes)])
    first = np.searchsorted(chunk, np.arange(len(offsets)))
    starts = offsets[chunk] + before[:-1] - before[first[chunk]]
    keys = numbers(data, t[b"stss"], ">u4", 8, 1)[:, 0] - 1 if b"stss" in t else np.arange(len(sizes))
    keys = keys[(keys >= 0) & (keys < len(sizes))]
    number = None
    if b"tkhd" in t:
        a, b = t[b"tkhd"]
        at = a + (20 if b > a and data[a] == 1 else 12)
        number = struct.unpack_from(">I", data, at)[0] if at + 4 <= b else None
    return {"track": number, "codec": codec, "scale": int(scale), "duration": int(duration), "timed": int((stts[:, 0] * stts[:, 1]).sum()), "starts": starts, "sizes": sizes, "keys": keys}


def compact(data: memoryview, span: tuple[int, int]) -> np.ndarray:
    """The sizes of a compact table, of 4, 8 or 16 bits each."""
    a, b = span
    if b - a < 12:
        return np.empty(0, np.int64)
    bits, count = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
    if bits == 16:
        return np.frombuffer(data, ">u2", min(count, (b - a - 12) // 2), a + 12).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, b - a - 12, a + 12)
    if bits == 4:
        raw = np.stack([raw >> 4, raw & 15], axis=1).ravel()
    return raw[:count].astype(np.int64) if bits in (4, 8) else np.empty(0, np.int64)


def optional(data: memoryview, at: int, end: int, flags: int, fields: dict[int, str]) -> tuple[dict[int, int], int]:
    """The fields of a box that its flags say are there, in order, and where they end."""
    out = {}
    for bit, kind in fields.items():
        if flags & bit:
            n = struct.calcsize(kind)
            if at + n > end:
                break
            out[bit] = struct.unpack_from(kind, data, at)[0]
            at += n
    return out, at


def runs(data: memoryview, defaults: dict[int, dict[int, int]]):
    """(track, starts, sizes, durations, sync) of each run of samples in the fragments of a container."""
    for kind, a, b in boxes(data, 0, len(data)):
        if kind != b"moof":
            continue
        moof = at = a - 8
        for part, c, d in boxes(data, a, b):
            inner = list(boxes(data, c, d)) if part == b"traf" else []
            head = next(((x, y) for k, x, y in inner if k == b"tfhd" and y - x >= 8), None)
            if head is None:
                continue
            flags, track = struct.unpack_from(">II", data, head[0])
            own, _ = optional(data, head[0] + 8, head[1], flags, {0x1: ">Q", 0x2: ">I", 0x8: ">I", 0x10: ">I", 0x20: ">I"})
            given = {**defaults.get(track, {}), **{k: own[k] for k in (0x8, 0x10, 0x20) if k in own}}
            base = own.get(0x1, moof if flags & 0x20000 else at)
            at = base
            for k, x, y in inner:
                if k != b"trun" or y - x < 8:
                    continue
                flags, count = struct.unpack_from(">II", data, x)
                flags &= 0xFFFFFF
                top, x = optional(data, x + 8, y, flags, {0x1: ">i", 0x4: ">I"})
                columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
                count = min(count, (y - x) // (4 * len(columns)) if columns else len(data))
                rows = np.frombuffer(data, ">u4", count * len(columns), x).reshape(count, len(columns)).astype(np.int64)
                take = lambda bit, default: rows[:, columns.index(bit)] if bit in columns else np.full(count, given.get(default, 0), np.int64)  # noqa: B023, E731
                sizes, durations, marks = take(0x200, 0x10), take(0x100, 0x8), take(0x400, 0x20).copy()
                if 0x4 in top and count:
                    marks[0] = top[0x4]
                at = base + top[0x1] if 0x1 in top else at
                ends = at + np.cumsum(sizes)
                yield track, ends - sizes, sizes, durations, marks & 0x10000 == 0
                at = int(ends[-1]) if count else at


def tracks(content: bytes | None) -> list[dict]:
    """All tracks that can be read, with the samples of all fragments."""
    data, found, top = memoryview(content or b""), [], {}
    walk(data, 0, len(data), top, found)
    out = [r for t in found if (r := read_track(data, t))]
    defaults = {}
    for kind, a, b in boxes(data, 0, len(data)):
        for inner, c, d in boxes(data, a, b) if kind == b"moov" else ():
            for k, x, y in boxes(data, c, d) if inner == b"mvex" else ():
                if k == b"trex" and y - x >= 24:
                    track, _, duration, size, marks = struct.unpack_from(">5I", data, x + 4)
                    defaults[track] = {0x8: duration, 0x10: size, 0x20: marks}
    by = {t["track"]: t for t in out}
    for track, starts, sizes, durations, sync in runs(data, defaults):
        if track in by:
            t = by[track]
            t["keys"] = np.concatenate([t["keys"], len(t["sizes"]) + np.flatnonzero(sync)])
            t["starts"], t["sizes"] = np.concatenate([t["starts"], starts]), np.concatenate([t["sizes"], sizes])
            t["timed"] += int(durations.sum())
    for t in out:
        t["duration"] = t["duration"] or t["timed"]
    return out


def read(content: bytes | None) -> dict | None:
    """The first track that can be read."""
    return next(iter(tracks(content)), None)


def unpack_payload(content: bytes) -> bytes:
    """All samples in order; samples that touch are taken as one range."""
    t = read(content)
    if t is None or not len(t["sizes"]):
        return b""
    ends = t["starts"] + t["sizes"]
    new = np.concatenate([[True], t["starts"][1:] != ends[:-1]])
    a, b = t["starts"][new], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ends) - 1]])]
    return b"".join(content[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's bytes, filled up with spaces to a positive multiple of a frame, in a container."""
    kind = df.schema[id_col].dataType.simpleString()

    def block(rows):
        out = []
        for key, text in rows:
            raw = text.encode("utf-8", "surrogatepass")
            out.append((key, len(raw), pack_payload(raw + b" " * (-len(raw) % FRAME if raw else FRAME))))
        return out

    return by_blocks(df.select(id_col, text_or_empty(text_col).alias(text_col)), [id_col, text_col], f"{id_col} {kind}, n_bytes bigint, media binary", block)


def describe(df: DataFrame, keep: list[str], media_col: str = "media", payload: bool = False) -> DataFrame:
    """The columns `keep` and codec, time scale, duration, samples and key frame ranges; with payload=True its digests."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, codec string, timescale bigint, duration bigint, n_samples bigint, keyframes array<struct<start: bigint, length: bigint>>, media_bytes bigint, media_sha256 string"
    schema += ", payload_bytes bigint, payload_sha256 string, tail_crc32 bigint" * payload

    def block(rows):
        out = []
        for *key, media in rows:
            t = read(media)
            starts, sizes = (t["starts"][t["keys"]].tolist(), t["sizes"][t["keys"]].tolist()) if t else ([], [])
            row = (*key, t and t["codec"], t and t["scale"], t and t["duration"], len(t["sizes"]) if t else 0, [{"start": a, "length": n} for a, n in zip(starts, sizes, strict=True)], len(media or b""), hashlib.sha256(media or b"").hexdigest())
            if payload:
                p = unpack_payload(media or b"")
                row += (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
            out.append(row)
        return out

    return by_blocks(df, [*keep, media_col], schema, block)
