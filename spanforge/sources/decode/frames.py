"""HTTP/2, HTTP/3, WebSocket and gRPC frames, and the fixed header of a captured chunk."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from spanforge.sources.decode.fields import Hpack, Malformed, qpack_decode
from spanforge.sources.decode.http1 import PREVIEW, merge

PREFACE = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
MOST_FRAME, MOST_BLOCK, MOST_STREAMS = 1 << 20, 128 << 10, 200
#: Length in two parts, kind, flags and stream of a frame.
HEAD = struct.Struct(">HBBBI")
DATA, HEADERS, PRIORITY, RST, SETTINGS, PUSH, PING, GOAWAY, WINDOW, CONTINUATION = range(10)


@dataclass
class H2Message:
    stream: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""
    body_total: int = 0


class H2Direction:
    """One direction of an HTTP/2 connection: frames in, complete messages (END_STREAM) and resets out."""

    def __init__(self, preface: bool = True) -> None:
        self.buf, self.hpack, self.broken = bytearray(), Hpack(), False
        self.preface, self.block, self.open = preface, None, {}

    def feed(self, data: bytes) -> list[tuple[str, object]]:
        """('message', H2Message), ('reset', stream) and ('goaway', last stream); nothing more after a violation."""
        out: list[tuple[str, object]] = []
        if self.broken:
            return out
        self.buf += data
        try:
            del self.buf[: self._walk(out)]
        except Malformed:
            self.broken = True
            self.buf.clear()
        return out

    def _walk(self, out: list) -> int:
        """The bytes that whole frames take."""
        buf, at = self.buf, 0
        if self.preface:
            if len(buf) < len(PREFACE) and PREFACE.startswith(bytes(buf)):
                return 0
            if not buf.startswith(PREFACE):
                raise Malformed("preface")
            at, self.preface = len(PREFACE), False
        while len(buf) >= at + 9:
            high, low, kind, flags, stream = HEAD.unpack_from(buf, at)
            n = high << 8 | low
            if n > MOST_FRAME:
                raise Malformed("frame size")
            if len(buf) < at + 9 + n:
                break
            stream &= 0x7FFFFFFF
            if self.block is not None and (kind != CONTINUATION or stream != self.block[0]):
                raise Malformed("block interrupted")
            self._frame(kind, flags, stream, bytes(buf[at + 9 : at + 9 + n]), out)
            at += 9 + n
        return at

    @staticmethod
    def _unpadded(body: bytes, flags: int) -> bytes:
        if not flags & 8:
            return body
        if not body or body[0] >= len(body):
            raise Malformed("padding")
        return body[1 : len(body) - body[0]]

    def _frame(self, kind: int, flags: int, stream: int, body: bytes, out: list) -> None:
        if kind == HEADERS:
            body = self._unpadded(body, flags)
            self._fields(stream, flags, body[5:] if flags & 32 else body, out, bool(flags & 1))
        elif kind == CONTINUATION:
            if self.block is None:
                raise Malformed("continuation")
            self._fields(stream, flags, self.block[1] + body, out, self.block[2])
        elif kind == DATA:
            m = self.open.get(stream)
            if m:
                part = self._unpadded(body, flags)
                m.body_total += len(part)
                m.body += part[: max(0, PREVIEW - len(m.body))]
                self._end(stream, bool(flags & 1), out)
        elif kind == RST:
            self.open.pop(stream, None)
            out.append(("reset", stream))
        elif kind == GOAWAY and len(body) >= 8:
            last = int.from_bytes(body[:4], "big") & 0x7FFFFFFF
            self.open = {k: m for k, m in self.open.items() if k <= last}
            out.append(("goaway", last))
        elif kind == PUSH:
            body = self._unpadded(body, flags)
            if flags & 4:
                self.hpack.decode(body[4:])  # keeps the table right; the promise itself is not shown
        elif kind == SETTINGS and not flags & 1 and len(body) % 6:
            raise Malformed("settings")

    def _fields(self, stream: int, flags: int, block: bytes, out: list, ends: bool) -> None:
        if len(block) > MOST_BLOCK:
            raise Malformed("block size")
        if not flags & 4:
            self.block = (stream, block, ends)
            return
        self.block = None
        m = self.open.get(stream)
        if m is None:
            m = self.open[stream] = H2Message(stream)
        if len(self.open) > MOST_STREAMS:
            self.open.pop(next(iter(self.open)))
        for name, value in self.hpack.decode(block):
            if (name := name.lower()) in m.headers:
                merge(m.headers, name, value, cookies=True)
            else:
                m.headers[name] = value
        if m.headers.get(":status", "").startswith("1") and m.headers[":status"] != "101" and not ends:
            self.open[stream] = H2Message(stream)  # an interim answer is not the answer
        self._end(stream, ends, out)

    def _end(self, stream: int, ends: bool, out: list) -> None:
        if ends and stream in self.open:
            out.append(("message", self.open.pop(stream)))


def h2_frame(kind: int, flags: int, stream: int, body: bytes) -> bytes:
    return len(body).to_bytes(3, "big") + bytes([kind, flags]) + stream.to_bytes(4, "big") + body


def early_server_frames(data: bytes) -> bool:
    """A run of whole SETTINGS, PING and WINDOW_UPDATE frames of the connection, as servers send before the preface is seen."""
    at = 0
    while at < len(data):
        if len(data) < at + 9:
            return False
        n, kind, stream = int.from_bytes(data[at : at + 3], "big"), data[at + 3], int.from_bytes(data[at + 5 : at + 9], "big") & 0x7FFFFFFF
        if kind not in (SETTINGS, PING, WINDOW) or stream or len(data) < at + 9 + n:
            return False
        at += 9 + n
    return at > 0


# ---------------------------------------------------------------- HTTP/3


def quic_varint(buf: bytes, at: int) -> tuple[int, int] | None:
    if at >= len(buf):
        return None
    n = 1 << (buf[at] >> 6)
    if at + n > len(buf):
        return None
    return int.from_bytes(buf[at : at + n], "big") & ((1 << (8 * n - 2)) - 1), at + n


def h3_frames(buf: bytes) -> list[tuple[int, bytes]]:
    """(type, payload) of whole frames."""
    out, at = [], 0
    while (kind := quic_varint(buf, at)) and (size := quic_varint(buf, kind[1])) and size[1] + size[0] <= len(buf):
        out.append((kind[0], buf[size[1] : size[1] + size[0]]))
        at = size[1] + size[0]
    return out


def h3_headers(buf: bytes) -> dict[str, str]:
    return next((qpack_decode(p) for k, p in h3_frames(buf) if k == 1), {})


def looks_like_h3(buf: bytes) -> bool:
    """A known frame type and a plausible length; only meaningful for chunks of a QUIC provider."""
    kind = quic_varint(buf, 0)
    size = quic_varint(buf, kind[1]) if kind else None
    return bool(size) and kind[0] in (0, 1, 3, 4, 5, 7) and size[0] < 1_000_000


# ---------------------------------------------------------------- WebSocket

OPCODES = {0: "continuation", 1: "text", 2: "binary", 8: "close", 9: "ping", 10: "pong"}


def ws_frame(buf: bytes) -> dict | None:
    """fin, opcode, length, payload (unmasked, at most 4,096 bytes) and the length of the whole frame."""
    if len(buf) < 2:
        return None
    n, at = buf[1] & 127, 2
    if n > 125:
        width = 2 if n == 126 else 8
        if len(buf) < at + width:
            return None
        n, at = int.from_bytes(buf[at : at + width], "big"), at + width
    mask = None
    if buf[1] & 128:
        if len(buf) < at + 4:
            return None
        mask, at = buf[at : at + 4], at + 4
    raw = buf[at : at + min(n, 4096)]
    body = bytes(b ^ mask[k & 3] for k, b in enumerate(raw)) if mask else bytes(raw)
    return {"fin": bool(buf[0] & 128), "opcode": OPCODES.get(buf[0] & 15, "reserved"), "length": n, "payload": body, "total": at + n}


# ---------------------------------------------------------------- gRPC


def varint(buf: bytes, at: int) -> tuple[int, int] | None:
    v = 0
    for k in range(10):
        if at + k >= len(buf):
            return None
        v |= (buf[at + k] & 127) << (7 * k)
        if not buf[at + k] & 128:
            return v, at + k + 1
    return None


def _readable(data: bytes) -> str:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        text = None
    if text is not None and all(c == "\n" or not (ord(c) < 32 or 127 <= ord(c) < 160) for c in text):
        return f'"{text[:128]}"'
    return "hex:" + data[:32].hex()


def grpc_fields(buf: bytes, most: int = 64) -> list[tuple[int, int, str]]:
    """(number, wire type, value) of a message without its schema, behind the 5-byte prefix."""
    if len(buf) < 5:
        return []
    body, at, out = buf[5 : 5 + int.from_bytes(buf[1:5], "big")], 0, []
    while at < len(body) and len(out) < most:
        tag = varint(body, at)
        if tag is None:
            break
        kind, at = tag[0] & 7, tag[1]
        if kind == 0:
            v = varint(body, at)
            if v is None:
                break
            text, at = str(v[0] & (1 << 64) - 1), v[1]
        elif kind in (1, 5):
            width = 8 if kind == 1 else 4
            if at + width > len(body):
                break
            text, at = f"0x{int.from_bytes(body[at : at + width], 'little'):0{2 * width}x}", at + width
        elif kind == 2:
            n = varint(body, at)
            if n is None:
                break
            text, at = _readable(body[n[1] : n[1] + min(n[0], 256)]), min(len(body), n[1] + n[0])
        else:
            break
        out.append((tag[0] >> 3, kind, text))
    return out


# ---------------------------------------------------------------- captured chunks

#: Fixed layout of 144 bytes, little endian, before the payload (format version 2).
CHUNK = struct.Struct("<QIIQIBB2x16sQIHH4s4s16s16sHHIIIQIBBBxQ")
CHUNK_FIELDS = (
    "ts_ns", "pid", "tid", "ssl_ptr", "data_len", "direction", "ip_family", "comm", "cgroup_id", "netns_ino", "src_port", "dst_port", "src_ip4", "dst_ip4", "src_ip6", "dst_ip6",
    "abi_version", "flags", "actual_len", "copied_len", "conn_generation", "proc_start_ns", "dir_seq", "attribution", "provider_id", "role_hint", "sock_cookie",
)


def chunk_record(buf: bytes) -> dict | None:
    """A record of this layout, its payload clamped to what is there; null if it is too short or of another version."""
    if len(buf) < CHUNK.size:
        return None
    r = dict(zip(CHUNK_FIELDS, CHUNK.unpack_from(buf)))
    if r["abi_version"] != 2:
        return None
    n = min(r["copied_len"] or r["data_len"], len(buf) - CHUNK.size)
    return r | {"comm": r["comm"].split(b"\0")[0].decode("utf-8", "replace"), "payload": bytes(buf[CHUNK.size : CHUNK.size + n])}
