"""Field compression: the static tables, Huffman code and dynamic table of HPACK (RFC 7541) and the stateless part of QPACK (RFC 9204)."""

from __future__ import annotations

from functools import lru_cache


def _table(text: str) -> list[tuple[str, str]]:
    return [(n, v) for n, _, v in (line.partition(" ") for line in text.strip().split("\n"))]


# RFC 7541 appendix A, from index 1.
HPACK_STATIC = _table("""
:authority
:method GET
:method POST
:path /
:path /index.html
:scheme http
:scheme https
:status 200
:status 204
:status 206
:status 304
:status 400
:status 404
:status 500
accept-charset
accept-encoding gzip, deflate
accept-language
accept-ranges
accept
access-control-allow-origin
age
allow
authorization
cache-control
content-disposition
content-encoding
content-language
content-length
content-location
content-range
content-type
cookie
date
etag
expect
expires
from
host
if-match
if-modified-since
if-none-match
if-range
if-unmodified-since
last-modified
link
location
max-forwards
proxy-authenticate
proxy-authorization
range
referer
refresh
retry-after
server
set-cookie
strict-transport-security
transfer-encoding
user-agent
vary
via
www-authenticate
""")
# RFC 9204 appendix A, from index 0.
QPACK_STATIC = _table("""
:authority
:path /
age 0
content-disposition
content-length 0
cookie
date
etag
if-modified-since
if-none-match
last-modified
link
location
referer
set-cookie
:method CONNECT
:method DELETE
:method GET
:method HEAD
:method OPTIONS
:method POST
:method PUT
:scheme http
:scheme https
:status 103
:status 200
:status 304
:status 404
:status 503
accept */*
accept application/dns-message
accept-encoding gzip, deflate, br
accept-ranges bytes
access-control-allow-headers cache-control
access-control-allow-headers content-type
access-control-allow-origin *
cache-control max-age=0
cache-control max-age=2592000
cache-control max-age=604800
cache-control no-cache
cache-control no-store
cache-control public, max-age=31536000
content-encoding br
content-encoding gzip
content-type application/dns-message
content-type application/javascript
content-type application/json
content-type application/x-www-form-urlencoded
content-type image/gif
content-type image/jpeg
content-type image/png
content-type text/css
content-type text/html; charset=utf-8
content-type text/plain
content-type text/plain;charset=utf-8
range bytes=0-
strict-transport-security max-age=31536000
strict-transport-security max-age=31536000; includesubdomains
strict-transport-security max-age=31536000; includesubdomains; preload
vary accept-encoding
vary origin
x-content-type-options nosniff
x-xss-protection 1; mode=block
:status 100
:status 204
:status 206
:status 302
:status 400
:status 403
:status 421
:status 425
:status 500
accept-language
access-control-allow-credentials FALSE
access-control-allow-credentials TRUE
access-control-allow-headers *
access-control-allow-methods get
access-control-allow-methods get, post, options
access-control-allow-methods options
access-control-expose-headers content-length
access-control-request-headers content-type
access-control-request-method get
access-control-request-method post
alt-svc clear
authorization
content-security-policy script-src 'none'; object-src 'none'; base-uri 'none'
early-data 1
expect-ct
forwarded
if-range
origin
purpose prefetch
server
timing-allow-origin *
upgrade-insecure-requests 1
user-agent
x-forwarded-for
x-frame-options deny
x-frame-options sameorigin
""")


def _huffman() -> dict[tuple[int, int], int]:
    """(length, code) to symbol. The code is canonical: within a length codes ascend with the symbol, so the lengths are enough."""
    by_length = {
        5: "012aceiost", 6: " %-./3456789=A_bdfghlmnpru", 7: ":BCDEFGHIJKLMNOPQRSTUVWYjkqvwxyz", 8: "&*,;XZ", 10: "!\"()?", 11: "'+|", 12: "#>", 13: "\0$@[]~", 14: "^}", 15: "<`{",
    }
    more = {
        19: (92, 195, 208), 20: (128, 130, 131, 162, 184, 194, 224, 226), 21: (153, 161, 167, 172, 176, 177, 179, 209, 216, 217, 227, 229, 230),
        22: (129, 132, 133, 134, 136, 146, 154, 156, 160, 163, 164, 169, 170, 173, 178, 181, 185, 186, 187, 189, 190, 196, 198, 228, 232, 233),
        23: (1, 135, 137, 138, 139, 140, 141, 143, 147, 149, 150, 151, 152, 155, 157, 158, 165, 166, 168, 174, 175, 180, 182, 183, 188, 191, 197, 231, 239),
        24: (9, 142, 144, 145, 148, 159, 171, 206, 215, 225, 236, 237), 25: (199, 207, 234, 235), 26: (192, 193, 200, 201, 202, 205, 210, 213, 218, 219, 238, 240, 242, 243, 255),
        27: (203, 204, 211, 212, 214, 221, 222, 223, 241, 244, 245, 246, 247, 248, 250, 251, 252, 253, 254), 28: (*range(2, 9), 11, 12, *range(14, 22), *range(23, 32), 127, 220, 249), 30: (10, 13, 22, 256),
    }
    lengths = {n: tuple(map(ord, s)) for n, s in by_length.items()} | more
    out, code, last = {}, 0, 0
    for n in sorted(lengths):
        code <<= n - last
        for s in sorted(lengths[n]):
            out[n, code] = s
            code += 1
        last = n
    return out


HUFFMAN = _huffman()
_ENCODE = {s: f"{c:0{n}b}" for (n, c), s in HUFFMAN.items()}
#: Strings up to this length are kept as they were last packed or unpacked.
SHORT, KEPT = 64, 8192


class Malformed(ValueError):
    """Bytes that break the format; ``messages`` are those that were complete before."""

    messages: tuple = ()


@lru_cache(1)
def _rows() -> list:
    """For the beginning of a symbol, a row: by byte the symbols it completes and the row of what is unfinished then; last, what is wrong if the string ends there."""
    starts = [(n - k, c >> k) for n, c in HUFFMAN for k in range(1, n + 1)]
    rows: dict[tuple[int, int], list] = {x: [] for x in dict.fromkeys(starts)}
    bad: list = []
    bad += [*[(b"", bad)] * 256, "end of string inside a string"]

    def half(n: int, code: int, four: int) -> tuple[bytes, tuple[int, int] | None]:
        out = bytearray()
        for bit in range(3, -1, -1):
            n, code = n + 1, code << 1 | four >> bit & 1
            if (s := HUFFMAN.get((n, code))) is not None:
                if s == 256:
                    return bytes(out), None
                out.append(s)
                n = code = 0
        return bytes(out), (n, code)

    halves = {x: [half(*x, four) for four in range(16)] for x in rows}
    for (n, code), row in rows.items():
        for first, left in halves[n, code]:
            row += [(first + second, bad if then is None else rows[then]) for second, then in halves[left]] if left else [(first, bad)] * 16
        row.append(None if n < 8 and code == (1 << n) - 1 else "padding")
    return rows[0, 0]


def huffman_decode(data: bytes) -> bytes:
    out, row = [], _rows()
    for byte in data:
        done, row = row[byte]
        out.append(done)
    if row[256]:
        raise Malformed(row[256])
    return b"".join(out)


def huffman_encode(data: bytes) -> bytes:
    bits = "".join(map(_ENCODE.__getitem__, data))
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


def read_int(buf: bytes, at: int, bits: int) -> tuple[int, int]:
    """A prefixed integer and the place behind it."""
    if at >= len(buf):
        raise Malformed("cut")
    top = (1 << bits) - 1
    v = buf[at] & top
    at += 1
    if v < top:
        return v, at
    shift = 0
    while True:
        if at >= len(buf) or shift > 56:
            raise Malformed("integer")
        b = buf[at]
        at += 1
        v += (b & 127) << shift
        shift += 7
        if not b & 128:
            return v, at


def write_int(v: int, bits: int, flags: int = 0) -> bytes:
    top = (1 << bits) - 1
    if v < top:
        return bytes([flags | v])
    out, v = [flags | top], v - top
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def read_string(buf: bytes, at: int, bits: int = 7, huffman: bool = True) -> tuple[bytes, int]:
    packed = bool(buf[at] >> bits & 1) if at < len(buf) else False
    n, at = read_int(buf, at, bits)
    if at + n > len(buf):
        raise Malformed("cut")
    raw = bytes(buf[at : at + n])
    return (huffman_decode(raw) if packed and huffman else raw), at + n


def _plain(raw: bytes, packed: bool) -> str:
    return (huffman_decode(raw) if packed else raw).decode("utf-8", "replace")


_plain_kept = lru_cache(KEPT)(_plain)


class Hpack:
    """One direction's decoder; its table is plain data, so a state store can hold it."""

    def __init__(self, most: int = 4096, table: list[tuple[str, str]] | None = None) -> None:
        self.most, self.limit = most, most
        self.table = list(table or [])

    @staticmethod
    def _size(e: tuple[str, str]) -> int:
        return len(e[0].encode()) + len(e[1].encode()) + 32

    def _evict(self) -> None:
        while self.table and sum(map(self._size, self.table)) > self.most:
            self.table.pop()

    def _at(self, k: int) -> tuple[str, str]:
        if not 1 <= k <= len(HPACK_STATIC) + len(self.table):
            raise Malformed("index")
        return HPACK_STATIC[k - 1] if k <= len(HPACK_STATIC) else self.table[k - len(HPACK_STATIC) - 1]

    def decode(self, block: bytes) -> list[tuple[str, str]]:
        out, at, end = [], 0, len(block)
        while at < end:
            b = block[at]
            if b & 128:
                k, at = read_int(block, at, 7)
                out.append(self._at(k))
                continue
            if b & 224 == 32:
                self.most, at = read_int(block, at, 5)
                if self.most > self.limit:
                    raise Malformed("table size")
                self._evict()
                continue
            k, at = read_int(block, at, 6 if b & 64 else 4) if b & 63 else (0, at + 1)
            name = self._at(k)[0] if k else None
            while True:  # the name, if it is no number, and the value
                if at >= end:
                    raise Malformed("cut")
                first = block[at]
                n, at = (first & 127, at + 1) if first & 127 < 127 else read_int(block, at, 7)
                if at + n > end:
                    raise Malformed("cut")
                text = (_plain_kept if n <= SHORT else _plain)(block[at : at + n], first > 127)
                at += n
                if name is not None:
                    break
                name = text
            entry = (name, text)
            out.append(entry)
            if b & 64:
                self.table.insert(0, entry)
                self._evict()
        return out


def _written(text: str, huffman: bool) -> bytes:
    raw = text.encode()
    packed = huffman_encode(raw) if huffman else raw
    return write_int(len(packed), 7, 128 if huffman else 0) + packed


_written_kept = lru_cache(KEPT)(_written)


def hpack_encode(headers: list[tuple[str, str]], huffman: bool = True, index: bool = False) -> bytes:
    """Literal fields, for tests and replay."""
    out, first = [], b"\x40" if index else b"\0"
    for name, value in headers:
        out += (first, *((_written_kept if len(s) <= SHORT else _written)(s, huffman) for s in (name, value)))
    return b"".join(out)


def qpack_decode(block: bytes) -> dict[str, str]:
    """Fields of static and literal lines; references to a dynamic table are skipped, packed strings stay packed."""
    out: dict[str, str] = {}
    try:
        _, at = read_int(block, 0, 8)
        _, at = read_int(block, at, 7)
        while at < len(block):
            b = block[at]
            if b & 128:
                k, at = read_int(block, at, 6)
                if b & 64 and k < len(QPACK_STATIC):
                    out[QPACK_STATIC[k][0]] = QPACK_STATIC[k][1]
            elif b & 64:
                k, at = read_int(block, at, 4)
                value, at = read_string(block, at, huffman=False)
                if b & 16 and k < len(QPACK_STATIC):
                    out[QPACK_STATIC[k][0]] = value.decode("utf-8", "replace")
            elif b & 32:
                name, at = read_string(block, at, 3, huffman=False)
                value, at = read_string(block, at, huffman=False)
                out[name.decode("utf-8", "replace").lower()] = value.decode("utf-8", "replace")
            else:
                at += 1
    except Malformed:
        pass
    return out
