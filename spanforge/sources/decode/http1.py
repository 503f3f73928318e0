"""HTTP/1 messages out of a byte stream that may be cut anywhere."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from spanforge.sources.decode.fields import Malformed

HEAD_LIMIT, LINE_LIMIT, PREVIEW = 64 << 10, 1024, 8192
METHODS = frozenset((b"GET", b"POST", b"PUT", b"DELETE", b"PATCH", b"HEAD", b"OPTIONS", b"CONNECT", b"TRACE"))
OPCODES = {0: "continuation", 1: "text", 2: "binary", 8: "close", 9: "ping", 10: "pong"}
_STATUS = re.compile(rb"HTTP/1\.[01] ([1-9]\d\d)(?: .*)?$", re.S)


@dataclass
class Message:
    method: str | None = None
    target: str | None = None
    status: int | None = None
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""
    body_total: int = 0
    complete: bool = False
    #: HTTP/2: the stream, and 'reset' or 'goaway' for what is no message (of goaway, ``stream`` is the last one processed).
    #: WebSocket: the frame's kind, its payload in ``body``.
    stream: int | None = None
    event: str | None = None

    @property
    def truncated(self) -> bool:
        return self.body_total > len(self.body)


def merge(headers: dict[str, str], name: str, value: str, cookies: bool = False) -> None:
    """Repeated headers join: ``set-cookie`` by newline, HTTP/2 cookies by '; ', others by ', '."""
    between = "\n" if name == "set-cookie" else "; " if cookies and name == "cookie" else ", "
    headers[name] = headers[name] + between + value if name in headers else value


class Stream:
    """Feed bytes, get complete messages; only unconsumed bytes are kept.

    The state is one of head, fixed, size (of a chunk), chunk, trailer, close,
    raw (upgraded, at the head of a frame) and frame_ (in it), with the message being
    built and a count of bytes left. A direction is upgraded by the answer 101 or
    by a request for a WebSocket; if that was refused, the next request begins
    with a method and not with a frame's head, which tells the two apart.
    """

    def __init__(self) -> None:
        self.buf, self.state, self.left = bytearray(), "head", 0
        self.now: Message | None = None
        self.mask = b""

    def feed(self, data: bytes, answers: list[str] | None = None) -> list[Message]:
        """``answers`` are the methods the next responses answer, for bodies that HEAD and CONNECT have none of."""
        self.buf += data
        out: list[Message] = []
        try:
            while getattr(self, f"_{self.state}")(out, answers):
                pass
        except Malformed as e:
            e.messages = tuple(out)
            raise
        return out

    def end(self) -> list[Message]:
        """The peer closed: a body that lasts until then is complete, any other is partial."""
        m, self.now = self.now, None
        if m is None:
            return []
        m.complete = self.state == "close"
        self.state = "head"
        return [m]

    def resync(self) -> None:
        """After a gap: forget what is buffered and wait for the next start of a message."""
        self.buf.clear()
        self.state, self.left, self.now = "head", 0, None

    def _take(self, n: int) -> None:
        part = self.buf[:n]
        m = self.now
        m.body_total += len(part)
        if len(m.body) < PREVIEW:
            m.body += bytes(part[: PREVIEW - len(m.body)])
        del self.buf[:n]

    def _done(self, out: list[Message]) -> bool:
        self.now.complete = True
        out.append(self.now)
        self.now, self.state = None, "head"
        return True

    def _head(self, out: list[Message], answers: list[str] | None) -> bool:
        end = self.buf.find(b"\r\n\r\n")
        if end < 0:
            if len(self.buf) > HEAD_LIMIT:
                raise Malformed("head too long")
            return False
        try:
            lines = bytes(self.buf[:end]).decode("utf-8").split("\r\n")
        except UnicodeDecodeError as e:
            raise Malformed("head is not text") from e
        del self.buf[: end + 4]
        m = self.now = Message()
        first = lines[0].encode()
        if s := _STATUS.match(first):
            m.status = int(s[1])
        else:
            parts = first.split(b" ")
            if len(parts) != 3 or parts[0] not in METHODS or not parts[2].startswith(b"HTTP/1."):
                raise Malformed("first line")
            m.method, m.target = parts[0].decode(), parts[1].decode()
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if colon:
                merge(m.headers, name.strip().lower(), value.strip())
        return self._frame(out, answers.pop(0) if answers and m.status and not 100 <= m.status < 200 else None)

    def _frame(self, out: list[Message], answered: str | None) -> bool:
        m = self.now
        te, cl = m.headers.get("transfer-encoding"), m.headers.get("content-length")
        if te and cl:
            raise Malformed("both lengths")
        if m.status is not None and (m.status in (204, 304) or 100 <= m.status < 200 or answered in ("HEAD", "CONNECT")):
            return self._raw_or_done(out)
        if te:
            if te.lower().split(",")[-1].strip() == "chunked":
                self.state = "size"
                return True
            if m.status is None:
                raise Malformed("last coding")
            self.state = "close"
            return True
        if cl is not None:
            sizes = {x.strip() for x in cl.split(",")}
            if len(sizes) != 1 or not (size := sizes.pop()).isdigit() or len(size) > 18:
                raise Malformed("content-length")
            self.left, self.state = int(size), "fixed"
            return True
        if m.status is None:
            self._done(out)
            if "websocket" in m.headers.get("upgrade", "").lower():
                self.state = "raw"
            return True
        self.state = "close"
        return True

    def _raw_or_done(self, out: list[Message]) -> bool:
        upgraded = self.now.status == 101
        self._done(out)
        if upgraded:
            self.state = "raw"
        return True

    def _fixed(self, out: list[Message], _) -> bool:
        n = min(self.left, len(self.buf))
        self._take(n)
        self.left -= n
        return self._done(out) if not self.left else False

    def _line(self) -> bytes | None:
        end = self.buf.find(b"\r\n")
        if end < 0 and len(self.buf) > LINE_LIMIT:
            raise Malformed("line too long")
        if end < 0:
            return None
        line = bytes(self.buf[:end])
        del self.buf[: end + 2]
        return line

    def _size(self, out: list[Message], _) -> bool:
        line = self._line()
        if line is None:
            return False
        try:
            self.left = int(line.split(b";")[0].strip() or b"x", 16)
        except ValueError as e:
            raise Malformed("chunk size") from e
        self.state = "chunk" if self.left else "trailer"
        return True

    def _chunk(self, out: list[Message], _) -> bool:
        if self.left:
            n = min(self.left, len(self.buf))
            self._take(n)
            self.left -= n
        if self.left or len(self.buf) < 2:
            return False
        if self.buf[:2] != b"\r\n":
            raise Malformed("chunk end")
        del self.buf[:2]
        self.state = "size"
        return True

    def _trailer(self, out: list[Message], _) -> bool:
        line = self._line()
        if line is None:
            return False
        return self._done(out) if not line else True

    def _close(self, out: list[Message], _) -> bool:
        self._take(len(self.buf))
        return False

    def _raw(self, out: list[Message], _) -> bool:
        b = self.buf
        if len(b) < 2:
            return False
        if b[0] & 0x70 or (b[0] & 15) not in OPCODES:
            if bytes(b[:1]).isupper():  # a method or a status line: not upgraded after all
                self.state = "head"
                return True
            raise Malformed("frame")
        size, at = b[1] & 127, 2
        if size > 125:
            width = 2 if size == 126 else 8
            if len(b) < at + width:
                return False
            size, at = int.from_bytes(b[at : at + width], "big"), at + width
        if b[1] & 128:
            if len(b) < at + 4:
                return False
            at += 4
        self.mask = bytes(b[at - 4 : at]) if b[1] & 128 else b""
        self.now = Message(event=OPCODES[b[0] & 15])
        self.left, self.state = size, "frame_"
        del b[:at]
        return True

    def _frame_(self, out: list[Message], _) -> bool:
        n = min(self.left, len(self.buf))
        self._take(n)
        self.left -= n
        if self.left:
            return False
        m = self.now
        if self.mask:
            m.body = bytes(x ^ self.mask[k & 3] for k, x in enumerate(m.body))
        self._done(out)
        self.state = "raw"
        return True
