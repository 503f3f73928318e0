"""One direction of a connection of either HTTP version, told by its first bytes."""

from __future__ import annotations

from spanforge.sources.decode.fields import qpack_decode
from spanforge.sources.decode.frames import PREFACE, H2Direction, H2Message, early_server_frames, looks_like_h3, quic_varint
from spanforge.sources.decode.http1 import PREVIEW, Message, Stream


#: Bytes of a server's first frame that are held back at most; settings are shorter.
HOLD = 16 << 10


def as_message(m: H2Message) -> Message:
    """Pseudo headers in their places, ``:authority`` as host."""
    h = dict(m.headers)
    method, target, status, authority = h.pop(":method", None), h.pop(":path", None), h.pop(":status", None), h.pop(":authority", None)
    h.pop(":scheme", None)
    if authority is not None:
        h.setdefault("host", authority)
    return Message(method, target, int(status) if status and status.isdigit() else None, h, m.body, m.body_total, True, m.stream)


class H3Stream:
    """Messages of a direction of HTTP/3: fields, then data, until the next fields or the end. Only unconsumed bytes are kept."""

    def __init__(self) -> None:
        self.buf, self.now = bytearray(), None

    def feed(self, data: bytes) -> list[Message]:
        self.buf += data
        out = []
        while (kind := quic_varint(self.buf, 0)) and (size := quic_varint(self.buf, kind[1])) and size[1] + size[0] <= len(self.buf):
            body = bytes(self.buf[size[1] : size[1] + size[0]])
            del self.buf[: size[1] + size[0]]
            if kind[0] == 1:
                out += self.end()
                h = qpack_decode(body)
                self.now = as_message(H2Message(0, h))
                self.now.stream = None
            elif kind[0] == 0 and self.now:
                self.now.body_total += len(body)
                self.now.body += body[: max(0, PREVIEW - len(self.now.body))]
        return out

    def end(self) -> list[Message]:
        m, self.now = self.now, None
        return [m] if m else []

    def resync(self) -> None:
        self.buf.clear()
        self.now = None


class AutoStream:
    """HTTP/2 if the preface stands first or, from a server, a whole frame of the connection (no HTTP/1 message begins with a zero byte); HTTP/1 otherwise.

    A beginning that may still become the preface or such a frame is held back.
    ``quic`` says that a QUIC provider captured the bytes: then they are HTTP/3
    if they look like it.
    """

    def __init__(self, quic: bool = False) -> None:
        self.inner: Stream | H2Direction | H3Stream | None = None
        self.held, self.quic = b"", quic

    def feed(self, data: bytes) -> list[Message]:
        if self.inner is None:
            self.held += data
            if self.quic and looks_like_h3(self.held):
                self.inner = H3Stream()
            elif self.quic and len(self.held) < 16:  # the longest type and length
                return []
            elif self.held[:1] == b"\0" and len(self.held) < 9 + int.from_bytes(self.held[:3], "big") and len(self.held) < HOLD:
                return []
            elif PREFACE.startswith(self.held):
                if len(self.held) < len(PREFACE):
                    return []
                self.inner = H2Direction()
            else:
                self.inner = H2Direction() if self.held.startswith(PREFACE) else H2Direction(preface=False) if early_server_frames(self.held[: 9 + int.from_bytes(self.held[:3], "big")]) else Stream()
            data, self.held = self.held, b""
        if isinstance(self.inner, H2Direction):
            return [as_message(m) if kind == "message" else Message(stream=m, event=kind) for kind, m in self.inner.feed(data)]
        return self.inner.feed(data)

    def end(self) -> list[Message]:
        """What a close completes; open HTTP/2 messages are partial and leave as such."""
        if isinstance(self.inner, H2Direction):
            left = [as_message(m) for m in self.inner.open.values()]
            for m in left:
                m.complete = False
            self.inner.open = {}
            return left
        return self.inner.end() if self.inner else []

    def resync(self) -> None:
        """After a gap HTTP/1 goes on at the next message; HTTP/2 cannot, its compression state is lost."""
        if isinstance(self.inner, H2Direction):
            self.inner.broken = True
        elif self.inner:
            self.inner.resync()
        self.held = b""

    @property
    def resumable(self) -> bool:
        return not isinstance(self.inner, H2Direction)
