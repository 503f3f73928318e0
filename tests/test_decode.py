import struct

import pytest

from spanforge.sources.decode import fields, frames
from spanforge.sources.decode.fields import Malformed
from spanforge.sources.decode.http1 import Stream

REQUEST = b"POST /a?b=1 HTTP/1.1\r\nHost: x\r\nX-Tag: a\r\nx-tag: b\r\nContent-Length: 5\r\n\r\nhello"
CHUNKED = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n3\r\nabc\r\n2;x=y\r\nde\r\n0\r\nT: 1\r\n\r\n"


@pytest.mark.parametrize("data,want", [(REQUEST, b"hello"), (CHUNKED, b"abcde")])
def test_http1_cut_anywhere(data, want):
    for k in range(len(data) + 1):
        s = Stream()
        got = s.feed(data[:k]) + s.feed(data[k:])
        assert [m.body for m in got] == [want] and got[0].complete and not s.buf
    s = Stream()
    assert [m.body for b in data for m in s.feed(bytes([b]))] == [want]


def test_http1_headers_and_pipelining():
    s = Stream()
    got = s.feed(REQUEST * 3 + CHUNKED)
    assert [m.method for m in got] == ["POST"] * 3 + [None]
    assert got[0].headers["x-tag"] == "a, b" and got[3].headers["set-cookie"] == "a=1\nb=2" and got[3].status == 200


def test_http1_without_length_and_without_body():
    s = Stream()
    assert s.feed(b"HTTP/1.1 200 OK\r\n\r\nrest") == []
    assert [(m.body, m.complete) for m in s.end()] == [(b"rest", True)]
    s = Stream()
    got = s.feed(b"HTTP/1.1 100 Continue\r\n\r\nHTTP/1.1 204 X\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n", ["GET", "HEAD"])
    assert [m.status for m in got] == [100, 204, 200]
    s = Stream()
    s.feed(REQUEST[:-2])
    assert [m.complete for m in s.end()] == [False]


def test_http1_long_body_is_counted_and_previewed():
    s = Stream()
    m = s.feed(b"PUT / HTTP/1.1\r\nContent-Length: 20000\r\n\r\n" + b"x" * 20000)[0]
    assert len(m.body) == 8192 and m.body_total == 20000 and m.truncated


@pytest.mark.parametrize("bad", [
    b"GET / HTTP/1.1\r\nContent-Length: 1\r\nTransfer-Encoding: chunked\r\n\r\n", b"GET / HTTP/1.1\r\nContent-Length: 1, 2\r\n\r\n", b"GET / HTTP/1.1\r\nContent-Length: -1\r\n\r\n",
    b"NOPE / HTTP/1.1\r\n\r\n", b"GET / HTTP/1.1\r\nX: \xff\r\n\r\n", b"a" * 70000, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n1\r\nabc\r\n",
    b"GET / HTTP/1.1\r\nContent-Length: 99999999999999999999999\r\n\r\n",
])
def test_http1_hostile(bad):
    with pytest.raises(Malformed):
        Stream().feed(bad)


def test_messages_before_a_violation_are_not_lost():
    with pytest.raises(Malformed) as e:
        Stream().feed(REQUEST + b"!" + REQUEST)
    assert [m.body for m in e.value.messages] == [b"hello"]


def test_hpack_examples_of_the_rfc():
    for text, packed in (("www.example.com", "f1e3c2e5f23a6ba0ab90f4ff"), ("no-cache", "a8eb10649cbf"), ("custom-key", "25a849e95ba97d7f")):
        assert fields.huffman_encode(text.encode()).hex() == packed
        assert fields.huffman_decode(bytes.fromhex(packed)).decode() == text
    h = fields.Hpack()
    assert h.decode(bytes.fromhex("828684418cf1e3c2e5f23a6ba0ab90f4ff"))[3] == (":authority", "www.example.com")
    assert h.decode(bytes.fromhex("828684be5886a8eb10649cbf"))[4] == ("cache-control", "no-cache")
    again = fields.Hpack(table=h.table)  # the state survives being stored
    assert again.decode(bytes.fromhex("828785bf408825a849e95ba97d7f8925a849e95bb8e8b4bf"))[4] == ("custom-key", "custom-value")
    assert fields.huffman_decode(fields.huffman_encode(bytes(range(256)))) == bytes(range(256))
    for bad in (b"\xff\xff", b"\x80", b"\xbf\xff\xff\xff\xff\xff\xff\xff\xff\xff\x7f"):
        with pytest.raises(Malformed):
            fields.Hpack().decode(bad)
    with pytest.raises(Malformed):
        fields.huffman_decode(b"\xff\xff\xff\xff")


def h2(path="/p", body=b"xyz"):
    block = fields.hpack_encode([(":path", path), ("cookie", "a"), ("cookie", "b"), ("x", "1"), ("x", "2")], index=True)
    return frames.PREFACE + frames.h2_frame(frames.HEADERS, 0, 1, block[:4]) + frames.h2_frame(frames.CONTINUATION, 4, 1, block[4:]) + frames.h2_frame(frames.DATA, 8, 1, b"\x02" + body + b"\0\0") + frames.h2_frame(frames.HEADERS, 5, 1, fields.hpack_encode([("t", "1")]))


def test_http2_cut_anywhere():
    data = h2()
    for k in range(len(data)):
        d = frames.H2Direction()
        (kind, m), = d.feed(data[:k]) + d.feed(data[k:])
        assert kind == "message" and m.body == b"xyz" and m.headers == {":path": "/p", "cookie": "a; b", "x": "1, 2", "t": "1"}


def test_http2_resets_and_violations():
    d = frames.H2Direction(preface=False)
    d.feed(frames.h2_frame(frames.HEADERS, 4, 1, fields.hpack_encode([("a", "b")])))
    assert d.feed(frames.h2_frame(frames.RST, 0, 1, b"\0" * 4)) == [("reset", 1)]
    d.feed(frames.h2_frame(frames.HEADERS, 4, 7, fields.hpack_encode([("a", "b")])))
    assert d.feed(frames.h2_frame(frames.GOAWAY, 0, 0, (5).to_bytes(4, "big") + b"\0" * 4)) == [("goaway", 5)] and not d.open
    for bad in (b"garbage that is no preface", frames.PREFACE + b"\xff\xff\xff\x00\x00\x00\x00\x00\x01", frames.PREFACE + frames.h2_frame(frames.CONTINUATION, 4, 1, b""), frames.PREFACE + frames.h2_frame(frames.DATA, 0, 1, b"") + frames.h2_frame(frames.HEADERS, 12, 1, b"\xff")):
        d = frames.H2Direction()
        assert d.feed(bad) == [] and d.broken
    assert frames.early_server_frames(frames.h2_frame(frames.SETTINGS, 0, 0, b"") + frames.h2_frame(frames.PING, 0, 0, b"12345678"))
    assert not frames.early_server_frames(frames.h2_frame(frames.DATA, 0, 0, b"")) and not frames.early_server_frames(b"") and not frames.early_server_frames(b"\0\0\x09\x04")


def test_http3_and_qpack():
    block = b"\0\0" + bytes([0xC0 | 17, 0x51, 3]) + b"/ab" + bytes([0x23]) + b"key" + b"\x01v"
    data = b"\x04\0\x01" + bytes([len(block)]) + block + b"\0\x02hi"
    assert frames.h3_frames(data) == [(4, b""), (1, block), (0, b"hi")]
    assert frames.h3_headers(data) == {":method": "GET", ":path": "/ab", "key": "v"}
    assert frames.looks_like_h3(data) and not frames.looks_like_h3(b"") and not frames.looks_like_h3(b"\x3f\x01")
    assert frames.quic_varint(bytes.fromhex("c2197c5eff14e88c"), 0) == (151288809941952652, 8) and frames.quic_varint(b"\x40", 0) is None
    assert fields.qpack_decode(b"") == {} and fields.qpack_decode(b"\0\0\x51\x7f") == {}


def test_websocket():
    assert frames.ws_frame(b"\x81\x05hello")["payload"] == b"hello"
    mask = b"\x37\xfa\x21\x3d"
    f = frames.ws_frame(b"\x81\x85" + mask + bytes(b ^ mask[k & 3] for k, b in enumerate(b"hello")))
    assert f["payload"] == b"hello" and f["opcode"] == "text" and f["fin"] and f["total"] == 11
    assert frames.ws_frame(b"\x82\x7f" + (70000).to_bytes(8, "big") + b"x" * 10)["length"] == 70000
    assert frames.ws_frame(b"\x81") is None and frames.ws_frame(b"\x81\x7e\x00") is None and frames.ws_frame(b"\x81\x85\x00") is None


def test_grpc():
    body = b"\x08\x96\x01\x12\x07testing\x19" + b"\x01" + b"\0" * 7 + b"\x25\x02\0\0\0\x2a\x02\xff\xfe"
    data = b"\0" + len(body).to_bytes(4, "big") + body
    assert frames.grpc_fields(data) == [(1, 0, "150"), (2, 2, '"testing"'), (3, 1, "0x0000000000000001"), (4, 5, "0x00000002"), (5, 2, "hex:fffe")]
    assert frames.grpc_fields(b"\0\0") == [] and frames.grpc_fields(b"\0\0\0\0\x05") == [] and frames.grpc_fields(b"\0\xff\xff\xff\xff\x08\x01") == [(1, 0, "1")]
    assert len(frames.grpc_fields(b"\0\0\0\xff\xff" + b"\x08\x01" * 100)) == 64


def test_chunk_record():
    values = (1, 42, 43, 4096, 5, 1, 4, b"nginx\0\0", 7, 1, 43210, 443, b"\x0a\0\0\1", b"\x0a\0\0\2", b"", b"", 2, 1, 40000, 3, 0, 9, 0, 1, 2, 1, 8)
    raw = frames.CHUNK.pack(*values)
    assert len(raw) == 144 and isinstance(frames.CHUNK, struct.Struct)
    r = frames.chunk_record(raw + b"hello")
    assert (r["pid"], r["comm"], r["payload"], r["dst_port"], r["actual_len"]) == (42, "nginx", b"hel", 443, 40000)
    assert frames.chunk_record(raw[:-1]) is None and frames.chunk_record(raw.replace(b"\2\0\1\0", b"\3\0\1\0")) is None


def _ws(payload, opcode=1, mask=b""):
    n = len(payload)
    head = bytes([128 | opcode]) + (bytes([n | (128 if mask else 0)]) if n < 126 else bytes([126 | (128 if mask else 0)]) + n.to_bytes(2, "big") if n < 65536 else bytes([127 | (128 if mask else 0)]) + n.to_bytes(8, "big"))
    return head + mask + (bytes(x ^ mask[k & 3] for k, x in enumerate(payload)) if mask else payload)


def test_an_upgraded_direction_is_read_as_frames_wherever_it_is_cut():
    from spanforge.sources.decode.auto import AutoStream

    big = bytes(range(256)) * 300
    sent = b"GET /c HTTP/1.1\r\nUpgrade: WebSocket\r\n\r\n" + _ws(b"hello", 1, b"abcd") + _ws(b"", 9, b"\1\2\3\4") + _ws(big, 2, b"wxyz") + _ws(b"\x03\xe8", 8)
    want = [("GET", None, 0), (None, "text", 5), (None, "ping", 0), (None, "binary", len(big)), (None, "close", 2)]
    for step in (1, 7, 1000, len(sent)):
        s = AutoStream()
        got = [m for k in range(0, len(sent), step) for m in s.feed(sent[k : k + step])]
        assert [(m.method, m.event, m.body_total) for m in got] == want and got[1].body == b"hello" and big.startswith(got[3].body) and len(got[3].body) == 8192
    s = AutoStream()
    got = s.feed(b"HTTP/1.1 101 x\r\nUpgrade: websocket\r\n\r\n" + _ws(b"hi"))
    assert [(m.status, m.event) for m in got] == [(101, None), (None, "text")]


def test_a_refused_upgrade_goes_on_as_requests():
    from spanforge.sources.decode.auto import AutoStream

    got = AutoStream().feed(b"GET /c HTTP/1.1\r\nUpgrade: websocket\r\n\r\nGET /d HTTP/1.1\r\n\r\n")
    assert [m.target for m in got] == ["/c", "/d"]


def test_early_frames_are_held_until_they_are_whole_and_quic_is_http3():
    from spanforge.sources.decode import frames
    from spanforge.sources.decode.auto import AutoStream, H3Stream

    early = frames.h2_frame(frames.SETTINGS, 0, 0, b"\0\3\0\0\0\x64")
    s = AutoStream()
    for k in range(len(early) - 1):
        assert s.feed(early[k : k + 1]) == [] and s.inner is None
    s.feed(early[-1:])
    assert isinstance(s.inner, frames.H2Direction)
    with pytest.raises(Malformed):
        AutoStream().feed(frames.h2_frame(frames.HEADERS, 4, 1, b"\x88") + b"\r\n\r\n")
    data = b"\x04\0" + b"\x01\x03\0\0" + bytes([0xC0 | 25]) + b"\0\x02ok" + b"\x01\x03\0\0" + bytes([0xC0 | 25])
    for step in (1, 3, len(data)):
        s = AutoStream(quic=True)
        got = [m for k in range(0, len(data), step) for m in s.feed(data[k : k + step])] + s.end()
        assert isinstance(s.inner, H3Stream) and [(m.status, m.body) for m in got] == [(200, b"ok"), (200, b"")]
