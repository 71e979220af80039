from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import tracemalloc
import urllib.parse
import zlib

import pyarrow.parquet as pq
import pytest

from thriftline.llm import secrets

AKIA = "AKIA" + "ABCD2345EFGH6789"
HEX = "0123456789abcdef" * 2


def plain_base(text: str) -> list[str]:
    """The stated patterns, matched as stated, with failing matches dropped afterwards."""
    letters = lambda w: "".join(f"[{c.lower()}{c.upper()}]" for c in w)
    words = "|".join([letters(w) for w in ("password", "passwd", "secret", "token", "api")][:4] + [letters("api") + "_?" + letters("key")])
    assign = re.compile(rf"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def spans(text: str) -> list[str]:
    return secrets.span_list(secrets.secrets(text)[1]).split(",")


def test_base_spans_equal_the_stated_patterns():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    rng = random.Random(6)
    bits = ["password", "ToKeN", "api_key", "apikey", "ſecret", "=", ":", " ", '"', "'", "abc", "abcdef", "AKIA", "B" * 16, "0a" * 12, "é", "\n"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    for text in texts:
        assert secrets.span_list(secrets.secrets(text)[0]) == ",".join(plain_base(text))


def u16(text: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in text)


def b64(data: bytes | str) -> str:
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


PLAIN = f"password={'q7' * 5}"
WRAPS = [
    urllib.parse.quote(PLAIN, safe=""),
    "".join(f"%{b:02x}" for b in PLAIN.encode()),
    u16(PLAIN),
    "".join(f"&#{ord(c)};" for c in PLAIN),
    b64("note: " + PLAIN),
    base64.urlsafe_b64encode(b"~~~???" + PLAIN.encode()).decode(),
    b64(gzip.compress(PLAIN.encode())),
    b64(zlib.compress(PLAIN.encode())),
    b64(bz2.compress(PLAIN.encode())),
    b64(lzma.compress(PLAIN.encode())),
    b64(b64(b64(PLAIN))),
    b64(u16(urllib.parse.quote(PLAIN, safe=""))),
    urllib.parse.quote(b64(gzip.compress(b64(zlib.compress(u16(PLAIN).encode())).encode())), safe=""),
    "".join(f"%{b:02X}" for b in gzip.compress(PLAIN.encode())),
    "\n".join(re.findall(".{1,64}", b64("x" * 60 + " " + PLAIN + " " + "y" * 60))),
    "zz/" + b64("a readable line " + PLAIN),
]


@pytest.mark.parametrize("wrapped", WRAPS)
def test_wrapped_secrets_map_into_their_run(wrapped):
    before = "é text %zz before "
    found = [s.split(":") for s in spans(f"{before}{wrapped} after")]
    mine = [(int(a), int(b)) for k, a, b in found if k == "assign"]
    assert mine and all(len(before) <= a < b <= len(before) + len(wrapped) for a, b in mine)


def test_spans_are_exact_where_the_encoding_is_positional():
    text = "see " + "".join(f"%{b:02x}" for b in f"x {AKIA} y".encode())
    at = 4 + 3 * 2
    assert f"access:{at}:{at + 60}" in spans(text)
    text = "u " + u16(f"- {HEX} -")
    assert f"hex:{2 + 12}:{2 + 12 + 6 * 32}" in spans(text)
    run = b64("abcdef " + AKIA + " tail of it")
    assert f"access:{7 * 4 // 3}:{-(-27 * 4 // 3)}" in spans(run)


def test_base_spans_stay_and_layers_add():
    text = f"token=abcdefgh%2Fxyz {AKIA}"
    assert spans(text) == ["assign:0:14", "assign:0:20", f"access:21:{21 + len(AKIA)}"]


def test_worklist_ends_on_layers_that_decode_to_themselves():
    assert secrets.secrets("%25" * 500)[1] == []
    assert secrets.secrets("\\u005cu005cu005c" * 50)[1] == []


def test_large_decompressed_layers_are_scanned_whole(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 1000)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    rng = random.Random(1)
    for at in range(900, 1100, 7):
        body = ("z " * 3000)[:at] + AKIA + ("y " * 3000)
        for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
            run = b64(pack(body.encode()))
            assert secrets.secrets(f"{rng.random()} {run}")[1][0][0] == 1


def test_memory_does_not_grow_with_what_a_run_unpacks_to():
    rng = random.Random(2)
    block = bytes(rng.choice(b"ab    \n") for _ in range(1 << 14))

    def peak(megabytes: int) -> int:
        step = zlib.compressobj(9)
        packed = b"".join(step.compress(block) for _ in range(64 * megabytes))
        run = b64(packed + step.compress(PLAIN.encode()) + step.flush())
        tracemalloc.start()
        try:
            assert (0, 4, 4 + len(run)) in secrets.secrets(f"see {run}")[1]
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(8) < peak(2) + (4 << 20)


def test_long_runs_and_lines_take_linear_time():
    for text in ("Ab+/" * 500_000, "word\n" * 200_000, "a" * 15 + "\n " + "z" * 2_000_000 + "!"):
        assert secrets.secrets(text)[1] == []


def test_many_levels_of_escapes_keep_no_earlier_layer():
    text = "token%" + "25" * 500 + "3Dabcdefgh" + " x" * 5_000
    tracemalloc.start()
    try:
        assert (0, 0, text.index(" ")) in secrets.secrets(text)[1]
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()


SECOND = b"a first stream without any"
PARTED = [
    b64(b"\0user\0" + PLAIN.encode()),
    b64(b"\xff\xfe\x01 " + PLAIN.encode() + b"\x80\x81"),
    b64(PLAIN.encode("utf-16")),
    b64(PLAIN.encode("utf-16-be")),
    *(head + b64(PLAIN) for head in ("https://h.example/files/", "prefix_", "a/", "ab/", "abc/")),
    *(b64(pack(SECOND) + pack(PLAIN.encode())) for pack in (bz2.compress, lzma.compress, zlib.compress, gzip.compress)),
    b64(lzma.compress(SECOND) + b"\0" * 8 + lzma.compress(PLAIN.encode())),
    "files/" + b64(gzip.compress(PLAIN.encode())),
    "".join(f"%{b:02x}" for b in b"\x00\x01" + bz2.compress(SECOND) + bz2.compress(PLAIN.encode())),
    *(end.join(re.findall(f".{{1,{n}}}", b64("a note: " + PLAIN))) for n in (4, 16, 20) for end in ("\n", "\r\n", "\n    ", "%0A")),
    *(b64(b"\x00\x01\x02" + zlib.compress(PLAIN.encode(), level)) for level in (1, 3, 6, 9)),
    "\n".join(re.findall(".{1,16}", b64(b"head" + zlib.compress(PLAIN.encode())))),
]


@pytest.mark.parametrize("wrapped", PARTED)
def test_secrets_beside_unreadable_bytes_and_in_later_streams(wrapped):
    found = [(int(a), int(b)) for k, a, b in (s.split(":") for s in spans(f"x {wrapped} y") if s) if k == "assign"]
    assert found and all(2 <= a < b <= 2 + len(wrapped) for a, b in found)
    assert secrets.secrets(secrets.redacted(f"x {wrapped} y"))[1] == []


def test_redaction_removes_layers_and_keeps_the_rest():
    text = f"start {PLAIN} mid {b64(gzip.compress(AKIA.encode()))} end"
    out = secrets.redacted(text)
    assert out == "start [redacted] mid [redacted] end"
    assert secrets.redacted("nothing here é") == "nothing here é"


def test_tables(spark):
    rows = [(1, None), (2, ""), (3, f"x {PLAIN}"), (3, f"x {PLAIN}"), (None, AKIA), (4, "w " * 200000 + HEX)]
    df = spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id bigint, text string, n_chars int, spans string")
    found = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in secrets.scanned(df).collect()}
    assert found == {
        (1, 0, 0, 0, ""), (2, 0, 0, 0, ""), (3, 1, 0, 0, f"assign:2:{2 + len(PLAIN)}"),
        (None, 0, 1, 0, "access:0:20"), (4, 0, 0, 1, "hex:400000:400032"),
    }
    digest = secrets.scanned(df).where("doc_id = 1").first().base_sha256
    assert digest == hashlib.sha256(b"").hexdigest()
    clean = secrets.without_secrets(df)
    assert clean.schema == df.schema and clean.count() == 6
    assert all(r.text is None and r.n_chars is None or r.n_chars == len(r.text) for r in clean.collect())
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert secrets.scanned(empty).count() == 0 and secrets.without_secrets(empty).count() == 0
