import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tonemark.llm import secrets as ops


def tlv(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | (n := (size.bit_length() + 7) // 8)]) + size.to_bytes(n)
    return bytes([tag]) + head + body


INTEGER, OCTETS, SEQUENCE, OID = 2, 4, 0x30, 6
PKCS8 = tlv(SEQUENCE, tlv(INTEGER, b"\0") + tlv(SEQUENCE, tlv(OID, b"\x2b\x65\x70")) + tlv(OCTETS, tlv(OCTETS, b"k" * 32)))
RSA = tlv(SEQUENCE, tlv(INTEGER, b"\0") + b"".join(tlv(INTEGER, b"\1" * 60) for _ in range(8)))


def url64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def signed(alg="HS256", size=32):
    parts = [json.dumps({"alg": alg, "typ": "JWT"}).encode(), b'{"sub":"1"}', b"s" * size]
    return ".".join(url64(p) for p in parts)


@pytest.mark.parametrize("key", [PKCS8, RSA])
def test_private_keys_are_confirmed_by_their_nested_lengths(key):
    run = base64.b64encode(key).decode()
    for text in (f"see {run} here", f"see {key.hex()} here"):
        assert [s[0] for s in ops.find_spans(text) if s[0] not in ops.BASE] == ["key"]
    broken = base64.b64encode(key[:1] + bytes([key[1] ^ 1]) + key[2:]).decode()
    assert not [s for s in ops.find_spans(f"see {broken} here") if s[0] == "key"]
    assert not ops.is_private_key(key[:-1])


def test_armoured_and_openssh_keys():
    body = "\n".join(base64.encodebytes(PKCS8).decode().split())
    text = f"x\n-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----\ny"
    assert ("pem", 2, len(text) - 2) in ops.find_spans(text)
    wrong = text.replace(body[10:14], "AAAA", 1)
    assert not [s for s in ops.find_spans(wrong) if s[0] == "pem"]
    chunk = lambda b: len(b).to_bytes(4) + b
    ssh = b"openssh-key-v1\0" + chunk(b"none") + chunk(b"none") + chunk(b"") + (1).to_bytes(4) + chunk(b"p" * 40) + chunk(b"q" * 90)
    assert ops.is_private_key(ssh) and not ops.is_private_key(ssh + b"x")


def test_signed_tokens_need_header_body_and_signature():
    good = signed()
    assert ("signed", 3, 3 + len(good)) in ops.find_spans(f"at {good} end")
    for bad in (signed(size=31), signed("none"), good.replace(good[:6], "eyJxxx"), "eyJ" + good[3:].replace(".", "", 1)):
        assert not [s for s in ops.find_spans(f"at {bad} end") if s[0] == "signed"]


def test_base_kinds_by_hand():
    text = 'PassWord = "abcd1234" token:short AKIA' + "A" * 12 + " " + "0f" * 16 + " é api_key=0123456789abcdef"
    found = [(k, text[a:b]) for k, a, b in ops.find_spans(text)]
    assert found == [
        ("assign", 'PassWord = "abcd1234'),
        ("access", "AKIA" + "A" * 12),
        ("hex", "0f" * 16),
        ("assign", "api_key=0123456789abcdef"),
    ]
    # a match that fails is used up: what it covers is not tried again
    assert ops.find_spans('token="secret = abcdefgh') == []
    assert ops.find_spans("paſſword=abcdefgh1") == []


def test_query_digests_and_redaction(frame):
    rows = [(1, "token=abcdefgh1 " + "a1" * 16), (2, None), (3, ""), (4, "clean"), (None, "AKIA" + "B" * 16), (4, "clean")]
    df = frame([(*r, None, None) for r in rows])
    got = {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"]): r for r in ops.digest(ops.scan(df), ["doc_id"]).collect()}
    assert got[1, 1, 0, 1]["spans"] == "assign:0:15,hex:16:48"
    assert got[1, 1, 0, 1]["base_sha256"] == hashlib.sha256(b"assign:0:15,hex:16:48").hexdigest()
    assert got[2, 0, 0, 0]["spans"] == "" and (None, 0, 1, 0) in got
    clean = ops.redact(df)
    assert clean.columns == df.columns
    texts = sorted((r[0] or "" for r in clean.select("text").collect()))
    assert texts == ["", "", "[secret]", "[secret] [secret]", "clean", "clean"]
    assert clean.where(F.col("text").isNull()).count() == 1
    assert ops.scan(df.limit(0)).collect() == []
