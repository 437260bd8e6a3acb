import base64
import json
import re

from quayline.llm import secrets
from tests.llm.fixtures import DOCS, frame, near_copies


def tlv(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


PKCS8 = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2a\x86\x48\x86\xf7\x0d") + tlv(5, b"")) + tlv(4, bytes(range(200))))
PKCS1 = tlv(0x30, b"".join(tlv(2, bytes([i]) * 40) if i else tlv(2, b"\0") for i in range(9)))
SSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (b"p" * 51, b"s" * 80))


def b64(data, url=False):
    return (base64.urlsafe_b64encode if url else base64.b64encode)(data).decode()


JWT = ".".join(b64(x, True).rstrip("=") for x in (json.dumps({"alg": "HS256"}).encode(), json.dumps({"sub": "1"}).encode(), b"k" * 32))


def kinds(text):
    return [k for _, _, k in secrets.spans(text)]


def test_confirmed_kinds():
    assert "jwt" in kinds(f"x {JWT} y")
    assert kinds(f"x {b64(PKCS8)} y") == ["der_key"] and kinds(f"({b64(PKCS1)})") == ["der_key"] and kinds(f"x {b64(SSH)}") == ["ssh_key"]
    assert kinds("k " + PKCS8.hex().upper()) == ["hex_key"]
    pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", b64(PKCS8))) + "\n-----END PRIVATE KEY-----"
    assert "pem_key" in kinds(pem) and secrets.redact(pem, secrets.spans(pem)) == "[SECRET]"


SEALED = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01050d")) + tlv(0x30, b"")) + tlv(4, bytes(range(160))))
BLOCKS = bytes(range(7, 7 + 96))


def lines(data, size=64, by="\n"):
    return by.join(re.findall(f".{{1,{size}}}", b64(data)))


def armour(body, name="PRIVATE KEY", by="\n"):
    return f"-----BEGIN {name}-----{by}{body}{by}-----END {name}-----"


def test_armour_with_escapes_headers_and_ciphers():
    escaped = json.dumps({"private_key": armour(lines(PKCS8)) + "\n"})
    assert kinds(escaped) == ["pem_key"]
    assert kinds(armour(lines(PKCS1, by="\\r\\n"), by="\\r\\n")) == ["pem_key"]
    assert kinds(armour(lines(SEALED), "ENCRYPTED PRIVATE KEY")) == ["pem_key"]
    assert kinds(f"x {b64(SEALED)} y") == ["der_key"]
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{}\n\n"
    assert "pem_key" in kinds(armour(head.format("0A" * 16) + lines(BLOCKS), "RSA PRIVATE KEY"))
    assert kinds(armour("Comment: made-by me\n" + lines(PKCS1), "RSA PRIVATE KEY")) == ["pem_key"]
    # near misses: no whole blocks, no cipher named, a digest and not a password-based algorithm
    assert "pem_key" not in kinds(armour(head.format("0A" * 16) + lines(BLOCKS[:-1]), "RSA PRIVATE KEY"))
    assert "pem_key" not in kinds(armour("Proc-Type: 4,ENCRYPTED\n\n" + lines(BLOCKS), "RSA PRIVATE KEY"))
    digest = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("608648016503040201")) + tlv(5, b"")) + tlv(4, bytes(32)))
    assert kinds(armour(lines(digest))) == [] and kinds(f"x {b64(digest)} y") == []


def test_wrapped_keys_without_armour():
    for by in ("\n", "\r\n", "\\n"):
        text = f"see:\n{lines(PKCS8, by=by)}{by}unrelated words"
        found = secrets.spans(text)
        assert [k for _, _, k in found] == ["der_key"]
        # an escaped break is taken for one only where it is written
        assert secrets.redact(text, found) == f"see:\n[SECRET]{by}unrelated words"
    assert kinds(f"{lines(SSH, 70)}\n\nend") == ["ssh_key"]
    # near misses: a byte too few, a length that the lines do not reach, wrapped prose
    assert kinds(lines(PKCS8[:-4])) == [] and kinds(lines(PKCS8[:150])) == []
    assert kinds("\n".join(["M" + "ore" * 20] * 6)) == []


def test_hex_keys_and_spaced_token_headers():
    assert "hex_key" in kinds("k " + SSH.hex()) and "hex_key" not in kinds("k " + SSH[:-9].hex())
    head = b64(json.dumps({"alg": "HS256"}, indent=1).encode(), True).rstrip("=")
    rest = JWT.split(".", 1)[1]
    for spaced in (head, b64(b'{ "alg": "HS256"}', True).rstrip("=")):
        assert "jwt" in kinds(f"t {spaced}.{rest}") and "jwt" not in kinds(f"t {spaced[:-4]}.{rest}")


def test_broken_structures_are_not_reported():
    for data in (PKCS8[:-1], PKCS8 + b"\0" * 3, b"\x30" + PKCS8[1:2] + b"\x40" * 40, SSH[:-5], b"M" * 60):
        assert kinds(f"x {b64(data)} y") == []
    head, body, sig = JWT.split(".")
    for bad in (f"{head}.{body}.", f"{b64(b'{}', True).rstrip('=')}.{body}.{sig}", f"{head}.{sig}.{sig}"):
        assert "jwt" not in kinds(bad)
    assert "pem_key" not in kinds("-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----")


def brute(text):
    """The base kinds by the plain patterns, failing matches dropped afterwards."""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(f"({word})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [x for _, _, x in sorted(out)]


HARD = [
    "", "password=short", "secret=token : abcdefgh", "Token = 'abc123'", 'API_KEY: "x"', "apikey=abcdefghij", "paſſword=abcdefgh", "toKen=abcdef", "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 16, "akia" + "a" * 30,
    "deadbeef" * 3, "deadbee" * 3, "0" * 23 + "G" + "1" * 24, "é" * 5 + "passwd:abcdef é secret = 123456", "token=" + "a1" * 20000, "secret= token=abcdef", "x" * 50000 + " api_key=ABCDEF",
]


def test_base_spans_match_brute_force(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(HARD)] + near_copies(2)
    got = sorted((str(r.doc_id), r.spans) for r in secrets.digest(secrets.find_secrets(frame(spark, rows))).collect())
    base = lambda s: ",".join(x for x in s.split(",") if x.split(":")[0] in secrets.BASE)
    assert [(i, base(s)) for i, s in got] == sorted((str(r[0]), ",".join(brute(r[1] or ""))) for r in rows)
    assert secrets.find_secrets(spark.createDataFrame([], DOCS)).count() == 0


def test_redacted_documents_keep_their_columns(spark):
    rows = [(1, "a password=abcdef b", "en", "s", 19), (2, None, None, None, None), (3, "clean", "en", "s", 5), (4, "token=" + "ab" * 15, None, None, None)]
    got = secrets.redact_documents(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect()) == [(1, "a [SECRET] b", 12), (2, None, None), (3, "clean", 5), (4, "[SECRET]", 8)]


def test_long_wrapped_texts_take_linear_time():
    import time

    line = "A" * 76
    for size in (len(line) * 200_000 * 3 // 4, 4_000_000_000):
        # opens like a DER value: as long as the text, or longer than it
        head = base64.b64encode(b"\x30\x84" + size.to_bytes(4, "big") + b"\x02\x01\x00").decode()
        text = "\n".join([head + line[len(head) :], *[line] * 270_000])
        assert len(text) > 20_000_000
        start = time.perf_counter()
        secrets.spans(text)
        assert time.perf_counter() - start < 5
    armoured = "-----BEGIN RSA PRIVATE KEY-----\n" + "A: b\n" * 500_000 + "x\n-----END RSA PRIVATE KEY-----"
    start = time.perf_counter()
    assert secrets.spans(armoured) == [] and secrets.spans("-----BEGIN PRIVATE KEY-----" + "\\n" * 500_000 + "x-----END PRIVATE KEY-----") == []
    assert time.perf_counter() - start < 5
