"""Secret scans against a plain character scanner and a generated corpus with planted keys and decoys."""

import base64
import hashlib
import json
import random
import string

import pytest

from diffusio.llm import secrets


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def integer(rng, n):
    return der(2, bytes([rng.randrange(1, 128)]) + rng.randbytes(n - 1))


def oid(hexed):
    return der(6, bytes.fromhex(hexed))


RSA, EC, PBES2 = "2a864886f70d010101", "2a8648ce3d0201", "2a864886f70d01050d"


def rsa(rng):
    return der(0x30, der(2, b"\0"), integer(rng, 64), der(2, b"\1\0\1"), *[integer(rng, 64 if k == 0 else 32) for k in range(6)])


KEYS = {
    "pkcs1": rsa,
    "dsa": lambda r: der(0x30, der(2, b"\0"), integer(r, 128), integer(r, 20), *[integer(r, 100) for _ in range(3)]),
    "pkcs8": lambda r: der(0x30, der(2, b"\0"), der(0x30, oid(RSA), der(5)), der(4, rsa(r))),
    "sec1": lambda r: der(0x30, der(2, b"\1"), der(4, r.randbytes(32)), der(0xA0, oid("2a8648ce3d030107"))),
    "encrypted": lambda r: der(0x30, der(0x30, oid(PBES2), der(0x30)), der(4, r.randbytes(160))),
}
DECOYS = {
    "rsa public": lambda r: der(0x30, integer(r, 128), der(2, b"\1\0\1")),
    "public info": lambda r: der(0x30, der(0x30, oid(RSA), der(5)), der(3, b"\0" + r.randbytes(140))),
    "certificate": lambda r: der(0x30, der(0x30, der(0xA0, der(2, b"\2")), integer(r, 16), der(0x30, oid(RSA))), der(0x30, oid(RSA)), der(3, r.randbytes(129))),
    "digest": lambda r: der(0x30, der(0x30, oid("608648016503040201"), der(5)), der(4, r.randbytes(32))),
    "short": lambda r: rsa(r)[:-1],
    "long": lambda r: rsa(r) + b"x",
    "nested length": lambda r: der(0x30, rsa(r)[4:-1]),
    "noise": lambda r: r.randbytes(200),
}


def ssh(rng):
    field = lambda x: len(x).to_bytes(4, "big") + x
    return b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(rng.randbytes(40)) + field(rng.randbytes(60))


def b64(x):
    return base64.b64encode(x).decode()


def lines(x, n=64):
    return "\n".join(x[i : i + n] for i in range(0, len(x), n))


def part(x):
    return base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode().rstrip("=")


def jwt(rng, header=None):
    return f"{part(header or {'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': rng.randrange(99)})}.{part(rng.randbytes(32))}"


def pem(rng, name, body):
    return f"-----BEGIN {name}-----\n{lines(b64(body))}\n-----END {name}-----"


def structural(text):
    return [s for s in secrets.scan_text(text) if s[2] not in ("assign", "access", "hex")]


@pytest.mark.parametrize("form", KEYS)
def test_private_keys(form):
    rng = random.Random(form)
    for _ in range(5):
        key = KEYS[form](rng)
        for said in (b64(key), key.hex(), key.hex().upper(), base64.urlsafe_b64encode(key).decode()):
            assert structural(f"é {said} x") == [(2, 2 + len(said.rstrip("=")) + (len(said) - len(said.rstrip("="))), "der")], said
        assert structural("a " + pem(rng, "PRIVATE KEY", key))[0][2] == "pem"


@pytest.mark.parametrize("form", DECOYS)
def test_decoys(form):
    rng = random.Random(form)
    for _ in range(5):
        body = DECOYS[form](rng)
        for said in (b64(body), body.hex(), pem(rng, "RSA PRIVATE KEY", body), pem(rng, "PUBLIC KEY", body), pem(rng, "CERTIFICATE", body)):
            assert structural(f"a {said} b") == [], said


def test_other_forms():
    rng = random.Random(3)
    locked = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011223344556677\n\n" + lines(b64(rng.randbytes(320))) + "\n-----END RSA PRIVATE KEY-----"
    assert structural(locked) == [(0, len(locked), "pem")]
    assert structural(locked.replace("Proc-Type", "Comment")) == []
    key, token = ssh(rng), jwt(rng)
    assert [k for _, _, k in structural(f"{b64(key)} {pem(rng, 'OPENSSH PRIVATE KEY', key)} {token} {b64(token.encode())}")] == ["ssh", "pem", "jwt", "jwt"]
    assert [k for _, _, k in structural(b64(pem(rng, "PRIVATE KEY", rsa(rng)).encode()))] == ["pem"]
    assert structural(part(b'{ "alg":"none"}') + "." + part({}) + ".")
    for fake in (jwt(rng, {"typ": "x"}), jwt(rng, ["alg"]), token.replace(".", ":"), b64(key[:-1]), f"{part({'alg': 'HS256'})}.{part({})}."):
        assert structural(fake) == [], fake


def plain_base(text):
    """The base kinds, character by character."""
    out, n = [], len(text)

    def run(at, chars):
        while at < n and text[at] in chars:
            at += 1
        return at

    value, lower = string.ascii_letters + string.digits + "+/_.=-", "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    at = 0
    while at < n:
        end = None
        for w in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if lower.startswith(w, at):
                i = at + len(w)
                i += text[i : i + 1] in ('"', "'")
                i = run(i, " ")
                if text[i : i + 1] in (":", "="):
                    i = run(i + 1, " ")
                    i += text[i : i + 1] in ('"', "'")
                    stop = run(i, value)
                    if stop > i:
                        end = stop
                        if stop - i >= 12:
                            out.append((at, 0, stop, "assign"))
                break
        at = end or at + 1
    for k, (head, chars, least, kind) in enumerate((("AKIA", string.ascii_uppercase + string.digits, 18, "access"), ("", "0123456789abcdef", 16, "hex")), 1):
        at = 0
        while at < n:
            i = at + len(head)
            stop = run(i, chars) if text.startswith(head, at) else i
            if stop > i:
                if stop - at >= least:
                    out.append((at, k, stop, kind))
                at = stop
            else:
                at += 1
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def corpus():
    rng = random.Random(17)
    made, planted = [], []
    bits = ["password", "PassWd", "secret", "api_key", "APIKEY", "token", "'", '"', " ", "  ", ":", "=", "AKIA", "AKIAB3", "0123456789abcdef", "deadbeef", "é", "\n", "x", "Q9Q9Q9Q9Q9Q9Q9", "abcdefghijkl", "-", "."]
    for i in range(300):
        made.append((i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))))
    for i in range(300, 500):
        words, spans = [], []
        for _ in range(rng.randrange(1, 6)):
            words.append(" ".join(rng.choice(["über", "word", "they", "x"]) for _ in range(rng.randrange(1, 9))))
            real = rng.random() < 0.5
            if real:
                name = rng.choice([*KEYS])
                said, kind = rng.choice([(b64(KEYS[name](rng)), "der"), (pem(rng, "PRIVATE KEY", KEYS[name](rng)), "pem"), (jwt(rng), "jwt"), (b64(ssh(rng)), "ssh")])
                start = sum(map(len, words)) + len(words)
                spans.append((start, start + len(said), kind))
            else:
                said = rng.choice([b64(DECOYS[rng.choice([*DECOYS])](rng)), pem(rng, "CERTIFICATE", DECOYS["certificate"](rng)), rng.randbytes(20).hex().upper(), part(rng.randbytes(60)) + "." + part(b"x") + ".y"])
            words.append(said)
        made.append((i, " ".join(words)))
        planted.append((i, spans))
    return made, planted


def test_generated_corpus(spark):
    made, planted = corpus()
    odd = [(900, None), (901, ""), (902, "password=" + "a" * 3_000_000), (903, "-----BEGIN PRIVATE KEY-----" + " " * 1_000_000), (None, "AKIAABCDEFGHIJKLMN"), made[5], made[5]]
    df = spark.createDataFrame([(*r, 1) for r in made + odd], "doc_id long, text string, spans int")
    rows = secrets.digest_secrets(secrets.scan_secrets(df)).collect()
    assert len(rows) == len(made) + len(odd)
    texts = dict(made + odd)
    for r in rows:
        base = plain_base(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        assert [s for s in r["spans"].split(",") if s[:4] in ("assi", "acce", "hex:")] == base
    said = {r["doc_id"]: r["spans"].split(",") for r in rows}
    for i, spans in planted:
        assert [s for s in said[i] if s[:4] not in ("assi", "acce", "hex:") and s] == [f"{k}:{a}:{b}" for a, b, k in spans]
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def test_redact(spark):
    key = pem(random.Random(1), "PRIVATE KEY", rsa(random.Random(1)))
    rows = [(1, 'é password = "abcdefghijkl" AKIAABCDEFGHIJKLMN 0123456789abcdef', 9), (2, None, 7), (3, "", 0), (3, "", 0), (4, f"a {key} b", 1), (None, "plain", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in secrets.redact(df).collect() if r["text"] is not None)
    assert got == [(0, "plain", 5), (1, 'é [SECRET]" [SECRET] [SECRET]', 29), (3, "", 0), (3, "", 0), (4, "a [SECRET] b", 12)]
    assert secrets.redact(df).where("text IS NULL").first()["n_chars"] == 7
    assert secrets.redact(df.limit(0)).count() == 0 and "n_chars" not in secrets.redact(df.drop("n_chars")).columns
