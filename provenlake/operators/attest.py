"""Signed statements about session documents, and their verification, as DataFrame operators.

A statement names the digest of a document and the head of its chain; it travels in an
envelope with a signature over the pre-authentication encoding of its payload.  Signing and
checking run in Arrow batches over the rows, in a plain Ed25519 (RFC 8032), as neither Spark
nor the standard library has one for executors.

Defined results: a document whose chain does not hold is refused and gets no envelope; an
envelope that does not parse is unsupported; a null document leaves the session unchecked.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenlake.operators.ledger import _document_status

# Public formats.
PAYLOAD_TYPE = "application/vnd.in-toto+json"
STATEMENT_TYPE = "https://in-toto.io/Statement/v1"
PREDICATE_TYPE = "urn:provenlake:session:v1"

P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)


def _even_x(y: int, sign: int) -> int | None:
    x2 = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(x2, (P + 3) // 8, P)
    if (x * x - x2) % P:
        x = x * ROOT % P
    if (x * x - x2) % P or (x == 0 and sign):
        return None
    return P - x if x & 1 != sign else x


def _add(p: tuple, q: tuple) -> tuple:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p: tuple) -> tuple:
    q = (0, 1, 1, 0)
    while n:
        if n & 1:
            q = _add(q, p)
        p, n = _add(p, p), n >> 1
    return q


_BY = 4 * pow(5, P - 2, P) % P
_BX = _even_x(_BY, 0)
BASE = (_BX, _BY, 1, _BX * _BY % P)


def _packed(p: tuple) -> bytes:
    z = pow(p[2], P - 2, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _point(b: bytes) -> tuple | None:
    n = int.from_bytes(b, "little")
    y = n & (1 << 255) - 1
    x = _even_x(y, n >> 255) if y < P else None
    return None if x is None else (x, y, 1, x * y % P)


def _sha(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, h[32:]


@lru_cache(64)
def public_key(seed: bytes) -> bytes:
    return _packed(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    pub = public_key(seed)
    r = _sha(prefix, message) % L
    big = _packed(_times(r, BASE))
    return big + ((r + _sha(big, pub, message) % L * a) % L).to_bytes(32, "little")


def holds(pub: bytes, signature: bytes, message: bytes) -> bool:
    if len(signature) != 64 or len(pub) != 32:
        return False
    a, r, s = _point(pub), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= L:
        return False
    left, right = _times(s, BASE), _add(r, _times(_sha(signature[:32], pub, message) % L, a))
    return not (left[0] * right[2] - right[0] * left[2]) % P and not (left[1] * right[2] - right[1] * left[2]) % P


def pre_authentication(kind: str, payload: bytes) -> bytes:
    t = kind.encode()
    return b" ".join([b"DSSEv1", str(len(t)).encode(), t, str(len(payload)).encode(), payload])


def key_id(pub: bytes) -> str:
    return hashlib.sha256(pub).hexdigest()[:16]


def _envelope(root: str, doc: str, seed: bytes, pub: bytes, issuer: str, issued_at: str) -> tuple[str, str | None]:
    try:
        n, status, _ = _document_status(doc)
    except (ValueError, AttributeError, TypeError):
        return "unreadable", None
    if status not in ("ok", "empty"):
        return status, None
    v = json.loads(doc)
    v = json.loads(v) if isinstance(v, str) else v
    predicate = {"law": v.get("law"), "title": v.get("title"), "chain_head": v.get("chain_head"), "entries": n, "done": (v.get("summary") or {}).get("done"), "open": (v.get("summary") or {}).get("open"), "issued_at": issued_at, "issuer": issuer or "unspecified"}
    statement = {"_type": STATEMENT_TYPE, "subject": [{"name": root, "digest": {"sha256": hashlib.sha256(doc.encode()).hexdigest()}}], "predicateType": PREDICATE_TYPE, "predicate": predicate}
    payload = json.dumps(statement, sort_keys=True, separators=(",", ":")).encode()
    sig = sign(seed, pre_authentication(PAYLOAD_TYPE, payload))
    return "attested", json.dumps({"payloadType": PAYLOAD_TYPE, "payload": base64.b64encode(payload).decode(), "signatures": [{"keyid": key_id(pub), "sig": base64.b64encode(sig).decode()}]})


def _mapped(df: DataFrame, of, names: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [of(*r.values()) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.string()) for i in range(len(names)))], names=["root", *names])

    return df.mapInArrow(run, ", ".join(f"{n} string" for n in ("root", *names)))


def attested(docs: DataFrame, seed: bytes, issuer: str = "", issued_at: str = "") -> DataFrame:
    """(root, status, envelope) of documents (root, doc); status is attested, or why the document is refused."""
    pub = public_key(seed)
    return _mapped(docs.select("root", "doc"), lambda root, doc: _envelope(root, doc, seed, pub, issuer, issued_at), ("status", "envelope"))


def _verified(envelope: str | None, doc: str | None, pub: bytes) -> tuple[str, str | None]:
    try:
        env = json.loads(envelope)
        if env.get("payloadType") != PAYLOAD_TYPE or not env.get("signatures"):
            return "unsupported", None
        payload, sig = base64.b64decode(env["payload"]), base64.b64decode(env["signatures"][0]["sig"])
    except (ValueError, TypeError, AttributeError, KeyError):
        return "unsupported", None
    if not holds(pub, sig, pre_authentication(PAYLOAD_TYPE, payload)):
        return "bad_signature", None
    statement = json.loads(payload)
    if statement.get("_type") != STATEMENT_TYPE or statement.get("predicateType") != PREDICATE_TYPE:
        return "unsupported", None
    head = statement["predicate"].get("chain_head")
    if doc is not None:
        if hashlib.sha256(doc.encode()).hexdigest() != (statement["subject"][0].get("digest") or {}).get("sha256"):
            return "subject_mismatch", head
        if _document_status(doc)[1] not in ("ok", "empty"):
            return "chain_tampered", head
        if json.loads(doc).get("chain_head") != head:
            return "head_mismatch", head
    return "verified", head


def verified(envelopes: DataFrame, docs: DataFrame, pub: bytes) -> DataFrame:
    """(root, status, chain_head) of envelopes (root, envelope) against the documents (root, doc) they speak of.

    status: verified, bad_signature, unsupported, subject_mismatch, chain_tampered or head_mismatch.
    """
    both = envelopes.select("root", "envelope").join(docs.select("root", "doc"), "root", "left")
    return _mapped(both, lambda root, e, d: _verified(e, d, pub), ("status", "chain_head"))


def payload_digest(envelope: str = "envelope") -> Column:
    return F.sha2(F.unbase64(F.get_json_object(envelope, "$.payload")), 256)


def anchored(envelopes: DataFrame, log: DataFrame) -> DataFrame:
    """(root, status, log_index) of envelopes against entries (root, payload_sha256, log_index) of an append-only log.

    status: anchored, mismatch (the entry is of another payload) or missing.
    """
    own = envelopes.select("root", payload_digest().alias("_own"))
    entry = log.groupBy("root").agg(F.min(F.struct("log_index", "payload_sha256")).alias("_e"))
    status = F.when(F.col("_e").isNull(), "missing").when(F.col("_own") == F.col("_e.payload_sha256"), "anchored").otherwise("mismatch")
    return own.join(entry, "root", "left").select("root", status.alias("status"), F.col("_e.log_index").alias("log_index"))
