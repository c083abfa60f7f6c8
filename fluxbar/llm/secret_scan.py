"""Secrets: patterns propose candidates; decoded structure (DER, wire formats, token headers) confirms added ones."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left

from pyspark.sql import DataFrame

from fluxbar.llm.common import id_and_text, map_batches, struct

#: Kinds in the order in which spans with one start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_HEADER = re.compile(r"[ \t]*([A-Za-z0-9-]+):[ \t]*(.*)")
#: Characters of the initial vector, in hex, and bytes of a block by the cipher's first word in DEK-Info.
_CIPHERS = {"DES": (16, 8), "AES": (32, 16), "CAMELLIA": (32, 16), "RC2": (16, 8), "BF": (16, 8), "IDEA": (16, 8), "CAST5": (16, 8), "SEED": (32, 16)}
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_HINT = re.compile(r"(?i)password|passwd|secret|token|api_?key")


def decode64(run: str) -> bytes | None:
    """Standard or URL-safe base64, with or without padding; None if it is neither."""
    run = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_end(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """Tag, content start and end of the DER element at `at`; None if its length is malformed or runs out of the data."""
    if at + 2 > len(data):
        return None
    size, start = data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > len(data) or data[start] == 0:
            return None
        size, start = int.from_bytes(data[start : start + n], "big"), start + n
        if size < 0x80:
            return None
    return (data[at], start, start + size) if start + size <= len(data) else None


def is_der(data: bytes | None) -> bool:
    """A SEQUENCE that fills the data exactly, whose nested lengths all add up, and that holds a number, an object id or a string of bits."""
    if not data or data[0] != 0x30 or not (top := der_end(data)) or top[2] != len(data):
        return False
    leaves, todo = set(), [(top[1], top[2])]
    while todo:
        at, end = todo.pop()
        while at < end:
            x = der_end(data, at)
            if not x or x[2] > end:
                return False
            tag, start, at = x
            if tag & 0x20:
                todo.append((start, at))
            else:
                leaves.add(tag & 0x1F)
    return bool(leaves & {2, 3, 4, 6}) and len(data) >= 32


def is_ssh(data: bytes | None) -> bool:
    """A private-key container or a public key, whose nested lengths all add up."""
    if not data:
        return False
    if data.startswith(_MAGIC):
        return _is_container(data[len(_MAGIC) :])
    fields = _fields(data)
    return bool(fields) and len(fields) >= 2 and fields[0].startswith(_KEY_TYPES)


_MAGIC, _KEY_TYPES = b"openssh-key-v1\0", (b"ssh-", b"ecdsa-sha2-", b"sk-")


def _fields(data: bytes, most: int | None = None) -> list[bytes] | None:
    """The length-prefixed fields that fill the data (with most: the first so many, then the rest as it is); None if a length runs out of it."""
    at, out = 0, []
    while at < len(data) and (most is None or len(out) < most):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out if most is None else [*out, data[at:]] if len(out) == most else None


def _is_container(body: bytes) -> bool:
    """Cipher, derivation and its options, the number of keys, so many public keys of a known type, and a private part in whole blocks."""
    head = _fields(body, 3)
    if not head or len(head[3]) < 4:
        return False
    n = int.from_bytes(head[3][:4], "big")
    keys = _fields(head[3][4:]) if 1 <= n <= 64 else None
    if not keys or len(keys) != n + 1 or not keys[n] or len(keys[n]) % 8:
        return False
    if head[0] == b"none" and keys[n][:4] != keys[n][4:8]:
        return False
    public = [_fields(k) for k in keys[:n]]
    return all(f and len(f) >= 2 and f[0].startswith(_KEY_TYPES) for f in public)


def armoured(text: str):
    """(start, end, body) of each private key between its BEGIN and the next END, if both name it alike."""
    begun = None
    for m in _ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begun = m
        elif begun is not None:
            if begun[2] == m[2]:
                yield begun.start(), m.end(), text[begun.end() : m.start()]
            begun = None


def is_private_key(body: str) -> bool:
    """The base64 after the headers, if any, is DER or a container; one that its headers call encrypted is whole blocks of the cipher they name."""
    headers, code, lines = {}, [], body.replace("\r\n", "\n").strip().split("\n")
    for line in lines:
        if not code and (m := _HEADER.fullmatch(line)):
            headers[m[1].lower()] = m[2].strip()
        else:
            code.append(line)
    data = decode64("".join(code))
    if headers.get("proc-type", "").upper().replace(" ", "").endswith(",ENCRYPTED"):
        cipher, _, vector = headers.get("dek-info", "").partition(",")
        size, block = _CIPHERS.get(cipher.strip().split("-")[0].upper(), (0, 1))
        return bool(data) and size > 0 and bool(re.fullmatch(f"[0-9A-Fa-f]{{{size}}}", vector.strip())) and len(data) % block == 0
    return is_der(data) or is_ssh(data)


def is_token(run: str) -> bool:
    """A signed token: its first part decodes to a JSON object that names an algorithm, its second to JSON or an encrypted part."""
    head, body, _ = run.split(".", 2)
    try:
        header = json.loads(decode64(head) or b"")
        payload = decode64(body)
        return isinstance(header, dict) and isinstance(header.get("alg"), str) and payload is not None and ("enc" in header or isinstance(json.loads(payload), dict))
    except (ValueError, RecursionError):
        return False


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The three base kinds, by start and then kind; matches that are too short are dropped."""
    out = []
    if _HINT.search(text):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates whose decoded structure is that of a key or a signed token."""
    out = []
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_token(m.group())]
    if "PRIVATE KEY-----" in text:
        for start, end, body in armoured(text):
            if is_private_key(body):
                out.append(("pem", start, end))
    covered = sorted((a, b) for _, a, b in out)
    for m in _BASE64.finditer(text):
        # Confirmed spans don't overlap: only the last that begins before this one ends can meet it.
        before = bisect_left(covered, (m.end(), -1)) - 1
        if before < 0 or covered[before][1] <= m.start():
            run = m.group()
            data = decode64(run)
            if data and not data[:1] == b"\x30" and re.fullmatch("[0-9A-Fa-f]+", run) and len(run) % 2 == 0:
                data = bytes.fromhex(run)
            if is_der(data):
                out.append(("der", *m.span()))
            elif is_ssh(data):
                out.append(("ssh", *m.span()))
    return out


SCHEMA = struct("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, from its whole text.

    n_assign, n_access and n_hex count the base spans and base_sha256 digests
    them; spans lists these and the structurally confirmed ones as
    kind:start:end in code points, by start and then kind; n_confirmed counts
    the latter. An assign span is the whole match, from the key word to the
    value's end. Null or empty texts give zeros and the empty string's digest.
    A null doc_id stays null, repeated rows give repeated results, other
    columns are ignored.
    """

    def run(batch):
        out = {name: [] for name in SCHEMA.names}
        out["doc_id"] = batch.column(0)
        for text in batch.column(1).to_pylist():
            base, more = base_spans(text), confirmed_spans(text)
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
            every = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))
            out["spans"].append(",".join(f"{k}:{a}:{b}" for k, a, b in every))
            out["n_confirmed"].append(len(more))
        yield out

    return map_batches(id_and_text(docs), run, SCHEMA)
