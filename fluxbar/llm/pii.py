"""Personal data: patterns propose spans, checksums confirm them, context words move the score."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxbar.llm.common import id_and_text, map_batches, struct

#: Kinds in the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "national_phone", "routing")
#: Characters of an IBAN by country (ISO 13616 registry).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: Words near a span that support a kind.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil", "téléphone"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "national_phone": ("phone", "tel", "call", "mobile", "fax"),
    "routing": ("routing", "aba", "bank"),
}
#: Score of a span whose check passed, without context.
START = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "national_phone": 0.4, "routing": 0.35}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins: the lookbehind changes no result, but long runs stay linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+(-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_ROUTING = re.compile(r"(?<![0-9A-Za-z])[0-9]{9}(?![0-9A-Za-z])")
_WORD = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k & 1:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(c if c <= "9" else str(ord(c) - 55) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ibans(text: str):
    at = 0
    while m := _IBAN.search(text, at):
        # Without an IBAN here the next may begin within the match; after one it may follow within the match.
        at = m.start() + 1
        want = IBAN_LENGTH.get(m.group()[:2], 0)
        seen = 0
        for k, c in enumerate(m.group()):
            seen += c != " "
            if seen == want:
                end = m.start() + k + 1
                if not text[end : end + 1].isalnum() and mod97(m.group()[: k + 1].replace(" ", "")):
                    yield m.start(), end
                    at = end
                break


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four base kinds: leftmost matches without overlap within a kind, those that fail their check dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() > 12 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def _more(text: str):
    if not re.search("[0-9]{2}", text):
        return
    for a, b in _ibans(text):
        yield "iban", a, b
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span()
    for m in _NATIONAL.finditer(text):
        yield "national_phone", *m.span()
    for m in _ROUTING.finditer(text):
        d = [ord(c) - 48 for c in m.group()]
        if (3 * (d[0] + d[3] + d[6]) + 7 * (d[1] + d[4] + d[7]) + d[2] + d[5] + d[8]) % 10 == 0:
            yield "routing", *m.span()


def score(text: str, kind: str, start: int, end: int, window: int = 48) -> float:
    """START, raised by context words within `window` characters on either side, lowered beside code-like digits."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - window) : start] + " " + text[end : end + window])}
    value = START[kind] + 0.35 * bool(near.intersection(CONTEXT[kind]))
    if kind != "email" and (text[max(0, start - 1) : start].isalnum() or text[end : end + 1].isalnum()):
        value -= 0.3
    return round(min(1.0, max(0.0, value)), 2)


def find_spans(text: str, threshold: float = 0.6) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """Base spans, and all spans with scores: the base ones always, others from `threshold` on where no base span is."""
    base = base_spans(text)
    every = [(*s, score(text, *s)) for s in base]
    # Disjoint stretches in order: what the spans so far cover.
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    for kind, a, b in _more(text):
        before = bisect_left(taken, (b, -1)) - 1
        if (before < 0 or taken[before][1] <= a) and (value := score(text, kind, a, b)) >= threshold:
            every.append((kind, a, b, value))
            insort(taken, (a, b))
    return base, sorted(every, key=lambda s: (KINDS.index(s[0]), s[1]))


SCHEMA = struct("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, redacted_chars long")


def find_pii(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row for each row of docs, from its whole text.

    n_* count the base spans; base_sha256 digests them; spans lists base and added
    spans as kind:start:end in code points, scores their scores in that order;
    redacted_chars is how many characters the spans cover. Null or empty texts
    give zeros, the digest of the empty string and empty lists. A null doc_id
    stays null, repeated rows give repeated results, other columns are ignored.
    """

    def run(batch):
        out = {name: [] for name in SCHEMA.names}
        out["doc_id"] = batch.column(0)
        for text in batch.column(1).to_pylist():
            base, every = find_spans(text, threshold)
            for kind in KINDS[:4]:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
            out["spans"].append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in every))
            out["scores"].append(",".join(f"{v:.2f}" for *_, v in every))
            covered, last = 0, 0
            for a, b in sorted((a, b) for _, a, b, _ in every):
                covered, last = covered + max(0, b - max(a, last)), max(last, b)
            out["redacted_chars"].append(covered)
        yield out

    return map_batches(id_and_text(docs), run, SCHEMA)


def redact(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(doc_id, text) with each span replaced by its kind in angle brackets; of overlapping spans the one that begins first."""

    def run(batch):
        texts = []
        for text in batch.column(1).to_pylist():
            parts, last = [], 0
            for kind, a, b, _ in sorted(find_spans(text, threshold)[1], key=lambda s: (s[1], -s[2])):
                if a >= last:
                    parts += [text[last:a], f"<{kind}>"]
                    last = b
            texts.append("".join([*parts, text[last:]]))
        yield {"doc_id": batch.column(0), "text": texts}

    return map_batches(id_and_text(docs), run, struct("doc_id long, text string"))
