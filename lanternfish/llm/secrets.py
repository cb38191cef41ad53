"""Secret scan: Aho-Corasick keywords, anchored expressions near their hits, embedded checksums."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in their order, and the expressions of the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "card", "iban")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# Kinds with a checksum of their own.
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CARD = re.compile(r"card[^0-9\n]{0,24}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", re.I | re.A)
# The countries of each length of an IBAN.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A number has the length of its country's, in capitals, perhaps in groups; what follows it is no part of it.
IBAN = re.compile(r"(?i:iban)[^A-Za-z0-9\n]{0,8}(" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items()) + ")(?![A-Za-z0-9])", re.A)
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "card": "card", "iban": "iban",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER = {c: c + 32 for c in range(65, 91)}
RESULT = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
_AUTOMATON = None


def automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            _AUTOMATON.add_word(word, (kind, len(word)))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def crc_base62(body: str, check: str) -> bool:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out == check


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits) if c.isdigit()]
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    if kind in ("github", "npm"):
        return crc_base62(m[1], m[2])
    return luhn(m[1]) if kind == "card" else mod97(m[1])


EXPRESSIONS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "card": CARD, "iban": IBAN}


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind.

    Of each kind, matches are the leftmost that don't overlap; one that fails its length or checksum is
    dropped after it has taken its place. Runs of hexadecimal digits have no keyword and are sought as runs.
    """
    low = text.lower()
    if len(low) != len(text):  # some letters grow when lower-cased
        low = text.translate(LOWER)
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in automaton().iter(low))
    past, spans = dict.fromkeys(KINDS, 0), []
    for start, kind in hits:
        if start >= past[kind] and (m := EXPRESSIONS[kind].match(text, start)):
            past[kind] = m.end()
            if _valid(kind, m):
                spans.append((start, m.end(), kind))
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of each row.

    ``spans`` are kind:start:end in code points, end exclusive, by start and then kind; ``base_sha256``
    is the hash of those of the first three kinds. Of matches of a kind that overlap the leftmost is taken; spans
    of one start come in the order of kinds. A null text is an empty one and has no spans; very long texts
    are scanned whole, one at a time. Repeated rows give equal results; columns other than the two are not
    read, whatever they are called; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for t in batch.column(1):
                spans = scan(t.as_py() or "")
                base = [s for s in spans if s[2] in KINDS[:3]]
                for k in range(3):
                    columns[k].append(sum(s[2] == KINDS[k] for s in base))
                columns[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                columns[4].append(_joined(spans))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, {RESULT}")
