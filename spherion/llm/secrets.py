"""Secret scan: an Aho-Corasick pass over the whole text, anchored expressions only at its hits, then checksums.

The automaton holds every casing of the keywords, so texts are scanned as they are and positions stay code points.
Runs of hexadecimal digits have no keyword; one linear expression finds them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Fixed values of the contract: kinds in their order, and their expressions at a hit.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Kinds that the method adds: prefix, expression, check.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_token(text: str) -> bool:
    """Tokens of a four-character prefix, thirty random characters and their CRC-32 in six base-62 digits."""
    value, digits = zlib.crc32(text[4:34].encode()), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return digits == text[34:]


def luhn(text: str) -> bool:
    """The check digit of payment cards."""
    total = 0
    for k, c in enumerate(reversed(re.sub(r"\D", "", text))):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


#: A private key to its END line; without one, to the end of the lines of base-64 text that follow BEGIN (line ends may be written as ``\\n``).
PRIVATE_KEY = re.compile(
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:(?:[A-Za-z0-9+/=:,.\\\s]|-(?!-))*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2})*+)"
)

ADDED = {
    "token_crc": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), crc_token),
    "private_key": (("-----BEGIN ",), PRIVATE_KEY, None),
    "card": (("card",), re.compile(r"card(?: ?number)?[:=]?\x20{0,3}(\d(?:[ -]?\d){12,18})(?!\d)"), luhn),
}
KINDS = (*BASE, *ADDED)

_AUTOMATON = None


def _automaton() -> ahocorasick.Automaton:
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = ahocorasick.Automaton()
        for word in WORDS:
            for cased in product(*[sorted({c, c.upper()}) for c in word]):
                _AUTOMATON.add_word("".join(cased), ("assign", len(word)))
        _AUTOMATON.add_word("AKIA", ("access", 4))
        for kind, (prefixes, _, _) in ADDED.items():
            for p in prefixes:
                _AUTOMATON.add_word(p, (kind, len(p)))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def scan(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) by start, then kind as listed in KINDS."""
    found, past = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in _automaton().iter(text))
    for start, kind in hits:
        if start < past[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            keep = m and len(m[1]) >= 8
        elif kind == "access":
            m = ACCESS.match(text, start)
            keep = m and m.end() - start >= 16
        else:
            _, pattern, check = ADDED[kind]
            m = pattern.match(text, start)
            keep = m and (check is None or check(m[m.re.groups]))
        if m:
            past[kind] = m.end()
        if keep:
            found.append((start, m.end(), kind))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan_batches(batches):
    for batch in batches:
        rows = [scan(t.as_py() or "") for t in batch.column(1)]
        base = [[s for s in r if s[2] in BASE] for r in rows]
        counts = [pa.array([sum(s[2] == kind for s in r) for r in base], pa.int64()) for kind in BASE]
        digests = pa.array([hashlib.sha256(_joined(r).encode()).hexdigest() for r in base], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array(map(_joined, rows), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Texts are scanned whole; a null text counts as empty and has no spans.  Null ids and repeated rows pass through;
    other columns are not read.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(_scan_batches, schema)


def redact(text: str) -> str:
    """``text`` with each union of overlapping spans replaced by ``[SECRET]``."""
    out, at = [], 0
    for start, end, _ in scan(text):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` redacted and ``n_chars`` counted anew; rows, order of columns and nulls stay."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = pa.array([None if t is None else redact(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
