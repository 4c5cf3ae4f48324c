"""Secret scan: keyword automaton, anchored patterns near its hits, checksum validation.

An Aho-Corasick automaton finds every keyword in one pass over the ASCII-lower-cased text.  A
pattern is tried only at a hit, anchored there, in the order of the text; a match moves on to
its end, so the result is that of a leftmost, non-overlapping search over the whole text.
Hex runs have no keyword; their prefilter is one pass over the bytes for runs of 32 or more.
Tokens that embed a checksum or a structure are reported only when it holds.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.llm import textkernel as tk

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "forge", "registry", "jwt", "pem", "card")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
FORGE = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
REGISTRY = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
RUN = re.compile(r"[A-Za-z0-9_-]*")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----")
CARD = re.compile(r"(?:card|visa|mastercard)(?: number| no\.?)?\s*[:=]\s*(\d(?:[ -]?\d){12,18})(?!\d)", re.IGNORECASE | re.ASCII)

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """Six base-62 digits of the CRC-32 of a token body."""
    value, out = binascii.crc32(body.encode()), ""
    for _ in range(6):
        value, k = divmod(value, 62)
        out = _DIGITS[k] + out
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _jwt(m: re.Match) -> bool:
    head = m[0].split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


#: keyword -> (kind, pattern, the check that a match must pass)
_RULES = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), ("assign", ASSIGN, lambda m: len(m[2]) >= 8)),
    "akia": ("access", ACCESS, lambda m: len(m[0]) >= 16),
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("forge", FORGE, lambda m: base62_crc(m[0][4:34]) == m[0][34:])),
    "npm_": ("registry", REGISTRY, lambda m: base62_crc(m[0][4:34]) == m[0][34:]),
    "eyj": ("jwt", JWT, _jwt),
    "-----begin ": ("pem", PEM, lambda m: True),
    **dict.fromkeys(("card", "visa", "mastercard"), ("card", CARD, lambda m: luhn(re.sub(r"\D", "", m[1])))),
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, rule in _RULES.items():
        found.add_word(word, (len(word), *rule))
    found.make_automaton()
    return found


def scan(text: str | None, auto: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans of a text, sorted; code points, end exclusive."""
    if not text:
        return []
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z alone, so positions stay
    spans: list[tuple[int, int, int]] = []
    free: dict[str, int] = {}
    hits = [(end + 1 - size, kind, pattern, check) for end, (size, kind, pattern, check) in auto.iter(low)]
    for at, kind, pattern, check in sorted(hits, key=lambda x: x[0]):
        if at < free.get(kind, 0):
            continue
        m = pattern.match(text, at)
        if m:
            free[kind] = m.end()
            if check(m):
                spans.append((at, KINDS.index(kind), m.end()))
        elif kind == "jwt" and text.startswith("eyJ", at):
            # what follows this run of characters is no second part, for no start within it
            free[kind] = RUN.match(text, at).end()
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans.sort()
    return spans


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]):
    auto = automaton()
    for batch in batches:
        counts: list[list[int]] = [[], [], []]
        digests, all_spans, parts = [], [], []
        for text in batch.column(batch.num_columns - 1):
            spans = scan(text.as_py(), auto)
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in spans))
            base = _join(x for x in spans if x[1] < 3)
            digests.append(hashlib.sha256(base.encode()).hexdigest())
            all_spans.append(_join(spans))
            parts.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(parts, kind)],
            names=[*batch.schema.names[:-1], "n_assign", "n_access", "n_hex", "base_sha256", "spans", "secrets"],
        )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, digest of the base spans, all spans as text and structs.

    One pass, no shuffle; rows are independent, so repeated rows and null ids come back as they
    are.  A null text counts as empty.  Other columns are not read.  An empty table gives an
    empty result.
    """
    tk.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, secrets array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(_scan_batches, schema)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<SECRET:{}>") -> DataFrame:
    """The same rows and columns with every secret span in the text replaced by a mark of its kind.

    Overlapping spans are merged under the kind of the first.  Null texts stay null.  A column
    ``n_chars``, where present, is recounted for texts that change.
    """
    tk.bound_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        auto = automaton()
        for batch in batches:
            texts, changed = [], []
            for cell in batch.column(at):
                text = cell.as_py()
                out, end = [], 0
                for s, k, e in scan(text, auto):
                    if s >= end:
                        out += [text[end:s], mark.format(KINDS[k])]
                    end = max(end, e)
                changed.append(bool(out))
                texts.append("".join(out) + text[end:] if out else text)
            cols = list(batch.columns)
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(changed)], names=[*batch.schema.names, "__changed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInArrow(run, f"{fields}, __changed boolean")
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__changed"), F.length(text_col).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*names)
