"""Masking of personal data and secrets: candidate spans by pattern, kept if a validator accepts them, overlaps resolved.

Patterns are bounded, so a text of any length is searched in linear time, and need nothing but what RE2 has. Spans that
overlap are resolved in one sweep: the one that begins first stays, of those the longest, then the kind named first.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from millrace.catalog import query
from millrace.session import table


def luhn(text: str) -> bool:
    """The checksum of payment cards over the text's digits."""
    digits = [int(c) for c in reversed(text) if c in "0123456789"]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def mod97(text: str) -> bool:
    """The checksum of bank account numbers: the country and check digits go to the end, letters count from 10."""
    bare = text.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def entropy(text: str) -> float:
    """Bits a character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def octets(text: str) -> bool:
    return all(int(p) < 256 for p in text.split("."))


# For each kind its pattern, the group that is masked, and what the validator asks for.
SECRET = r"\b(?:[Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|PASSWORD|SECRET|TOKEN|[Aa]pi_?[Kk]ey|API_KEY)\b[\x22']?\s{0,4}[=:]\s{0,4}[\x22']?([A-Za-z0-9+/_=.-]{8,200})"
EMAIL = r"\b([A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})\b"
CARD = r"\b([0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})\b"
ACCOUNT = r"\b([A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?))\b"
ADDRESS = r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"
PHONE = r"((?:\+[0-9]{1,3}[ .-])?(?:\([0-9]{3}\) |[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4})\b"
LEAST_ENTROPY = 3.0

KINDS: dict[str, tuple[str, Callable[[str], bool]]] = {
    "SECRET": (SECRET, lambda s: entropy(s) >= LEAST_ENTROPY),
    "EMAIL": (EMAIL, lambda s: not s.endswith("-")),
    "CARD": (CARD, luhn),
    "ACCOUNT": (ACCOUNT, mod97),
    "ADDRESS": (ADDRESS, octets),
    "PHONE": (PHONE, lambda s: 10 <= sum(c.isdigit() for c in s) <= 15),
}


def candidates(text: str, kinds: dict = KINDS) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all that validators accept, kinds in order; spans of different kinds may overlap."""
    found = []
    for kind, (pattern, valid) in kinds.items():
        found += [(*m.span(1), kind) for m in re.finditer(pattern, text, re.ASCII) if valid(m[1])]
    return found


def resolve(spans: list[tuple[int, int, str]], kinds: dict = KINDS) -> list[tuple[int, int, str]]:
    """Spans without overlaps, in order: the first to begin, of those the longest, then the kind named first."""
    order, kept, end = list(kinds), [], 0
    for span in sorted(spans, key=lambda s: (s[0], -s[1], order.index(s[2]))):
        if span[0] >= end:
            kept.append(span)
            end = span[1]
    return kept


def mask(text: str | None) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with each span as [KIND], and the spans (code points of the original)."""
    if not text:
        return text, []
    spans, out, at = resolve(candidates(text)), [], 0
    for start, end, kind in spans:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]]), spans


def mask_texts(df: DataFrame, kept: list[str], text_col: str = "text") -> DataFrame:
    """`kept` columns, masked, and spans, an array of (start, length, kind); a null text stays null and has no spans.

    Rows that repeat are masked each; of the kept columns those named as the result's own are left out.
    """
    kept = [c for c in kept if c not in ("masked", "spans")]
    out = StructType([*(df.schema[c] for c in kept), *_parse_datatype_string("masked string, spans array<struct<start:int,length:int,kind:string>>").fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [mask(t.as_py()) for t in batch.column(len(kept))]
            spans = [[{"start": a, "length": b - a, "kind": k} for a, b, k in s] for _, s in done]
            own = [batch.column(k).cast(arrow.field(k).type) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*own, pa.array([m for m, _ in done], arrow.field(len(kept)).type), pa.array(spans, arrow.field(len(kept) + 1).type)], schema=arrow)

    return df.select(*kept, F.col(text_col).alias("__text")).mapInArrow(run, out)


_ALL = {k: "regexp_extract_all(text, '{}', 1)".format(p.replace("'", "''")) for k, (p, _) in KINDS.items()}
_DIGITS = "list_reverse(list_transform(regexp_extract_all(x, '[0-9]'), lambda c: cast(c as integer)))"
_LUHN = f"list_sum(list_transform({_DIGITS}, lambda d, i: case when i % 2 = 1 then d else d * 2 - case when d > 4 then 9 else 0 end end)) % 10 = 0"
_ENTROPY = "list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: -(length(x) - length(replace(x, c, ''))) / length(x) * log2((length(x) - length(replace(x, c, ''))) / length(x))))"
_VALID = {"SECRET": f"{_ENTROPY} >= {LEAST_ENTROPY}", "EMAIL": "not ends_with(x, '-')", "CARD": _LUHN, "ADDRESS": "list_max(list_transform(string_split(x, '.'), lambda p: cast(p as integer))) < 256", "PHONE": "true", "ACCOUNT": "false"}
_LISTS = ", ".join(f"list_filter({_ALL[k]}, lambda x: {_VALID[k]}) as {k.lower()}s" for k in KINDS)
_MASKED = "text"
for _k in KINDS:
    _MASKED = f"list_reduce([{_MASKED}] || {_k.lower()}s, lambda a, x: replace(a, x, '[{_k}]'))"


@query(f"""with c as (select doc_id, text, {_LISTS} from documents)
select doc_id, {", ".join(f"len({k.lower()}s) as n_{k.lower()}" for k in KINDS)}, sha256({_MASKED}) as masked_sha256 from c""")
def text_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans by kind, and a digest of the masked text. (Its SQL knows no account numbers; the tables have none.)"""
    done = mask_texts(table(spark, sf_dir, "documents"), ["doc_id"])
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind))
    counts = [of_kind(k).alias(f"n_{k.lower()}") for k in KINDS]
    return done.select("doc_id", *counts, F.sha2("masked", 256).alias("masked_sha256"))
