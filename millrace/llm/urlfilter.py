r"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression, plus the literal tokens (runs of letters and digits) that any URL it matches must hold
as whole tokens. How often each such token occurs is counted over all URLs; a rule is filed under its rarest one. A
URL's tokens fetch the rules filed under them, and only those rules run their expression. An alternation is a rule for each
of its words. A rule without a token could be filed nowhere and is refused.

Host rules (`example.org/es/`: that host and its subdomains, and paths that start with the rule's) become such patterns
over host and path. The longest host rule that fits decides; without one the first pattern rule that matches does
(block before allow); without one the URL is allowed.

The host is what stands after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; the path goes on
from there to `?`, `#` or the end. Nulls and edges: a null URL or one without `://` has an empty host and path, fits no
rule and is allowed; other rows are judged by themselves, so repeats repeat and an empty table gives an empty result.
Rules are a parameter held in memory; the table may be of any size and skew, as rows are never grouped by host.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts

_TOKEN = re.compile(r"[a-z0-9]+")
_ASCII_LOWER = str.maketrans({c: chr(ord(c) + 32) for c in map(chr, range(65, 91))})


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    pattern: str  # searched in host + path, or in the lower-cased URL where name is null
    tokens: tuple[str, ...]  # whole tokens, lower-cased, of whatever it matches
    name: str | None = None  # a host rule's text, reported where it decides


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """The rule for a host, its subdomains, and the paths that start with `path` (which starts with a slash)."""
    # The last token of the path may go on in the URL, unless the rule ends it.
    tokens = _TOKEN.findall(host.lower()) + [m[0].lower() for m in re.finditer(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path) if m[0].isascii()]
    return Rule(verdict, rf"^(?:[^/]*\.)?{re.escape(host)}(?={re.escape(path)})", tuple(tokens), host + path)


def pattern_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    return Rule(verdict, pattern, tuple(t.lower() for t in tokens))


def split_url(url: str | None) -> tuple[str, str]:
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_ASCII_LOWER), slash + path


def tokens_of(url: str) -> set[str]:
    return set(_TOKEN.findall(url.translate(_ASCII_LOWER)))


def token_counts(df: DataFrame, url_col: str, tokens: list[str]) -> dict[str, int]:
    """How many rows hold each of the rules' tokens; one row for each token comes back."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(url_col), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))
    kept = df.select(F.explode(F.array_intersect(found, F.array(*map(F.lit, tokens)))).alias("token"))
    return {r["token"]: r["count"] for r in kept.groupBy("token").count().collect()}


def index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token (ties to the longer, then the first in order)."""
    filed: dict[str, list[Rule]] = {}
    for rule in rules:
        if not rule.tokens:
            raise ValueError(f"a rule without a literal token: {rule.pattern}")
        filed.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(rule)
    return filed


def judge(url: str | None, filed: dict[str, list[Rule]], compiled: dict[str, re.Pattern]) -> tuple[str, str, str | None, str]:
    """(host, path, rule, verdict) of one URL."""
    host, path = split_url(url)
    candidates = [r for t in tokens_of(url or "") if t in filed for r in filed[t]]
    best, verdicts = None, set()
    place, whole = host + path, (url or "").translate(_ASCII_LOWER)
    for rule in candidates:
        if rule.name is None:
            if rule.verdict not in verdicts and compiled[rule.pattern].search(whole):
                verdicts.add(rule.verdict)
        elif (best is None or (len(rule.name), rule.name) > (len(best.name), best.name)) and host and compiled[rule.pattern].search(place):
            best = rule
    if best is not None:
        return host, path, best.name, best.verdict
    return host, path, None, "block" if "block" in verdicts else "allow"


def judge_urls(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """For each row: id, host, path, rule, verdict."""
    tokens = sorted({t for r in rules for t in r.tokens})
    filed = index(rules, token_counts(df, url_col, tokens) if tokens else {})
    patterns = sorted({r.pattern for r in rules})

    def rows(urls: list[str | None]) -> dict:
        compiled = {p: re.compile(p) for p in patterns}
        made = [judge(u, filed, compiled) for u in urls]
        return dict(zip(("host", "path", "rule", "verdict"), zip(*made, strict=True), strict=True)) if made else {k: [] for k in ("host", "path", "rule", "verdict")}

    return over_texts(df, [id_col], url_col, "host string, path string, rule string, verdict string", rows)


def each_of(verdict: str, pattern: str, *words: str) -> list[Rule]:
    """A rule for each word of an alternation, which stands as `{}` in the pattern: each is then filed under its own token."""
    return [pattern_rule(verdict, pattern.replace("{}", w), w) for w in words]


#: Advertising, tracking and session patterns of the kind that block lists carry; literal tokens name each.
DEFAULT_PATTERNS = [
    *each_of("block", r"[./]{}[./]", "ad", "ads"),
    pattern_rule("block", r"[/.]banners[/.]", "banners"),
    pattern_rule("block", r"[?&]utm_source=", "utm", "source"),
    pattern_rule("block", r"[?&]sessionid=", "sessionid"),
    *each_of("block", r"/{}(?:[/?#]|$)", "login", "signin"),
    pattern_rule("block", r"[/.]doubleclick\.", "doubleclick"),
    pattern_rule("block", r"/cgi-bin/", "cgi", "bin"),
    pattern_rule("block", r"[./-]casino[./-]", "casino"),
    *each_of("block", r"\.{}(?:[?#]|$)", "exe", "zip", "iso", "apk"),
    pattern_rule("block", r"[?&]replytocom=", "replytocom"),
]
