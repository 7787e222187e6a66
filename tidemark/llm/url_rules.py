"""URL filters: pattern rules indexed by their rarest literal token.

A rule is up to three regular expressions, for the host, the path and what follows it, a verdict, and the literal
tokens every url it fits must hold, which are read off the expressions. The index files each rule under whichever of
its tokens is rarest over the corpus; a url's tokens fetch the candidate rules, and only those run. Rules may come
from a table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep_only, ship

_TOKEN = re.compile(r"[a-z0-9]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: The most rules of a table: they are sent to every worker.
MOST_RULES = 100_000
#: In the sketch of a pattern: a place where a token ends, and one where anything may stand.
_EDGE, _ANY = "\n", "\0"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    tokens: tuple[str, ...]
    host: str = ""
    path: str = ""
    tail: str = ""
    length: int = 0  # of a site rule; a pattern rule has none and gives the verdict only where no site rule fits


def _sketch(nodes) -> str:
    """The characters that a parsed pattern demands in order, with _EDGE and _ANY between them."""
    out = []
    for kind, value in nodes:
        if kind is rc.LITERAL:
            out.append(chr(value))
        elif kind is rc.AT and value in (rc.AT_BEGINNING, rc.AT_BEGINNING_STRING, rc.AT_END, rc.AT_END_STRING):
            out.append(_EDGE)
        elif kind is rc.IN and all(k is rc.LITERAL and not _TOKEN.match(chr(v).translate(_UPPER)) for k, v in value):
            out.append(_EDGE)
        elif kind is rc.SUBPATTERN:
            out.append(_sketch(value[3]))
        elif kind is rc.BRANCH and all(s and all(not _TOKEN.match(c.translate(_UPPER)) and c != _ANY for c in s) for s in map(_sketch, value[1])):
            out.append(_EDGE)
        else:
            out.append(_ANY)
    return "".join(out)


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens that every text which the pattern fits from its start holds whole."""
    if not pattern:
        return ()
    parsed = rp.parse(pattern)
    found = re.findall(rf"(?<![a-z0-9{_ANY}])[a-z0-9]+(?![a-z0-9{_ANY}])", (_EDGE + _sketch(parsed) + _ANY).translate(_UPPER))
    if parsed.state.flags & re.IGNORECASE and not parsed.state.flags & re.ASCII:
        found = [t for t in found if not set(t) & set("isk")]  # these have other forms beyond ASCII
    return tuple(dict.fromkeys(found))


def pattern_rule(name: str, verdict: str, host: str = "", path: str = "", tail: str = "") -> Rule:
    return Rule(name, verdict, tuple(dict.fromkeys(t for p in (host, path, tail) for t in literal_tokens(p))), host, path, tail)


def read_rules(table: DataFrame) -> tuple[Rule, ...]:
    """The rules of a table (position, name, verdict, host, path, tail), in the order of position, then of all columns.

    A row whose host, path and tail are all null is a site rule that its name spells. More than MOST_RULES rows are
    refused: rules are sent to every worker.
    """
    columns = ["position", "name", "verdict", "host", "path", "tail"]
    rows = table.select(*columns).orderBy(*columns).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return tuple(site_rule(r.name, r.verdict) if r.host is None and r.path is None and r.tail is None else pattern_rule(r.name, r.verdict, r.host or "", r.path or "", r.tail or "") for r in rows)


def site_rule(name: str, verdict: str) -> Rule:
    """A host with its subdomains and a path prefix, such as example.net/en/."""
    host, slash, path = name.partition("/")
    # A token at the end of the prefix may go on in the url, so only whole ones count.
    whole = _TOKEN.findall(f"{slash}{path}".lower()) if path.endswith("/") else _TOKEN.findall(f"{slash}{path}".lower())[:-1]
    return Rule(name, verdict, tuple(dict.fromkeys([*_TOKEN.findall(host), *whole])), rf"(?:.*\.)?{re.escape(host)}\Z", re.escape(slash + path), length=len(name))


SITE_RULES = (site_rule("net/", "block"), site_rule("example.net/en/", "allow"), site_rule("example.com/de/", "block"), site_rule("org/fr/", "allow"))

#: The method's own rules, over host, path, and what follows the path. The first in this order decides.
PATTERN_RULES = (
    pattern_rule("tracking", "block", tail=r".*[?&]utm_[0-9A-Za-z_]+="),
    pattern_rule("referral", "block", tail=r".*[?&]ref="),
    pattern_rule("advert", "block", path=r".*/ads(?:/|\Z)"),
    pattern_rule("login", "block", path=r".*/login(?:/|\Z)"),
    pattern_rule("top", "allow", tail=r".*#top\Z"),
)
DEFAULT = "allow"


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z lower-cased), path, and the rest; three empty strings for null or a url without ://."""
    if not url or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, rest = rest[:cut].translate(_UPPER), rest[cut:]
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    return host, rest[:cut], rest[cut:]


class Index:
    def __init__(self, rules: tuple[Rule, ...], frequency: dict[str, int]) -> None:
        self.always: list[tuple[int, Rule, list]] = []
        self.by_token: dict[str, list[tuple[int, Rule, list]]] = {}
        for order, rule in enumerate(rules):
            tests = [(k, re.compile(p, re.S)) for k, p in enumerate((rule.host, rule.path, rule.tail)) if p]
            entry = (order, rule, tests)
            if rule.tokens:
                self.by_token.setdefault(min(rule.tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        parts = split_url(url)
        found = list(self.always)
        for token in set(_TOKEN.findall("\n".join(parts).translate(_UPPER))):
            found += self.by_token.get(token, ())
        fits = [(order, rule) for order, rule, tests in found if all(p.match(parts[k]) for k, p in tests)]
        site = max((r for _, r in fits if r.length), key=lambda r: r.length, default=None)
        if site:
            return parts[0], parts[1], site.name, site.verdict
        return parts[0], parts[1], None, min(((o, r.verdict) for o, r in fits if not r.length), default=(0, DEFAULT))[1]


def token_frequency(pages: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """Urls that hold each of the rules' tokens, over all rows; as many counts as the rules have tokens."""
    names = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_distinct(F.split(F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))), "[^a-z0-9]+"))
    if not names:
        return {}
    known = F.broadcast(pages.sparkSession.createDataFrame([(t,) for t in names], "token string"))
    counts = pages.select(F.explode(tokens).alias("token")).join(known, "token").groupBy("token").agg(F.count("*").alias("n"))
    return {r.token: r.n for r in counts.collect()}


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = (*SITE_RULES, *PATTERN_RULES)) -> DataFrame:
    """page_id, host, path, rule (a site rule or null), verdict of every row; no shuffle of rows.

    Of site rules the longest wins, of several as long the first; of pattern rules the first. Null and malformed urls
    have empty host and path, and the default verdict. Null and repeated ids stay as they are, other columns are
    ignored whatever their names, and an empty table gives no rows. Very long urls are judged as a whole.
    """
    ship(pages.sparkSession)
    rules = read_rules(rules) if isinstance(rules, DataFrame) else rules
    frequency = token_frequency(pages, rules)

    def run(batches):
        keep_only()
        index = Index(rules, frequency)
        for batch in batches:
            rows = [index.judge(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in zip(*rows))] if rows else [batch.column(0), *[pa.array([], pa.string())] * 4], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


URL_SQL = """
WITH a AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
b AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM b),
d AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(raw) + 1) AS rest FROM c),
e AS (SELECT page_id, host, regexp_extract(rest, '^[^?#]*') AS path, substr(rest, length(regexp_extract(rest, '^[^?#]*')) + 1) AS tail FROM d),
f AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM e)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(tail, '[?&]utm_[0-9A-Za-z_]+=') THEN 'block'
  WHEN regexp_matches(tail, '[?&]ref=') THEN 'block'
  WHEN regexp_matches(path, '/ads(/|$)') THEN 'block'
  WHEN regexp_matches(path, '/login(/|$)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM f
"""
