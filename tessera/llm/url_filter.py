"""URL filter: pattern rules indexed by their rarest literal token.

Each rule is a host and a path prefix ("example.net/en/"); it fits its host
and every subdomain where the URL's path starts with the rule's path, and is
run as a regular expression. The literal tokens of a rule are its host labels
and the whole segments of its path. The rule is filed under the token that is
rarest in the given URLs, so that a URL's own tokens fetch few candidate rules
and only those run their expressions.

The index is a hash table: an array of buckets, a token's bucket being its hash
modulo their number. It is a constant of the plan, so looking a token up costs
the same at any number of rules, and everything is a row-local SQL expression
over the scan: no shuffle and no Python. Rule lists whose index is larger than
``index_bytes`` are joined instead: the tokens of the distinct URLs meet the
rules on the token, and the verdicts go back to the rows on host and path.

Rows: null URLs and URLs without ``://`` have an empty host and path and fit
no rule (verdict: the default). Repeated rows are judged alike; of rules that
fit equally well (same length, host length, verdict) the one with the larger
text is named; very long URLs have more tokens and are read whole; an empty
table gives an empty result, an empty rule list the default everywhere. Of the
other columns only ``keep`` passes; one called host, path, rule or verdict is
called ``<name>_kept`` in the result.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDEX_BYTES = 8 << 20
_SEPARATOR = "\u0001"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        def literal(text):
            return re.sub(r"([^A-Za-z0-9_\u0080-￿])", r"\\\1", text)

        return rf"(?s)^(?:.*\.)?{literal(self.host)}{_SEPARATOR}{literal(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that every URL fitting the rule has; '' (which all have) if there are none."""
        host = [f"h:{x}" for x in self.host.split(".") if x]
        whole = self.path.split("/")[:-1]
        return host + [f"p:{x}" for x in whole if x] or [""]


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(""))))


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """URLs that have each of the rules' tokens (one row per token of the rule list)."""
    known = urls.sparkSession.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    # As long as the rule list, which the driver holds.
    hits = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(known), "token")
    return {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}


_RULE = "struct<token:string,length:int,host_length:int,blocks:int,name:string,verdict:string,pattern:string>"


def filed(rules: list[Rule], seen: dict[str, int]) -> list[dict]:
    """The rules, each with the token it is filed under: the one that fewest URLs have."""
    out = []
    for rule in sorted(set(rules), key=lambda r: (r.name, r.verdict)):
        token = min(rule.tokens, key=lambda t: (seen.get(t, 0), t))
        out.append({"token": token, "length": len(rule.name), "host_length": len(rule.host),
                    "blocks": int(rule.verdict == "block"), "name": rule.name, "verdict": rule.verdict,
                    "pattern": rule.pattern})
    return out


def _fits(rule: Column) -> Column:
    return F.regexp_like(F.concat("host", F.lit(_SEPARATOR), "path"), rule["pattern"])


def _rank(rule: Column) -> Column:
    """Longest first; the name decides only exact ties."""
    return F.struct(*[rule[c].alias(c) for c in ("length", "host_length", "blocks", "name", "verdict")])


def _bucket(token: str, n: int) -> int:
    return zlib.crc32(token.encode()) % n


def looked_up(parsed: DataFrame, entries: list[dict]) -> DataFrame:
    """``parsed`` with ``best``, the index being a constant of the plan."""
    n = 1 << max(4, (2 * len(entries)).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for e in entries:
        buckets[_bucket(e["token"], n)].append(e)
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<array<{_RULE}>>")
    fetched = F.transform("tokens", lambda t: F.filter(
        F.get(index, (F.crc32(t) % n).cast("int")), lambda r: (r["token"] == t) & _fits(r)))
    return parsed.withColumn("best", F.array_max(F.transform(F.flatten(fetched), _rank)))


def joined_up(parsed: DataFrame, entries: list[dict]) -> DataFrame:
    """``parsed`` with ``best``, the rules being a table."""
    rules = parsed.sparkSession.createDataFrame([tuple(e.values()) for e in entries], _RULE[len("struct<"):-1])
    urls = parsed.select("host", "path", "tokens").dropDuplicates(["host", "path"])
    met = urls.withColumn("token", F.explode("tokens")).drop("tokens").join(rules.select("token", F.struct("*").alias("r")), "token")
    best = met.filter(_fits(F.col("r"))).groupBy("host", "path").agg(F.max(_rank(F.col("r"))).alias("best"))
    return parsed.join(best, ["host", "path"], "left")


def url_verdicts(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url",
                 keep: tuple[str, ...] = ("page_id",), index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``keep`` columns plus host, path, rule (or null) and verdict for every row.

    Of the fitting rules the longest wins; at equal length the longer host,
    then block before allow, then the larger text.
    """
    own = ("host", "path", "rule", "verdict")
    kept = [F.col(f"kept.{k}").alias(k + "_kept" * (k.lower() in own)) for k in keep]
    parsed = pages.select(F.struct(*[F.col(k) for k in keep]).alias("kept"), host_of(F.col(url)).alias("host"),
                          path_of(F.col(url)).alias("path"))
    parsed = parsed.withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    if not rules:
        return parsed.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"),
                             F.lit(default).alias("verdict"))
    entries = filed(rules, token_counts(parsed, rules))
    size = sum(len(e["token"]) + len(e["name"]) + len(e["pattern"]) + 100 for e in entries)
    judged = looked_up(parsed, entries) if size <= index_bytes else joined_up(parsed, entries)
    return judged.select(*kept, "host", "path", F.col("best.name").alias("rule"),
                         F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
