"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names the literal tokens that each URL it fits must contain. Spark counts those tokens
over all URLs, the rule is filed under its rarest one, and a URL's own tokens fetch the few rules
that may fit; only those run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import map_text
from millrace.llm.registry import query, table

MAX_RULES = 200_000
"""Rules sent to every task at once; of a longer list each part passes over the URLs in turn."""

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """`pattern` is searched in `host + path` if `on_place`, else in the whole lower-case URL.
    `literals` are tokens every match contains. Listed rules win over patterns, longer
    `name`s over shorter ones."""

    name: str
    pattern: str
    verdict: str
    literals: tuple[str, ...]
    listed: bool = False


def listed_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with all its subdomains and a path prefix."""
    name = host + path
    tokens = tuple(re.findall(TOKEN, host.lower()))
    # The last token of a path prefix may go on in the URL, unless the prefix ends it.
    inner = re.findall(TOKEN, re.sub(r"[A-Za-z0-9]+$", "", path).lower())
    return Rule(name, rf"^([^/]*\.)?{re.escape(name)}", verdict, (*tokens, *inner), True)


def token_rule(tokens: str, verdict: str = "block") -> Rule:
    """A rule for a run of whole tokens with any separators between, such as `cheap pills`."""
    words = tokens.split()
    body = "[^a-z0-9]+".join(words)
    return Rule(tokens, rf"(^|[^a-z0-9]){body}([^a-z0-9]|$)", verdict, tuple(words))


LISTED = [
    listed_rule("net", "/", "block"),
    listed_rule("example.net", "/en/", "allow"),
    listed_rule("example.com", "/de/", "block"),
    listed_rule("org", "/fr/", "allow"),
]

# Topics that web corpora usually leave out, and pages without prose.
PATTERNS = [
    token_rule(t)
    for t in (
        "casino", "casino win", "free bets", "bets", "betting", "poker", "slots", "jackpot",
        "cheap pills", "pills", "viagra", "cialis", "pharmacy online", "payday loan",
        "loans fast", "ads", "ads track", "adserver", "doubleclick", "tracker", "popunder",
        "porn", "xxx", "sex cam", "adult video", "escort", "warez", "torrent", "keygen",
        "crack download", "replica watches", "malware", "phishing", "login", "signin", "logout",
        "cart checkout", "wp admin",
    )
] + [
    Rule("file", r"\.(zip|exe|iso|dmg|apk|rar|mp4|mp3)([?#]|$)", "block", ()),
]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for NULL or without `://`."""
    if url is None:
        return "", ""
    head, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def token_counts(df: DataFrame, url: str, rules: list[Rule]) -> dict[str, int]:
    """In how many URLs the tokens of the rules occur; at most one row per rule token returns."""
    spark = df.sparkSession
    wanted = sorted({t for r in rules for t in r.literals})
    names = spark.createDataFrame([(t,) for t in wanted], "token string")
    tokens = df.select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit(f"({TOKEN})")))).alias("token")
    )
    counted = tokens.join(F.broadcast(names), "token", "left_semi").groupBy("token").count()
    return {r[0]: r[1] for r in counted.collect()}


def rule_index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict, list]:
    """Rules by their rarest literal token, and the rules that have no literal."""
    by_token: dict[str, list[Rule]] = {}
    free = []
    for rule in rules:
        if rule.literals:
            rarest = min(rule.literals, key=lambda t: (counts.get(t, 0), t))
            by_token.setdefault(rarest, []).append(rule)
        else:
            free.append(rule)
    return by_token, free


def judge_urls(
    df: DataFrame, row_id: str, url: str, rules: list[Rule], default: str = "allow"
) -> DataFrame:
    """One row per row of `df`: `row_id`, `host`, `path`, `rule`, `verdict`, `pattern`,
    `candidates` (rules whose regular expression ran).

    The longest fitting listed rule decides and is named in `rule`; else the longest fitting
    pattern, named in `pattern`, gives the verdict; else `default`. Ties go to the smaller name.
    NULL, empty and malformed URLs have empty host and path and get the patterns' verdict on the
    raw text (NULL: `default`). Repeated rows are judged each; an empty table gives no rows. Long URLs
    are judged whole, and other columns of any name change nothing. Without rules all get `default`.
    """
    kind = df.schema[row_id].dataType
    held = T.StructType(
        [
            T.StructField("_row", kind),
            T.StructField("_url", T.StringType()),
            T.StructField("_listed", T.BooleanType()),
            T.StructField("_name", T.StringType()),
            T.StructField("_verdict", T.StringType()),
            T.StructField("candidates", T.IntegerType()),
        ]
    )
    # The URL goes along as it is; a row keeps the best rule of the parts before.
    best = df.select(
        F.col(row_id).alias("_row"),
        F.col(url).alias("_url"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in held.fields[2:5]],
        F.lit(0).alias("candidates"),
    )
    for start in range(0, max(1, len(rules)), MAX_RULES):
        part = rules[start : start + MAX_RULES]
        best = _best_of(best, held, *rule_index(part, token_counts(df, url, part)))
    schema = T.StructType(
        [
            T.StructField(row_id, kind),
            *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict", "pattern")],
            T.StructField("candidates", T.IntegerType()),
        ]
    )

    def make():
        def run(piece):
            places = [split_url(x.decode("utf-8", "replace")) for x in piece["_url"]]
            named = list(zip(piece["_listed"], piece["_name"]))
            return {
                row_id: piece["_row"],
                "host": [p[0] for p in places],
                "path": [p[1] for p in places],
                "rule": [n if listed else None for listed, n in named],
                "verdict": [default if v is None else v for v in piece["_verdict"]],
                "pattern": [None if listed else n for listed, n in named],
                "candidates": piece["candidates"],
            }

        return run

    return map_text(best, ["_row", "_listed", "_name", "_verdict", "candidates"], "_url", schema, make)


def _best_of(urls: DataFrame, schema: T.StructType, by_token: dict, free: list) -> DataFrame:
    """`urls` with the best of each row's rule and the rules that fit it."""

    def order(listed, name):
        return listed, len(name), [-ord(c) for c in name]

    def make():
        compiled: dict[str, re.Pattern] = {}
        find = re.compile(TOKEN).findall

        def fits(rule, place, whole):
            regex = compiled.get(rule.pattern)
            if regex is None:
                regex = compiled[rule.pattern] = re.compile(rule.pattern)
            return regex.search(place if rule.listed else whole)

        def judge(raw, listed, name, verdict, count):
            url_text = raw.decode("utf-8", "replace")
            place, whole = "".join(split_url(url_text)), url_text.lower()
            candidates = [*free]
            for token in dict.fromkeys(find(whole)):
                candidates += by_token.get(token, ())
            top = None if name is None else order(listed, name)
            for rule in candidates:
                if fits(rule, place, whole):
                    own = order(rule.listed, rule.name)
                    if top is None or own > top:
                        top, listed, name, verdict = own, rule.listed, rule.name, rule.verdict
            return listed, name, verdict, count + len(candidates)

        def run(piece):
            rows = zip(*(piece[c] for c in ("_url", "_listed", "_name", "_verdict", "candidates")))
            made = [judge(*row) for row in rows]
            columns = [list(c) for c in zip(*made)] if made else [[]] * 4
            return {"_row": piece["_row"], "_url": [x.decode("utf-8", "replace") for x in piece["_url"]]} | dict(
                zip(schema.names[2:], columns)
            )

        return run

    return map_text(urls, ["_row", "_listed", "_name", "_verdict", "candidates"], "_url", schema, make)


def _values() -> str:
    rows = [
        (r.name, r.pattern, r.verdict, r.listed) for r in [*LISTED, *PATTERNS]
    ]
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quote(n)}, {quote(p)}, {quote(v)}, {str(b).lower()})" for n, p, v, b in rows)


OP2_SQL = f"""
WITH rules(name, pattern, verdict, listed) AS (VALUES {_values()}),
cut AS (
  SELECT page_id, lower(coalesce(url, '')) AS whole,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, whole, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), hits AS (
  SELECT page_id, whole, host, path, r.name, r.verdict, r.listed
  FROM parts LEFT JOIN rules r
    ON regexp_matches(CASE WHEN r.listed THEN host || path ELSE whole END, r.pattern)
), best AS (
  SELECT * FROM hits
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY listed DESC NULLS LAST, length(name) DESC, name) = 1
)
SELECT page_id, host, path, CASE WHEN listed THEN name END AS rule,
  coalesce(verdict, 'allow') AS verdict, CASE WHEN NOT listed THEN name END AS pattern
FROM best
"""


@query("op2_url_rules", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), "page_id", "url", [*LISTED, *PATTERNS]).drop("candidates")
