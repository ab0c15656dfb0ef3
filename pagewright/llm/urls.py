"""Operator 2: URL filters whose pattern rules are indexed by their rarest literal token.

Every rule, a host with a path or a regular expression, names literal tokens
(runs of a-z and 0-9) that any URL it fits must contain. The rule is filed under
the one of its tokens that is rarest among the URLs at hand. A URL's tokens fetch
the rules filed under them, and only these run their regular expression.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
case. Path: from there up to ``?``, ``#`` or the end; what follows is the tail. Null or no ``://``: both
empty, and no rule fits. A host rule fits its host and all subdomains if the path
starts with the rule's path; the longest that fits wins. Where none fits, the
pattern rules decide: block if one of them fits, else allow.

Defined cases: repeated URLs and repeated rows each get their verdict; null ids
stay; other columns are ignored; an empty table gives an empty result. Very long URLs
are read whole. Ties of rules of equal length: the one that comes first.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import plain, quoted, table

#: (verdict, host/path)
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: (name, regular expression, tokens that every match contains)
PATTERN_RULES = (
    ("campaign", r"[?&]utm_(source|medium|campaign)=", ("utm",)),
    ("Java session", r"[?&;]jsessionid=", ("jsessionid",)),
    ("PHP session", r"[?&;]phpsessid=", ("phpsessid",)),
    ("login", r"/login(\.php)?([?#]|$)", ("login",)),
    ("sign in", r"/signin(\.php)?([?#]|$)", ("signin",)),
    ("print view", r"[?&]print=(1|true)(&|#|$)", ("print",)),
)
#: Up to so many rules go to every task; more are joined by a shuffle on the token.
BROADCAST_RULES = 20_000
TOKEN = "[a-z0-9]+"


def parts(url: str = "url"):
    """Columns host, path and tail of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path, tail = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"([?#][\s\S]*)$", 1)
    return tuple(F.coalesce(c, F.lit("")).alias(name) for c, name in ((host, "host"), (path, "path"), (tail, "tail")))


def rule_tokens(host: str, path: str) -> list[str]:
    """The tokens that every URL of a host rule contains: those of the host, and those that its path ends itself, as the URL's path may go on."""
    return re.findall(TOKEN, host) + re.findall(f"{TOKEN}(?=[^a-z0-9])", path.lower())


def rule_table(spark: SparkSession, host_rules: Sequence[tuple[str, str]], pattern_rules: Sequence[tuple[str, str, Sequence[str]]]) -> DataFrame:
    """rule_no, rule, verdict, weight, regex, tokens. A rule with alternatives that share no token has to be given as several; one without any token would run on every URL and is refused."""
    rows = []
    for verdict, rule in host_rules:
        host, slash, path = rule.partition("/")
        rows.append((rule, verdict, len(rule), rf"^([^/?#]*\.)?{re.escape(host)}{re.escape(slash + path)}", rule_tokens(host, slash + path)))
    for name, regex, tokens in pattern_rules:
        if not tokens:
            raise ValueError(f"rule {name}: no token that all its matches contain")
        rows.append((None, "block", 0, regex, list(tokens)))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rule_no long, rule string, verdict string, weight int, regex string, tokens array<string>")


def index_rules(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule with the rarest of its tokens; of equally rare ones the first in order."""
    named = rules.select("rule_no", F.explode("tokens").alias("token")).distinct()
    counts = tokens.join(F.broadcast(named.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = named.join(counts, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("t"))
    return rules.join(rarest, "rule_no", "left").select("rule_no", "rule", "verdict", "weight", "regex", F.col("t.token").alias("token"))


def judge(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``."""
    spark = pages.sparkSession
    pages = plain(pages, "page_id", "url").select("page_id", "url", *parts())
    # Rules see one canonical string: host and path as above, then the rest of the URL.
    subject = F.concat("host", "path", "tail")
    urls = pages.filter("host != '' or path != ''").select("url", subject.alias("subject")).distinct()
    tokens = urls.select("url", "subject", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("subject"), F.lit(f"({TOKEN})"), F.lit(1)))).alias("token"))
    rules = rule_table(spark, host_rules, pattern_rules)
    index = index_rules(rules, tokens.select("token"))
    if len(host_rules) + len(pattern_rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    fits = tokens.join(index, "token").filter(F.expr("subject rlike regex"))
    best = fits.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.struct("weight", (-F.col("rule_no")).alias("first"))).alias("best"))
    same = pages["url"] == best["url"]
    return pages.join(best, same, "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def oracle() -> str:
    """The same by one CASE: the host rules from the longest on, then the patterns."""
    lines = []
    for verdict, rule in sorted(HOST_RULES, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits = f"(host = {quoted([host])} OR ends_with(host, {quoted(['.' + host])})) AND starts_with(path, {quoted([slash + path])})"
        lines.append((fits, rule, verdict))
    rule = " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in lines)
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in lines)
    patterns = " OR ".join(f"regexp_matches(host || path || tail, {quoted([p])})" for _, p, _ in PATTERN_RULES)
    return rf"""
WITH cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
named AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '([?#].*)$', 1), '') AS tail FROM cut)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN (host <> '' OR path <> '') AND ({patterns}) THEN 'block' ELSE 'allow' END AS verdict FROM named"""
