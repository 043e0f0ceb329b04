"""URL filters: pattern rules, each indexed by its rarest literal token. DataFrame functions only.

A URL's tokens look up the rules indexed under them, and only those candidates run their regular expression.
Rules without a literal token that a URL must hold as a whole are looked up under the empty token, which every
URL has. Work is done once per distinct URL. Rules are tables: their regular expressions and tokens are made by
functions, and their number is checked before they are broadcast.

Two kinds of rules:

* host/path rules, host and the beginning of a path, such as example.org/en/1: a rule fits its host and all
  its subdomains. Paths are compared as they are written.
* patterns on host and path, without regard to the case of A to Z, in the usual syntax of filter lists: * is any run of
  characters, ^ a separator (no letter, digit, _ . % or -) or the end, a leading || the beginning of a host or of
  one of its domains, a leading or trailing | the beginning or the end; anything else stands for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Host/path rules: (verdict, rule).
HOST_PATH_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Patterns that block where no host/path rule fits.
PATTERN_RULES = ["||ads-track", "||casino-win", "spam-farm.*", "||*adult-x^", "cheap-pills.example.com/", "|free-bets*", "/doubleclick/*/ad^", "*--*-.", "^banner^*.gif|"]
#: More rules than this are not broadcast; a token's URLs are then dealt to so many copies of its rules.
MAX_BROADCAST_RULES, SALTS = 100_000, 64
TOKEN = "[a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From behind the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def literal(text: Column) -> Column:
    """A regular expression for the text itself: ASCII signs get a backslash."""
    return F.regexp_replace(text, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", r"\\$1")


def whole_tokens(marked: Column) -> Column:
    """Tokens that a matching URL holds as a whole: no * and no other token character beside them."""
    return F.array_distinct(F.regexp_extract_all(lower(marked), F.lit(f"(?<![a-z0-9*])({TOKEN})(?![a-z0-9*])"), F.lit(1)))


def listed(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A table of string literals."""
    if not rows:
        return spark.range(0).select(*[F.lit("").alias(c) for c in columns])
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row, strict=True)]) for row in rows])))


def host_path_rules(rules: DataFrame) -> DataFrame:
    """Compiled rules (verdict, rule): rule, verdict, weight, exact, regex, tokens. A rule without / is host/."""
    host = lower(F.substring_index("rule", "/", 1))
    path = F.substring(F.col("rule"), F.length(F.substring_index("rule", "/", 1)) + 2, F.length("rule"))
    regex = F.concat(F.lit(r"(?s)^([^/]*\.)?"), literal(host), F.lit("/"), literal(path))
    # the last token of the path may be the beginning of a longer one
    tokens = whole_tokens(F.concat(F.lit("|"), host, F.lit("/"), path, F.lit("*")))
    return rules.select("rule", "verdict", (F.length("rule") + 1).alias("weight"), F.lit(True).alias("exact"), regex.alias("regex"), tokens.alias("tokens"))


def pattern_rules(patterns: DataFrame) -> DataFrame:
    """Compiled patterns (pattern), which give no rule and weigh least."""
    p = lower(F.col("pattern"))
    front = F.when(p.startswith("||"), 2).when(p.startswith("|"), 1).otherwise(0)
    back = F.when(p.endswith("|") & (F.length(p) > front), 1).otherwise(0)
    core = F.substring(p, front + 1, F.length(p) - front - back)
    signs = F.regexp_replace(core, r"([\x00-\x29\x2B-\x2F\x3A-\x40\x5B-\x5D\x5F\x60\x7B-\x7F])", r"\\$1")
    body = F.replace(F.replace(signs, F.lit("^"), F.lit("([^a-z0-9_.%-]|$)")), F.lit("*"), F.lit(".*"))
    regex = F.concat(F.lit("(?s)"), F.when(front == 2, r"^([^/]*\.)?").when(front == 1, "^").otherwise(""), body, F.when(back == 1, "$").otherwise(""))
    tokens = whole_tokens(F.concat(F.when(front > 0, "|").otherwise("*"), core, F.when(back > 0, "|").otherwise("*")))
    return patterns.where("pattern is not null").select(F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(0).alias("weight"), F.lit(False).alias("exact"), regex.alias("regex"), tokens.alias("tokens"))


def filter_urls(pages: DataFrame, host_path: DataFrame, patterns: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every page with host, path, the longest host/path rule that fits (or null) and the verdict.

    host_path has columns verdict and rule, patterns the column pattern. Where no host/path rule fits, a pattern
    blocks and anything else is allowed; of one rule given with two verdicts, block counts. Null URLs and URLs
    without :// have an empty host and path and are allowed. Null and repeated ids and repeated rows are kept; an
    empty table gives an empty result, and without rules all is allowed; other columns are not read.
    """
    base = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    targets = base.select(F.concat("host", "path").alias("target")).where("target <> ''").distinct()
    own = F.array_distinct(F.regexp_extract_all(lower(F.col("target")), F.lit(f"({TOKEN})"), F.lit(1)))
    tokens = targets.select("target", F.explode(F.concat(F.array(F.lit("")), own)).alias("token"))
    rules = host_path_rules(host_path).unionByName(pattern_rules(patterns))
    few = rules.count() <= MAX_BROADCAST_RULES
    index = rule_index(rules, tokens, few)
    fits = F.when(F.col("exact"), F.expr("rlike(target, regex)")).otherwise(F.rlike(lower(F.col("target")), F.col("regex")))
    if few:
        hits = tokens.join(F.broadcast(index), "token").where(fits)
    else:  # a token may be in every URL, so its URLs are dealt to SALTS copies of its rules
        dealt = tokens.withColumn("salt", F.pmod(F.xxhash64("target"), F.lit(SALTS)))
        hits = dealt.join(index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["token", "salt"]).where(fits)
    best = hits.groupBy("target").agg(F.max(F.struct("weight", "rule", "verdict")).alias("best"))
    judged = base.join(best, F.concat("host", "path") == best["target"], "left")
    return judged.select(F.col(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def rule_index(rules: DataFrame, tokens: DataFrame, few: bool) -> DataFrame:
    """Rules with the one of their tokens that the fewest URLs hold (ties: the first in order); the empty one without any."""
    wanted = rules.select("exact", "regex", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token")).distinct()
    names = wanted.select("token").distinct()
    if few:  # only the rules' own tokens are counted
        counts = tokens.join(F.broadcast(names), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(names, "token")
    rarest = wanted.join(counts, "token", "left").groupBy("exact", "regex").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rare"))
    return rules.drop("tokens").join(rarest, ["exact", "regex"]).select("rule", "verdict", "weight", "exact", "regex", F.col("rare.token").alias("token"))


ORACLE = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN '' ELSE translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN '' ELSE regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) END AS path
  FROM pages
), r(rule, verdict, rhost, rpath) AS (VALUES
  ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
  ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')
), x(pattern) AS (VALUES
  ('^([^/]*\.)?ads-track'), ('^([^/]*\.)?casino-win'), ('spam-farm\..*'), ('^([^/]*\.)?.*adult-x([^a-z0-9_.%-]|$)'), ('cheap-pills\.example\.com/'), ('^free-bets.*'),
  ('/doubleclick/.*/ad([^a-z0-9_.%-]|$)'), ('.*--.*-\.'), ('([^a-z0-9_.%-]|$)banner([^a-z0-9_.%-]|$).*\.gif$')
), j AS (
  SELECT p.*, (SELECT arg_max(struct_pack(a := r.rule, b := r.verdict), length(r.rule)) FROM r
    WHERE (p.host = r.rhost OR suffix(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)) AS best,
    (SELECT bool_or(regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?s)' || pattern)) FROM x) AS hit
  FROM p
)
SELECT page_id, host, path, best.a AS rule, CASE WHEN best IS NOT NULL THEN best.b WHEN hit THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""
