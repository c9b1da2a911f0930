"""URL filters by rules and by association rules mined from what the rules decide.

Listed rules decide the urls they fit. Those urls are the labelled transactions: FP-growth finds the
token combinations that are frequent among them, and combinations that imply one verdict with enough
confidence and support become rules for the other urls. The mined rules are matched by an inverted
index from token to rule, once for each distinct set of known tokens. Only DataFrame and SQL
functions run here.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm.common import durable

# The listed rules, in the order host/path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.9  # of the labelled urls
# Tokens of a url, in SQL that Spark and other engines read alike.
TOKENS = {
    "scheme": "regexp_extract(url, '^([A-Za-z]+)://', 1)",
    "tld": "regexp_extract(host, '([^.]*)$', 1)",
    "site": "regexp_extract(host, '([^.]*[.][^.]*)$', 1)",
    "first": "regexp_extract(host, '^([^.]*)', 1)",
    "dir": "regexp_extract(path, '^/([^/]*)/', 1)",
    "ext": "regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)",
    "key": "regexp_extract(url, '[?]([^=&#]*)', 1)",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
HOST = f"translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
PATH = "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)"


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"((host = '{host}' OR host LIKE '%.{host}') AND path LIKE '/{path}%')"


def _longest(of: dict[str, str]) -> str:
    """The value of the longest rule that fits, in SQL."""
    rules = sorted(of, key=lambda r: (-len(r), r))
    return "CASE " + " ".join(f"WHEN {_fits(r)} THEN '{of[r]}'" for r in rules) + " END"


RULE = _longest({r: r for r, _ in RULES})
GIVEN = _longest(dict(RULES))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule, given: null urls and urls without :// have an empty host and
    path, which no rule fits."""
    return (pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).withColumn("rest", F.expr(AFTER))
            .withColumn("host", F.expr(HOST)).withColumn("path", F.expr(PATH)).drop("rest")
            .withColumn("rule", F.expr(RULE)).withColumn("given", F.expr(GIVEN)))


def _tokens():
    each = [F.when(F.expr(e) != "", F.concat(F.lit(f"{k}="), F.expr(e))) for k, e in TOKENS.items()]
    return F.array_compact(F.array(*each))


def mined(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, verdict, confidence, n): rules from transactions `tokens` with a `given` verdict.
    Nothing labelled, no rules."""
    verdicts = ["verdict=allow", "verdict=block"]
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), F.col("given")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    return (model.associationRules.where(F.col("consequent")[0].isin(verdicts)
                                         & ~F.arrays_overlap("antecedent", F.array(*map(F.lit, verdicts))))
            .select(F.array_sort("antecedent").alias("antecedent"), F.expr("substr(consequent[0], 9)").alias("verdict"),
                    "confidence", "support"))


def fired(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(known, verdict) for the rows of `sets` (known: a sorted set of tokens) in which a rule fires:
    the most confident rule decides, then the better supported, then allow before block."""
    index = rules.select(F.explode("antecedent").alias("token"), F.size("antecedent").alias("of"),
                         F.array_join("antecedent", " ").alias("name"), "verdict", "confidence", "support")
    hits = (sets.select("known", F.explode("known").alias("token")).join(index, "token")
            .groupBy("known", "name", "verdict", "of", "confidence", "support").agg(F.count("*").alias("found"))
            .where(F.col("found") == F.col("of")))
    best = F.struct(F.col("confidence"), F.col("support"), (F.col("verdict") == "allow").alias("gentle"))
    return hits.groupBy("known").agg(F.max_by("verdict", best).alias("mined"))


def judged(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. The listed rule decides, else a mined
    one, else allow. Repeated rows are judged alike, null ids stay, an empty table gives no rows."""
    rows = durable(parsed(pages).withColumn("tokens", _tokens()), "urls")
    labelled = rows.where("given is not null").select("tokens", "given")
    answers = ["page_id", "host", "path", "rule"]
    if not labelled.take(1):
        return rows.select(*answers, F.lit("allow").alias("verdict"))
    rules = durable(mined(labelled), "rules")
    words = rules.select(F.explode("antecedent").alias("token")).distinct()
    # the tokens of rules are frequent, so they are few whatever the corpus: at most 7 / MIN_SUPPORT
    vocabulary = F.array(*[F.lit(r["token"]) for r in words.collect()]).cast("array<string>")
    open_rows = rows.where("given is null").withColumn("known", F.array_sort(F.array_intersect("tokens", vocabulary)))
    decided = fired(open_rows.select("known").distinct(), rules).withColumnRenamed("known", "_known")
    rest = (open_rows.join(decided, F.col("known") == F.col("_known"), "left")
            .select(*answers, F.coalesce("mined", F.lit("allow")).alias("verdict")))
    return rest.union(rows.where("given is not null").select(*answers, F.col("given").alias("verdict")))


_BARE = "\n    UNION ALL ".join(f"SELECT row, given, '{k}=' || {e} AS token FROM urls WHERE {e} <> ''" for k, e in TOKENS.items())
SQL = f"""
WITH parts AS (SELECT page_id, coalesce(url, '') AS url, row_number() OVER () AS row FROM pages),
rests AS (SELECT *, {AFTER} AS rest FROM parts),
hosts AS (SELECT page_id, row, url, {HOST} AS host, {PATH} AS path FROM rests),
urls AS (SELECT *, {RULE} AS rule, {GIVEN} AS given FROM hosts),
tokens AS ({_BARE}),
total AS (SELECT count(*) AS n FROM urls WHERE given IS NOT NULL),
sets AS (SELECT row, given, list(token ORDER BY token) AS t FROM tokens GROUP BY row, given),
kinds AS (SELECT t, unnest(list_transform(range(1, (1 << len(t))::BIGINT), lambda m: array_to_string(list_filter(t, lambda x, i: (m >> (i - 1)) & 1 = 1), ' '))) AS a
    FROM (SELECT DISTINCT t FROM sets)),
combinations AS (SELECT row, given, a FROM sets JOIN kinds USING (t)),
counted AS (
    SELECT a, count(*) AS n, count(*) FILTER (given = 'allow') AS allow, count(*) FILTER (given = 'block') AS block
    FROM combinations WHERE given IS NOT NULL GROUP BY a),
rules AS (
    SELECT a, v.verdict, v.k / counted.n AS confidence, v.k / total.n AS support
    FROM counted, total, LATERAL (SELECT unnest(['allow', 'block']) AS verdict, unnest([allow, block]) AS k) v
    WHERE v.k >= ceil({MIN_SUPPORT} * total.n) AND v.k > 0 AND v.k / counted.n >= {MIN_CONFIDENCE}),
hits AS (
    SELECT row, max_by(verdict, (confidence, support, verdict = 'allow')) AS mined
    FROM combinations c JOIN rules r USING (a) WHERE c.given IS NULL GROUP BY row)
SELECT page_id, host, path, rule, coalesce(given, mined, 'allow') AS verdict FROM urls LEFT JOIN hits USING (row)
"""
