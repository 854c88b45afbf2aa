"""URL filtering: stated host-and-path rules, and association rules mined from labels.

URLs are cut into tokens (host labels, path segments, query keys). FP-growth finds the token
combinations that are frequent among labelled URLs. A combination of any size becomes a rule if enough
bad URLs hold it, if most of its URLs are bad, and if the share of bad ones is beyond that of all
labelled URLs even at the lower end of its (Wilson) confidence interval; a fixed share alone would
either need labels that are nearly all bad, or let chance make rules. A URL is blocked if it holds all
tokens of some rule: an inverted index from each rule's rarest token finds the rules that can apply.
A stated rule that fits a URL comes before the mined ones.

Only labelled URLs are mined, by all tokens that enough bad URLs hold: others can't be in a rule.
FP-growth lists combinations of every size, 2^n of frequent copies of a URL of n such tokens. Where
some URL has more than `max_items`, combinations are counted level by level instead, without those that
hold a rule already (it blocks what they would) and without those in which a token says nothing new (as
many URLs hold the rest alone, which then makes the same rule). Both ways block the same URLs.

What comes to the driver while mining is checked against MAX_SETS and fails beyond it; rules up to
RULES_BROADCAST are broadcast as an index, more are matched by a join on the rarest token.

Nulls and ties: a URL that is null or lacks `://` has an empty host and path, no tokens and no
rule; of stated rules of equal length the first in order of name wins; repeated rows are judged one by
one and repeated labels of an id count as bad if any is. An empty table gives no rows; no labels give no
mined rules.
"""

from __future__ import annotations

import math
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from hushgrain.llm.runtime import table

# The stated rules.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
#: Most rules that are broadcast (some 10 MB); most combinations of a level, or tokens, that come to the driver.
RULES_BROADCAST, MAX_SETS = 100_000, 1_000_000
BAD = "label=bad"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(h: Column, p: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        name, slash, rest = rule.partition("/")
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens: h:label, p:segment (digits as #), q:key."""
    query = F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1)
    some = lambda parts: F.filter(parts, lambda x: x != "")
    labels = F.transform(some(F.split(host(url), "\\.")), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(some(F.split(path(url), "/")), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    keys = F.transform(some(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.concat(labels, segments, keys))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad) of the pages that have labels: bad if of low quality or toxic."""
    bad = labels.groupBy("doc_id").agg(F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    return pages.select("page_id", tokens(F.col("url")).alias("tokens")).join(bad, F.col("page_id") == F.col("doc_id")).select("tokens", "bad")


def _accepted(n_bad: Column, n: Column, base: float, min_confidence: float, z: float) -> Column:
    """Whether the share n_bad / n is a rule's: min_confidence at least, and its lower bound at z
    standard deviations beyond the share of all."""
    p = n_bad / n
    lower = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return (p >= min_confidence) & (lower > base)


def mine(examples: DataFrame, min_support: float = 0.002, min_count: int = 20, min_confidence: float = 0.5, z: float = 3.29, max_items: int = 12) -> DataFrame:
    """examples: (tokens, bad). Returns rules (antecedent, support_count, confidence); support_count is
    of bad URLs."""
    from pyspark.ml.fpm import FPGrowth

    examples = table(examples, "examples")
    n, base = examples.agg(F.count("*"), F.coalesce(F.avg("bad"), F.lit(0.0))).first()
    if not n:
        return examples.sparkSession.createDataFrame([], "antecedent array<string>, support_count long, confidence double")
    count = max(min_count, math.ceil(min_support * n - 1e-9))
    seen = table(examples.where("bad = 1").select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= count), "tokens")
    useful = {r.token for r in _few(seen).toLocalIterator()}  # at most mean tokens / min_support of them

    @arrow_udf("array<string>")
    def items(lists: pa.Array) -> pa.Array:
        return pa.array([[t for t in x or [] if t in useful] for x in lists.to_pylist()], pa.list_(pa.string()))

    examples = table(examples.select(items("tokens").alias("tokens"), "bad"), "examples")
    if (examples.agg(F.max(F.size("tokens"))).first()[0] or 0) > max_items:
        counted = _counted(examples, useful, count, base, min_confidence, z)
    else:
        baskets = examples.select(F.concat("tokens", F.when(F.col("bad") == 1, F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=(count - 0.5) / n, minConfidence=min_confidence).fit(baskets)
        rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
        bad = F.round(F.col("support") * n).cast("long")
        counted = rules.select(F.array_sort("antecedent").alias("antecedent"), bad.alias("n_bad"), F.round(bad / F.col("confidence")).cast("long").alias("n"))
    kept = counted.where(_accepted(F.col("n_bad"), F.col("n"), base, min_confidence, z))
    return table(kept.select("antecedent", F.col("n_bad").alias("support_count"), (F.col("n_bad") / F.col("n")).alias("confidence")), "rules")


def _few(sets: DataFrame) -> DataFrame:
    """sets, a written table, if they are few enough for the driver."""
    if (n := sets.count()) > MAX_SETS:
        raise ValueError(f"{n} token combinations are frequent, at most {MAX_SETS} can be mined: a higher min_support")
    return sets


def _within(tree: dict, tokens: list[str], i: int = 0):
    """The numbers of the combinations in a prefix tree that tokens (sorted) hold."""
    if None in tree:
        yield tree[None]
    for k in range(i, len(tokens)):
        if (below := tree.get(tokens[k])) is not None:
            yield from _within(below, tokens, k + 1)


def _longer(level: dict[tuple, int]) -> list[tuple]:
    """Combinations one token longer, of which every part of the level's size is in the level."""
    by_start: dict[tuple, list[str]] = {}
    for x in sorted(level):
        by_start.setdefault(x[:-1], []).append(x[-1])
    made = ((*start, a, b) for start, ends in by_start.items() for i, a in enumerate(ends) for b in ends[i + 1 :])
    return [x for x in made if all(x[:i] + x[i + 1 :] in level for i in range(len(x)))]


def _counted(examples: DataFrame, useful: set[str], count: int, base: float, min_confidence: float, z: float) -> DataFrame:
    """(antecedent, n, n_bad) of the combinations that can be rules and hold no other rule, by exact
    counts, level by level."""
    spark, shape = examples.sparkSession, "antecedent array<string>, n long, n_bad long"
    level, wanted, found = {}, [(t,) for t in sorted(useful)], spark.createDataFrame([], shape)
    while wanted:
        if len(wanted) > MAX_SETS:
            raise ValueError(f"{len(wanted)} token combinations to count, at most {MAX_SETS} can be: a higher min_support")
        tree: dict = {}
        for i, x in enumerate(wanted):
            at = tree
            for t in x:
                at = at.setdefault(t, {})
            at[None] = i
        shared = spark.sparkContext.broadcast(tree)

        def run(batches, shared=shared, size=len(wanted)):
            n, bad = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for batch in batches:
                for x, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = list(_within(shared.value, sorted(x)))
                    n[own] += 1
                    bad[own] += b == 1
            at = np.flatnonzero(n)
            yield pa.record_batch({"i": at, "n": n[at], "n_bad": bad[at]})

        summed = examples.mapInArrow(run, "i long, n long, n_bad long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))
        summed = table(summed.where(F.col("n_bad") >= count).withColumn("rule", _accepted(F.col("n_bad"), F.col("n"), base, min_confidence, z)), "counted")
        rows = [(wanted[r.i], r.n, r.n_bad, r.rule) for r in _few(summed).toLocalIterator()]
        rules = [r[:3] for r in rows if r[3]]
        if rules:
            found = found.unionByName(spark.createDataFrame([(list(x), n, b) for x, n, b in rules], shape))
        says_more = lambda x, n: len(x) == 1 or all(level[x[:i] + x[i + 1 :]] > n for i in range(len(x)))  # noqa: B023, E731
        level = {x: n for x, n, _, rule in rows if not rule and says_more(x, n)}
        wanted = _longer(level)
    return table(found, "rules")


def without_redundant(rules: list) -> list:
    """Rules of which no proper part is a rule of at least the same confidence. The verdict is the
    same with and without them; the index is smaller."""
    from itertools import combinations

    known = {tuple(r.antecedent): r.confidence for r in rules}
    parts = lambda x: (c for k in range(1, len(x)) for c in combinations(x, k))
    return [r for r in rules if not any(known.get(p, -1.0) >= r.confidence for p in parts(tuple(r.antecedent)))]


class InvertedIndex:
    """Finds the first of some rules whose tokens a URL holds."""

    def __init__(self, rules: list[tuple[str, ...]]):
        uses = Counter(t for r in rules for t in r)
        self.by_token: dict[str, list[frozenset]] = {}
        for r in rules:
            self.by_token.setdefault(min(r, key=lambda t: (uses[t], t)), []).append(frozenset(r))

    def matches(self, found: list[str]) -> bool:
        own = set(found)
        return any(rule <= own for t in own for rule in self.by_token.get(t, ()))


def with_mined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (with `tokens`), and whether some mined rule fits each: mined_bad."""
    if rules.count() > RULES_BROADCAST:
        return _joined(rows, rules)
    index = rows.sparkSession.sparkContext.broadcast(InvertedIndex([tuple(r.antecedent) for r in without_redundant(rules.collect())]))

    @arrow_udf("boolean")
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([index.value.matches(x or []) for x in lists.to_pylist()], pa.bool_())

    return rows.withColumn("mined_bad", run("tokens"))


def _joined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """with_mined for any number of rules: URLs meet the rules whose rarest token they hold."""
    rows = table(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    each = rules.select("antecedent", F.explode("antecedent").alias("_token"))
    uses = each.groupBy("_token").agg(F.count("*").alias("uses"))
    rarest = each.join(uses, "_token").groupBy("antecedent").agg(F.min(F.struct("uses", "_token")).getField("_token").alias("_token"))
    near = rows.select("_row", "tokens", F.explode("tokens").alias("_token")).join(rarest, "_token")
    hit = near.where(F.size(F.array_except("antecedent", "tokens")) == 0).select("_row").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, "_row", "left").withColumn("mined_bad", F.coalesce("_hit", F.lit(False))).drop("_row", "_hit")


def judge(pages: DataFrame, mined: DataFrame, rules: dict[str, str] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, mined_bad, verdict for each row of pages."""
    rules = RULES if rules is None else rules
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens"))
    rows = with_mined(rows.select("*", stated_rule(F.col("host"), F.col("path"), rules).alias("rule")), mined)
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    return rows.select("page_id", "host", "path", "rule", "mined_bad", F.coalesce(said, F.when(F.col("mined_bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
