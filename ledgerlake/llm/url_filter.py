"""URL filters: given rules first, association rules mined from labels for the rest.

The tokens of a URL are its scheme, every label of its host, its domain and whole host, every path segment, the depth and file extension
of the path, every query parameter's name and whether it has a fragment. FP-growth mines combinations of tokens from labelled pages that no given
rule decides. Tokens too rare for any rule are left out first. Where a page has many of the rest, combinations grow with the power of their number, so
they are then mined level by level, without those that a part of theirs already settles. Combinations that imply the bad label with enough support,
confidence and lift and contain no smaller such combination become rules. An inverted index lists each rule under its rarest token; a URL looks up all its tokens
and then tests the whole of each rule found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

BAD = "=bad"
SALTS = 16
#: How much more often than any page a page that a rule fits must be bad; and tokens of a page up to which all their combinations are mined at once.
MIN_LIFT, BASKET = 1.5, 12


@dataclass(frozen=True)
class Rule:
    """``host`` with all its subdomains, below ``path``."""

    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def given(rules: list[Rule], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(str(r))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The sorted distinct tokens of a URL; none for a null one or one without ``://``."""
    h, p = host(url), path(url)
    labels = F.split(F.regexp_extract(h, r"([^@:]*)(:\d*)?$", 1), r"\.")
    segments = F.filter(F.split(p, "/"), lambda s: s != "")
    names = F.transform(F.split(F.regexp_extract(_rest(url), r"\?([^#]*)", 1), "&"), lambda s: F.split(s, "=")[0])
    last = F.try_element_at(segments, F.lit(-1))
    single = {
        "scheme": F.substring_index(url, "://", 1), "domain": F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")),
        "host": h, "depth": F.size(segments).cast("string"), "kind": F.nullif(F.regexp_extract(last, r"\.([A-Za-z0-9]+)$", 1), F.lit("")),
        "fragment": F.when(F.contains(url, F.lit("#")), F.lit("yes")),
    }
    many = {"label": labels, "segment": segments, "name": names}

    def named(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}="), x))

    kinds = [F.array(*[F.concat(F.lit(f"{k}="), v) for k, v in single.items()]), *[named(k, v) for k, v in many.items()]]
    found = F.array_sort(F.array_distinct(F.array_compact(F.concat(*kinds))))
    return F.when(_rest(url).isNull(), F.array().cast("array<string>")).otherwise(found)


def _by_levels(baskets: DataFrame, n: int, need: Column, is_rule: Column) -> DataFrame:
    """The smallest rules (items, confidence) from ``baskets`` (items, bad) of any length, by combinations of one more token at a time.

    A combination goes on if ``need`` bad pages have it, if it is no rule, and if fewer pages have it than have any of its parts: else that part
    stands for the same pages, and for the same rules. All parts of one that goes on do so too, so none is missed.
    """
    groups = baskets.groupBy("items").agg(F.count(F.lit(1)).alias("pages"), F.count_if("bad").alias("hits"))
    groups = cut(groups.withColumn("basket", F.monotonically_increasing_id()))
    met = groups.select("basket", "pages", "hits", F.explode("items").alias("token")).select("basket", "pages", "hits", F.array("token").alias("set"))
    rules, live, size = None, None, 1
    while True:
        sets = cut(met.groupBy("set").agg(F.sum("pages").alias("pages"), F.sum("hits").alias("hits")).where(F.col("hits") >= need))
        if live is not None:
            parts = sets.select("set", F.posexplode("set").alias("_at", "_token")).select(
                "set", F.expr("filter(set, (x, i) -> i <> _at)").alias("part"))
            known = parts.join(live.select(F.col("set").alias("part"), F.col("pages").alias("_of")), "part")
            least = known.groupBy("set").agg(F.count(F.lit(1)).alias("_known"), F.min("_of").alias("_of")).where(F.col("_known") == size)
            sets = cut(sets.join(least, "set").where("pages < _of").select("set", "pages", "hits"))
        found = sets.where(is_rule).select(F.col("set").alias("items"), (F.col("hits") / F.col("pages")).alias("confidence"))
        rules = found if rules is None else rules.unionByName(found)
        live = sets.where(~is_rule & (F.col("pages") < n))
        if live.isEmpty():
            return cut(rules)
        ends = met.join(live.select("set"), "set", "left_semi").select(
            "basket", "pages", "hits", F.slice("set", 1, size - 1).alias("start"), F.element_at("set", size).alias("last"))
        more = ends.select("basket", "start", F.col("last").alias("_next"))
        longer = ends.join(more, ["basket", "start"]).where("last < _next")
        met = cut(longer.select("basket", "pages", "hits", F.concat("start", F.array("last", "_next")).alias("set")))
        size += 1


def mine(
    labelled: DataFrame, min_support: float, min_confidence: float, min_pages: int, min_lift: float = MIN_LIFT, basket: int | None = None
) -> DataFrame:
    """(items, confidence) from rows (tokens, bad): the smallest token combinations that imply the bad label.

    All of them, whatever the number of tokens of a page; with ``basket`` only those of the so many most telling tokens of each page.
    """
    rows = cut(labelled.where(F.size("tokens") > 0).select("tokens", "bad", F.monotonically_increasing_id().alias("row")))
    n, bad = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if n < min_pages:
        return rows.where(F.lit(False)).select(F.col("tokens").alias("items"), F.lit(0.0).alias("confidence"))
    support = max(min_support, min_pages / n)
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    uses = each.groupBy("token").agg(F.count_if("bad").alias("hits"), (F.count_if("bad") / F.count(F.lit(1))).alias("rate"))
    # A rule and each of its tokens hold on so many bad pages. A page counts for each of its tokens, so there are at most
    # tokens per page / support such tokens, whatever the number of pages.
    often = uses.where(F.col("hits") >= F.ceil(F.lit(support * n) - F.lit(1e-9))).select("token", "rate")
    telling = F.array_sort(F.collect_list(F.struct((-F.col("rate")).alias("rate"), "token")))
    taken = F.array_sort(F.collect_set("token")) if basket is None else F.slice(telling, 1, basket)["token"]
    chosen = cut(each.join(F.broadcast(often), "token").groupBy("row", "bad").agg(taken.alias("items")))
    # Pages without such a token count among all pages, so supports are taken over these.
    m, longest = chosen.agg(F.count(F.lit(1)), F.max(F.size("items"))).first()
    if not m:
        return rows.where(F.lit(False)).select(F.col("tokens").alias("items"), F.lit(0.0).alias("confidence"))
    if basket is None and longest > BASKET:
        rate = F.col("hits") / F.col("pages")
        return _by_levels(chosen, n, F.ceil(F.lit(support * n) - F.lit(1e-9)), (rate >= min_confidence) & (rate * n >= min_lift * bad))
    baskets = chosen.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support * n / m), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("confidence") * n >= min_lift * bad))
    found = cut(found.select(F.array_sort("antecedent").alias("items"), "confidence"))
    # A rule that contains a smaller one adds nothing; all smaller parts of a rule are looked up.
    parts = found.withColumn("_mask", F.explode(F.expr("sequence(1, cast(pow(2, size(items)) as int) - 2)")))
    parts = parts.where(F.size("items") > 1).select("items", F.expr("filter(items, (x, i) -> shiftright(_mask, i) % 2 = 1)").alias("_part"))
    larger = parts.join(found.select(F.col("items").alias("_part")), "_part", "left_semi").select("items").distinct()
    return found.join(larger, "items", "left_anti")


def blocked(combinations: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows (tokens) that a rule fits, with the rule of highest confidence, by an inverted index over rarest tokens."""
    posted = rules.withColumn("token", F.explode("items"))
    uses = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = posted.join(uses, "token").groupBy("items", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    looked_up = combinations.withColumn("salt", F.pmod(F.xxhash64("tokens"), F.lit(SALTS)).cast("int")).withColumn("token", F.explode("tokens"))
    met = looked_up.join(index, ["token", "salt"]).where(F.size(F.array_except("items", "tokens")) == 0)
    return met.groupBy("tokens").agg(
        F.max_by(F.array_join("items", " "), F.struct("confidence", F.array_join("items", " "))).alias("mined"),
        F.max("confidence").alias("confidence"),
    )


def judged(
    pages: DataFrame, labels: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
    min_support: float = 0.002, min_confidence: float = 0.6, min_pages: int = 10,
) -> DataFrame:
    """page_id, host, path, rule, verdict, mined: one row per row of ``pages``.

    ``labels`` (id, bad) marks pages by id; an id with several labels is bad if one of them is, and null labels say nothing. Null urls and
    urls without ``://`` have an empty host and path and are allowed. ``mined`` is the token combination that blocked a url
    no given rule fits; it must hold on ``min_support`` of the labelled urls that no given rule fits, on ``min_pages`` of them at least, all bad ones,
    and be bad with ``min_confidence`` and ``MIN_LIFT`` times as often as all of these. Without labels nothing is mined. Other columns are not read. An empty table gives an empty result.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens"))
    rows = cut(rows.withColumn("given", given(rules, F.col("host"), F.col("path"))))
    marks = labels.where("id is not null and bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    labelled = rows.where("given is null").join(marks, rows["page_id"] == marks["id"]).select("tokens", "bad")
    found = cut(mine(labelled, min_support, min_confidence, min_pages))
    combinations = rows.where("given is null and size(tokens) > 0").select("tokens").distinct()
    stopped = cut(blocked(combinations, found)).select(F.col("tokens").alias("_tokens"), "mined", "confidence")
    stopped = stopped.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")
    # The tokens of one url may be those of a third of all rows.
    met = rows.withColumn("_salt", salt).withColumnRenamed("tokens", "_tokens").join(stopped, ["_tokens", "_salt"], "left")
    by_method = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return met.select(
        "page_id", "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce(F.col("given.verdict"), by_method).alias("verdict"), F.when(F.col("given").isNull(), F.col("mined")).alias("mined"),
    )
