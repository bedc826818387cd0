"""URL filters: fixed host and path rules first, mined token rules for the rest.

FP-growth mines the token combinations of labelled URLs. Association rules that end in a label are
pruned by support, by certainty (how much of the way from the label's base rate to 1 their confidence
goes), by the chi-square of rule and label, and where dropping one token loses no confidence. Rules are
matched by an inverted index: each token lists the rules that have it, and a rule matches a URL once all
its tokens were met. All of it is DataFrame and SQL functions. Up to ``MAX_MINED`` rules are literals of
the plan, and URLs are judged row by row, without a shuffle; more are a table that is joined by each
rule's rarest token, with the same verdicts. Fixed rules beyond ``MAX_RULES`` are an error.

Defined results: a null URL, or one without ``://``, has empty host and path and no token, so the
default verdict; repeated rows are judged alike; of fixed rules of one length the one that sorts first
wins; of mined rules the one with the highest confidence, then support, then fewest tokens, then the one
that sorts first; columns of pages named host, path, rule, matched or verdict are replaced; null labels
and URLs teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

ALLOW, BLOCK = "allow", "block"
LABEL = "label="
MIN_SUPPORT, MIN_CERTAINTY = 0.002, 0.25
#: Least chi-square of a rule and its label (p < 0.001), and the confidence that FP-growth reports from.
MIN_CHI2, REPORTED_FROM = 10.83, 0.25
#: A mined rule rests on this many labelled URLs at least, however few there are in all.
MIN_URLS = 20
MAX_RULES, MAX_MINED = 10_000, 2_000


@dataclass(frozen=True)
class Rule:
    """verdict for a host, its subdomains, and paths that start with path; written host + path."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host, its domain and labels, words of the path, query keys, suffix."""
    host, path = host_of(url), path_of(url)
    kind = lambda name, parts: F.transform(parts, lambda p: F.concat(F.lit(name + ":"), p))
    labels = F.regexp_extract_all(host, F.lit("([a-z0-9]+)"), F.lit(1))
    words = F.regexp_extract_all(F.lower(path), F.lit("([a-z]+)"), F.lit(1))
    keys = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("(?:^|&)([^=&]+)"), F.lit(1))
    whole = F.when(host != "", F.array(F.concat(F.lit("host:"), host))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(whole, kind("label", labels), kind("path", words), kind("key", keys)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_certainty: float = MIN_CERTAINTY, min_chi2: float = MIN_CHI2) -> DataFrame:
    """Rules (antecedent array, verdict, confidence, support, lift) from url and bad (boolean)."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull()).select(tokens_of(F.col("url")).alias("t"), F.when(F.col("bad"), BLOCK).otherwise(ALLOW).alias("v"))
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("v") == BLOCK).cast("long")), F.lit(0))).first()
    if not n:
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double, lift double")
    # Every URL has these; they would only multiply the combinations.
    usual = [r["x"] for r in rows.select(F.explode("t").alias("x")).groupBy("x").count().where(F.col("count") == n).collect()]
    items = F.concat(F.array_except("t", F.array(*map(F.lit, usual)).cast("array<string>")), F.array(F.concat(F.lit(LABEL), "v")))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, MIN_URLS / n)), minConfidence=REPORTED_FROM).fit(rows.select(items.alias("items")))
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.element_at("consequent", 1), len(LABEL) + 1, 100).alias("verdict"), "confidence", "support", "lift")
    base = F.when(F.col("verdict") == BLOCK, F.lit(bad / n)).otherwise(F.lit(1 - bad / n))
    share = F.col("support") / F.col("confidence")  # of the URLs with the antecedent
    chi2 = n * share * F.pow(F.col("confidence") - base, 2) / (base * (1 - base) * (1 - share))
    rules = rules.where((base < 1) & (share < 1) & (F.col("confidence") > base)).where((F.col("confidence") - base >= min_certainty * (1 - base)) & (chi2 >= min_chi2)).persist()
    shorter = rules.select(F.col("antecedent").alias("less"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    own = rules.select("antecedent", "verdict", "confidence", F.explode(F.transform("antecedent", lambda t: F.array_remove("antecedent", t))).alias("less"))
    covered = own.join(shorter, (own["less"] == shorter["less"]) & (own["verdict"] == F.col("v")) & (F.col("c") >= own["confidence"])).select("antecedent", "verdict").distinct()
    return rules.join(covered, ["antecedent", "verdict"], "left_anti").select("antecedent", "verdict", "confidence", "support", "lift")


def judge(pages: DataFrame, fixed: list[Rule], mined: DataFrame, default: str = ALLOW, url_col: str = "url", max_mined: int = MAX_MINED) -> DataFrame:
    """pages with host, path, rule (the fixed rule's text, else null), matched (the mined rule) and verdict."""
    if len(fixed) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} fixed rules")
    top = mined.orderBy(F.col("confidence").desc(), F.col("support").desc(), F.size("antecedent"), F.concat_ws(" ", "antecedent")).limit(max_mined + 1).collect()
    url = F.col("__url")
    rows = pages.withColumn("__url", F.col(url_col))
    if len(top) > max_mined:
        rows = _joined_match(rows, mined)
    else:
        rows = rows.withColumn("__at", _first_match(url, [r["antecedent"] for r in top]))
        rows = rows.withColumns({"__mined": _element([r["verdict"] for r in top], F.col("__at")), "__matched": _element([" ".join(r["antecedent"]) for r in top], F.col("__at"))})
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url)})
    rows = rows.withColumns({"rule": _longest(fixed), "matched": F.col("__matched")})
    rows = rows.withColumn("verdict", F.coalesce(_looked_up(F.col("rule"), {r.text: r.verdict for r in fixed}), "__mined", F.lit(default)))
    return rows.drop("__url", "__at", "__mined", "__matched")


def _joined_match(rows: DataFrame, mined: DataFrame) -> DataFrame:
    """rows (with __url) with the verdict and text of the first rule whose tokens the URL has all, by a join."""
    rules = mined.select("antecedent", F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("antecedent").alias("n"), F.concat_ws(" ", "antecedent").alias("text"), "verdict").alias("order"))
    posted = rules.select("antecedent", "order", F.explode("antecedent").alias("token"))
    rare = posted.groupBy("token").count()
    index = posted.join(rare, "token").groupBy("antecedent", "order").agg(F.min(F.struct("count", "token"))["token"].alias("token"))
    urls = rows.select("__url").where("__url is not null").distinct().withColumn("tokens", tokens_of(F.col("__url")))
    met = urls.withColumn("token", F.explode("tokens")).join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = met.groupBy("__url").agg(F.min("order").alias("__best"))
    return rows.join(best, "__url", "left").withColumns({"__mined": F.col("__best.verdict"), "__matched": F.col("__best.text")}).drop("__best")


def _longest(fixed: list[Rule]) -> Column:
    """The text of the longest fixed rule that fits host and path; looked up by the host's suffixes."""
    by_host: dict[str, list[Rule]] = {}
    for r in sorted(fixed, key=lambda r: (-len(r.text), r.text)):
        by_host.setdefault(r.host, []).append(r)
    if not by_host:
        return F.lit(None).cast("string")
    pairs = [x for h, rules in by_host.items() for x in (F.lit(h), F.array(*[F.struct(F.lit(r.path).alias("path"), F.lit(r.text).alias("text")) for r in rules]))]
    # Only suffixes of as many labels as a rule's host has: all suffixes of a host grow with its square.
    lengths = sorted({h.count(".") + 1 for h in by_host})
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in lengths]))
    found = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(F.create_map(*pairs), s), F.array().cast("array<struct<path:string,text:string>>"))))
    fits = F.filter(found, lambda r: F.col("path").startswith(r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["text"]).alias("n"), r["text"].alias("text"))))["text"]


def _first_match(url: Column, antecedents: list[list[str]]) -> Column:
    """Position (from 1) of the first rule whose tokens the URL has all; null if there is none."""
    if not antecedents:
        return F.lit(None).cast("int")
    postings: dict[str, list[int]] = {}
    for k, tokens in enumerate(antecedents, 1):
        for t in tokens:
            postings.setdefault(t, []).append(k)
    index = F.create_map(*[x for t, ks in sorted(postings.items()) for x in (F.lit(t), F.array(*map(F.lit, ks)))])
    sizes = F.array(*[F.lit(len(a)) for a in antecedents])
    met = F.flatten(F.transform(tokens_of(url), lambda t: F.coalesce(F.try_element_at(index, t), F.array().cast("array<int>"))))
    whole = F.transform(F.array(met), lambda m: F.array_min(F.filter(F.array_distinct(m), lambda k: F.size(F.filter(m, lambda x: x == k)) == F.element_at(sizes, k))))
    return F.coalesce(F.element_at(whole, 1), F.lit(None).cast("int"))


def _looked_up(key: Column, values: dict[str, str]) -> Column:
    if not values:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _element(values: list[str], at: Column) -> Column:
    # element_at over literals counts as never null, even where the position is.
    return F.when(at.isNotNull(), F.element_at(F.array(*map(F.lit, values)), at)) if values else F.lit(None).cast("string")
