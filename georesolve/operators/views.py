"""Analytical views over listings, groups, votes and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolution import canonical_for_list, known
from .store import PRECISE


def with_group(listings: DataFrame, dup_links: DataFrame) -> DataFrame:
    """listings with group_id: their duplicates' group, else themselves."""
    return listings.join(dup_links.select("key", F.col("group_id").alias("__g")), "key", "left").withColumn("group_id", F.coalesce("__g", "key")).drop("__g")


def group_list(members: DataFrame, hidden: DataFrame, reviews: DataFrame, photos: DataFrame, only_hidden: bool = False) -> DataFrame:
    """One row per group: canonical member's fields, n_listings, price range, first photo, review status.

    A group with a hidden member is hidden. members: listings with group_id.
    """
    h = hidden.select("key").distinct().withColumn("__h", F.lit(True))
    m = members.join(h, "key", "left")
    stats = m.groupBy("group_id").agg(F.count("*").alias("n_listings"), F.min(known(F.col("price"))).alias("price_min"), F.max(known(F.col("price"))).alias("price_max"), F.coalesce(F.bool_or("__h"), F.lit(False)).alias("hidden"), F.min("first_seen").alias("group_first_seen"))
    stats = stats.where(F.col("hidden") == only_hidden)
    head = canonical_for_list(members)
    fields = members.drop("group_id")
    out = stats.join(head, "group_id").join(fields, F.col("canonical") == fields["key"]).drop("key")
    photo = photos.groupBy("key").agg(F.min_by("url", F.struct("ord", "url")).alias("photo")).withColumnRenamed("key", "canonical")
    status = reviews.select(F.col("key").alias("group_id"), F.col("status").alias("__st"))
    return out.join(photo, "canonical", "left").join(status, "group_id", "left").withColumn("status", F.coalesce("__st", F.lit("new"))).drop("__st")


def filtered(groups: DataFrame, status: str | None = None, min_score: float | None = None, max_price: float | None = None, min_price: float | None = None, min_area: float | None = None, min_bedrooms: int | None = None, features: tuple[str, ...] = ()) -> DataFrame:
    """Groups that pass: a null score counts as 0, a null price passes a maximum, other nulls fail their minimum."""
    out = groups
    if status:
        out = out.where(F.col("status") == status)
    if min_score is not None:
        out = out.where(F.coalesce("place_score", F.lit(0.0)) >= min_score)
    if max_price is not None:
        out = out.where(known(F.col("price")).isNull() | (F.col("price") <= max_price))
    for name, least in (("price", min_price), ("area_m2", min_area), ("bedrooms", min_bedrooms)):
        if least is not None:
            out = out.where(F.coalesce(F.col(name), F.lit(0)) >= least)
    for f in features:
        out = out.where(F.coalesce(F.col(f"has_{f}"), F.lit(False)))
    return out


def order(by: str) -> list[Column]:
    """Sort keys of the list: score (also for unknown names), price, new, area; ties by group."""
    keys = {"price": F.coalesce(known(F.col("price")), F.lit(1e9)).asc(), "new": F.col("first_seen").desc_nulls_last(), "area": F.coalesce(F.col("area_m2"), F.lit(0.0)).desc()}
    return [keys.get(by, F.coalesce(F.col("place_score"), F.lit(0.0)).desc()), F.col("group_id")]


def ranked(groups: DataFrame, by: str) -> DataFrame:
    return groups.orderBy(*order(by))


def group_detail(members: DataFrame, canonical: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per group: canonical, others, distinct sources, price range, review status."""
    m = members.join(canonical, "group_id")
    out = m.groupBy("group_id", "canonical").agg(
        F.array_sort(F.collect_set(F.when(F.col("key") != F.col("canonical"), F.col("key")))).alias("others"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min(known(F.col("price"))).alias("price_min"),
        F.max(known(F.col("price"))).alias("price_max"),
    )
    return out.join(reviews.select(F.col("key").alias("group_id"), "status"), "group_id", "left").withColumn("status", F.coalesce("status", F.lit("new")))


def vote_pivot(votes: DataFrame) -> DataFrame:
    """group_id, votes: map of person to vote."""
    return votes.groupBy("group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("person", "vote")))).alias("votes"))


def vote_status(groups: DataFrame, votes: DataFrame, people: DataFrame) -> DataFrame:
    """Per group: liked_by, waiting_for, rejected (somebody passed), matched (all active people like it).

    People are a handful; what is waiting is their list less those who voted, so no group meets each person.
    """
    active = people.where("active").agg(F.array_sort(F.collect_set("name")).alias("everyone"))
    v = votes.join(people.where("active").select(F.col("name").alias("person")), "person", "left_semi")
    per = v.groupBy("group_id").agg(F.array_sort(F.collect_set(F.when(F.col("vote") == "like", F.col("person")))).alias("liked_by"), F.collect_set("person").alias("voted"))
    passed = votes.where("vote = 'pass'").select("group_id").distinct().withColumn("rejected", F.lit(True))
    none = F.array().cast("array<string>")
    # active is one row, whatever the data
    out = groups.select("group_id").join(per, "group_id", "left").join(passed, "group_id", "left").join(F.broadcast(active))
    out = out.withColumns({"liked_by": F.coalesce("liked_by", none), "rejected": F.coalesce("rejected", F.lit(False))})
    matched = (F.size("everyone") > 0) & (F.size("liked_by") == F.size("everyone"))
    return out.select("group_id", "liked_by", F.array_except("everyone", F.coalesce("voted", none)).alias("waiting_for"), "rejected", matched.alias("matched"))


def queue(groups: DataFrame, votes: DataFrame, person: str) -> DataFrame:
    """What a person is to look at: not voted on by them, not passed by others; most liked by others first, then score."""
    own = votes.where(F.col("person") == person).select("group_id")
    passed = votes.where((F.col("person") != person) & (F.col("vote") == "pass")).select("group_id")
    likes = votes.where((F.col("person") != person) & (F.col("vote") == "like")).groupBy("group_id").agg(F.count("*").alias("likes"))
    out = groups.select("group_id", "place_score").join(own, "group_id", "left_anti").join(passed, "group_id", "left_anti").join(likes, "group_id", "left").fillna(0, ["likes"])
    return out.orderBy(F.col("likes").desc(), F.coalesce("place_score", F.lit(0.0)).desc(), "group_id")


def matches(groups: DataFrame, status: DataFrame) -> DataFrame:
    return groups.join(status.where("matched"), "group_id").orderBy(F.coalesce("place_score", F.lit(0.0)).desc(), "group_id")


def liked_unmatched(groups: DataFrame, status: DataFrame, person: str) -> DataFrame:
    return groups.join(status.where(~F.col("matched") & F.array_contains("liked_by", person)), "group_id").orderBy(F.coalesce("place_score", F.lit(0.0)).desc(), "group_id")


def counters(status: DataFrame) -> DataFrame:
    """counter, n: match, rejected, and waiting by person; a group counts once, in that order."""
    kind = F.when(F.col("matched"), F.array(F.lit("match"))).when(F.col("rejected"), F.array(F.lit("rejected"))).otherwise(F.transform("waiting_for", lambda p: F.concat(F.lit("waiting:"), p)))
    return status.select(F.explode(kind).alias("counter")).groupBy("counter").agg(F.count("*").alias("n"))


def navigation(status: DataFrame, candidates: DataFrame, person: str) -> DataFrame:
    """counter, n of one person's menu: those of counters, what waits for the person (mine), what they liked and is no match yet (liked), open duplicate candidates (dups); zeros too."""
    named = counters(status).select("counter", "n")
    waits = F.concat(F.lit("waiting:"), F.lit(person))
    mine = named.where(F.col("counter") == waits).select(F.lit("mine").alias("counter"), "n")
    liked = status.where(~F.col("matched") & F.array_contains("liked_by", person)).select(F.lit("liked").alias("counter"), F.lit(1).cast("long").alias("n"))
    dups = candidates.select(F.lit("dups").alias("counter"), F.lit(1).cast("long").alias("n"))
    always = status.sparkSession.createDataFrame([(c, 0) for c in ("match", "rejected", "mine", "liked", "dups")], "counter string, n long")
    every = named.unionByName(mine).unionByName(liked).unionByName(dups).unionByName(always)
    return every.groupBy("counter").agg(F.sum("n").alias("n"))


def matched_reviews(reviews: DataFrame, status: DataFrame) -> DataFrame:
    """Reviews after matches: a matched group's status becomes visit."""
    hit = status.where("matched").select(F.col("group_id").alias("key"), F.lit("visit").alias("__v"))
    return reviews.join(hit, "key", "full").withColumn("status", F.coalesce("__v", "status")).drop("__v")


def candidate_pairs(candidates: DataFrame, listings: DataFrame, photos: DataFrame, k: int = 3) -> DataFrame:
    """Open candidates with titles, prices and first photos of both sides, both active; best first."""
    first = photos.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "url"))), 1, k).alias("p")).select("key", F.transform("p", lambda s: s["url"]).alias("photos"))
    side = listings.where("active").select("key", "title", "price").join(first, "key", "left")
    a = side.select(F.col("key").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("title", "price", "photos")])
    b = side.select(F.col("key").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("title", "price", "photos")])
    return candidates.join(a, "a").join(b, "b").orderBy(F.col("score").desc(), "a", "b")


def merged_groups(dup_links: DataFrame) -> DataFrame:
    """Groups of several: members and methods as lists, largest confidence."""
    out = dup_links.groupBy("group_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("key")).alias("members"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set(F.nullif("method", F.lit("")))).alias("methods"))
    return out.where("n > 1")


def votes_by_person(votes: DataFrame, people: DataFrame, n_groups: int) -> DataFrame:
    """Per active person: counts of each vote, total and pending."""
    counts = votes.groupBy("person").agg(*[F.count_if(F.col("vote") == v).alias(f"n_{v}") for v in ("like", "maybe", "pass")], F.count("*").alias("total"))
    out = people.where("active").select(F.col("name").alias("person")).join(counts, "person", "left").fillna(0)
    return out.withColumn("pending", F.greatest(F.lit(0), F.lit(n_groups) - F.col("total")))


def source_stats(listings: DataFrame) -> DataFrame:
    return listings.groupBy("source").agg(F.count("*").alias("n"), F.count_if("active").alias("active"), F.avg("place_score").alias("mean_score")).orderBy(F.col("n").desc(), "source")


def price_drops(listings: DataFrame, k: int = 10) -> DataFrame:
    drop = F.col("price_first") - F.col("price")
    return listings.where("price < price_first").withColumn("drop", drop).orderBy(F.col("drop").desc(), "key").limit(k)


def score_distribution(groups: DataFrame) -> DataFrame:
    """One row: groups at 60 or more, 45 or more, less, and without a score."""
    s = F.col("place_score")
    return groups.agg(F.count_if(s >= 60).alias("high"), F.count_if((s >= 45) & (s < 60)).alias("middle"), F.count_if(s < 45).alias("low"), F.count_if(s.isNull()).alias("unknown"))


def totals(listings: DataFrame, dup_links: DataFrame, candidates: DataFrame, status: DataFrame) -> DataFrame:
    """One row: listings, groups, duplicates, candidates, matches."""
    g = with_group(listings, dup_links).agg(F.count("*").alias("listings"), F.count_distinct("group_id").alias("groups"))
    d = dup_links.agg(F.greatest(F.lit(0), F.count("*") - F.count_distinct("group_id")).alias("duplicates"))
    c, m = candidates.agg(F.count("*").alias("candidates")), status.agg(F.count_if("matched").alias("matches"))
    return g.join(F.broadcast(d)).join(F.broadcast(c)).join(F.broadcast(m))  # one row each


def rebuild_summary(listings: DataFrame, dup_links: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    g = with_group(listings, dup_links).agg(F.count("*").alias("listings"), F.count_distinct("group_id").alias("groups"))
    d = dup_links.agg(F.greatest(F.lit(0), F.count("*") - F.count_distinct("group_id")).alias("duplicates"))
    return g.join(F.broadcast(links.agg(F.count("*").alias("links")))).join(F.broadcast(d)).join(F.broadcast(candidates.agg(F.count("*").alias("candidates"))))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Per source: pages, found, kept, new, and skipped by reason. outcomes: source, event, reason."""
    return outcomes.groupBy("source", "event", "reason").agg(F.count("*").alias("n"))


def map_points(listings: DataFrame) -> DataFrame:
    approx = ~F.coalesce(F.col("geo_precision").isin(PRECISE), F.lit(False))
    return listings.where("lat is not null").select("key", "title", "price", "lat", "lon", "place_score", approx.alias("approx"))


def first_photos(photos: DataFrame, k: int) -> DataFrame:
    return photos.withColumn("__i", F.row_number().over(Window.partitionBy("key").orderBy("ord", "url"))).where(F.col("__i") <= k).drop("__i")
