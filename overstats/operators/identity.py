"""Who is who: names, ids, metadata layers and an ambiguity-dropping bridge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overstats.functions import geography

METADATA = ("bowling_type", "batting_hand", "role", "country", "external_id", "full_name")


def corpus_people(squads: DataFrame) -> DataFrame:
    """Distinct (name, person, gender, team) over the whole corpus.

    Folding to distinct facts first keeps everything after it the size of
    the people, not of their matches.
    """
    return squads.where(
        (F.coalesce("name", F.lit("")) != "") & ~F.col("person_id").startswith("~")
    ).select("name", "person_id", "gender", "team").distinct()


def name_facts(people: DataFrame) -> DataFrame:
    """Per name: how many people use it."""
    return people.select("name", "person_id").distinct().groupBy("name").agg(
        F.count(F.lit(1)).alias("people"),
    )


def person_facts(people: DataFrame) -> DataFrame:
    """Per person: names used, teams played for, genders filed under."""
    return people.groupBy("person_id").agg(
        F.sort_array(F.collect_set("name")).alias("names"),
        F.sort_array(F.collect_set(F.when(F.col("team") != "", F.col("team")))).alias("teams"),
        F.sort_array(F.collect_set("gender")).alias("genders"),
    )


def ambiguous_names(people: DataFrame) -> DataFrame:
    return name_facts(people).where(F.col("people") > 1)


def duplicate_match_ids(matches: DataFrame) -> DataFrame:
    """Match ids filed under more than one format; a build refuses them."""
    return matches.select("match_id", "fmt").groupBy("match_id").agg(
        F.count(F.lit(1)).alias("files"), F.sort_array(F.collect_set("fmt")).alias("formats")
    ).where(F.col("files") > 1)


def resolve_metadata(people: DataFrame, layers: Sequence[DataFrame], register: DataFrame
                     ) -> tuple[DataFrame, DataFrame]:
    """Attach metadata rows to people, later layers winning.

    A row applies by id, its own or through the register, or by name when
    the name is one person's, is on one row of its layer, and the row's
    country is a team they played for. Returns the resolved people and, for
    people left without, the reasons their name matches were turned down.
    """
    c = F.col
    facts = person_facts(people)
    named = people.select("name", "person_id").distinct().join(name_facts(people), "name").join(
        facts.select("person_id", "teams"), "person_id"
    )
    hits, refusals = [], []
    for depth, layer in enumerate(layers):
        ids = register.select(c("external_id").alias("_ext"), c("person_id").alias("_mapped"))
        rows = layer.join(ids, c("external_id") == c("_ext"), "left").withColumn(
            "row_person", F.when(F.coalesce("row_id", F.lit("")) != "", c("row_id"))
            .otherwise(F.coalesce("_mapped", F.lit("")))
        ).drop("_ext", "_mapped")
        meta = F.struct(*METADATA)
        pinned = rows.where(c("row_person") != "").groupBy(
            c("row_person").alias("person_id")
        ).agg(F.min_by(meta, "row_no").alias("meta"))
        by_id = facts.select("person_id").join(pinned, "person_id").select(
            "person_id", F.lit(depth).alias("layer"), F.lit("id").alias("via"),
            F.lit("").alias("name"), "meta",
        )
        per_name = rows.groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
        loose = rows.where(c("row_person") == "").groupBy("name").agg(
            F.min_by(meta, "row_no").alias("meta")
        )
        tries = named.join(loose, "name").join(per_name, "name").join(
            by_id.select("person_id"), "person_id", "left_anti"
        ).withColumn(
            "reason",
            F.when(c("people") > 1, "ambiguous_name").when(c("rows") > 1, "duplicate_rows")
            .when(~geography.country_matches(c("meta.country"), c("teams")), "country_mismatch"),
        )
        good = tries.where(c("reason").isNull()).select(
            "person_id", F.lit(depth).alias("layer"), F.lit("name").alias("via"), "name", "meta"
        )
        # Names are tried in order, so a refusal counts only if it came first.
        first_good = good.groupBy("person_id").agg(F.min("name").alias("_good"))
        refused = tries.where(c("reason").isNotNull()).join(first_good, "person_id", "left").where(
            c("_good").isNull() | (c("name") < c("_good"))
        ).select("person_id", "reason")
        hits += [by_id, good]
        refusals.append(refused)
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    # Latest layer, then id before name, then the first name.
    best = found.groupBy("person_id").agg(
        F.min(F.struct((-c("layer")).alias("l"), F.when(c("via") == "id", 0).otherwise(1)
                       .alias("v"), "name", "via", "meta")).alias("_pick"),
    )
    resolved = best.select("person_id", c("_pick.via").alias("via"), "_pick.meta.*")
    turned_down = refusals[0]
    for more in refusals[1:]:
        turned_down = turned_down.unionByName(more)
    unresolved = turned_down.join(resolved, "person_id", "left_anti").groupBy("person_id").agg(
        F.sort_array(F.collect_set("reason")).alias("reasons")
    )
    return resolved, unresolved


def resolution_counts(people: DataFrame, resolved: DataFrame, unresolved: DataFrame) -> DataFrame:
    """How many people were resolved, how, and why others were not."""
    c = F.col
    total = person_facts(people).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("players").alias("measure"), "n")
    how = resolved.groupBy(
        F.concat(F.lit("resolved_by_"), c("via")).alias("measure")
    ).agg(F.count(F.lit(1)).alias("n"))
    why = unresolved.select(F.explode("reasons").alias("r")).groupBy(
        F.concat(F.lit("rejected_"), c("r")).alias("measure")
    ).agg(F.count(F.lit(1)).alias("n"))
    styled = resolved.agg(
        F.count(F.when(c("bowling_type") != "", 1)).alias("with_style"),
        F.count(F.when(c("batting_hand") != "", 1)).alias("with_hand"),
    ).unpivot([], ["with_style", "with_hand"], "measure", "n")
    return total.unionByName(how).unionByName(why).unionByName(styled)


def bridge(register: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Person -> item through external ids, dropping every ambiguity.

    An external id on two items, a person led to two items, and an item led
    to by two people are all left out. Each test is a fold by key, so one id
    claimed by a great many rows costs a row per task. Returns the links and
    what was skipped.
    """
    c = F.col
    items = claims.groupBy("external_id", "item").agg(F.min("image").alias("image"))
    per_id = items.groupBy("external_id").agg(
        F.count(F.lit(1)).alias("items"), F.min("item").alias("item"),
        F.min("image").alias("image"),
    )
    joined = register.select("person_id", "external_id").distinct().join(per_id, "external_id")
    twice = joined.where(c("items") > 1)
    per_person = joined.where(c("items") == 1).groupBy("person_id").agg(
        F.count_distinct("item").alias("items"), F.min("item").alias("item"),
        F.max_by("image", "external_id").alias("image"),
    )
    torn = per_person.where(c("items") > 1)
    single = per_person.where(c("items") == 1).select("person_id", "item", "image")
    shared = single.groupBy("item").agg(F.count(F.lit(1)).alias("people")).where(c("people") > 1)
    kept = single.join(shared, "item", "left_anti").select("person_id", "item", "image")
    count = lambda df, why: df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(why).alias("reason"), "n")
    skipped = (
        count(twice.select("external_id").distinct(), "external id on two or more items")
        .unionByName(count(torn, "person's ids lead to different items"))
        .unionByName(count(single.join(shared, "item", "left_semi"),
                           "item leads to two or more people"))
    )
    return kept, skipped
