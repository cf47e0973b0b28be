"""Cohort comparison: claims, radar profiles, reference quantiles.

Every distribution a claim is judged against is computed at once: eligible
splits become rows, shrunk and divided by the player's own baseline, and are
ranked together per (format, dimension, metric, subject).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overstats import config as C
from overstats.functions import rates, text
from overstats.operators.ranking import (
    mid_rank, pool_quantiles, pool_ranks, quantiles, ranks_against_pool, top_per_group,
)
from overstats.session import materialise

# fixed values: what is judged, in the order ties are listed
#: (key, split dimension, metric, higher is better)
BATTING_JUDGED = (
    ("vs_type", "type", "average", True),
    ("vs_type_sr", "type", "strike_rate", True),
    ("vs_family", "family", "average", True),
    ("phase", "phase", "strike_rate", True),
    ("phase_avg", "phase", "average", True),
    ("entry", "entry", "balls_per_dismissal", True),
    ("home", "home", "average", True),
    ("chase", "chase", "average", True),
    ("country", "country", "average", True),
    ("opposition", "opposition", "average", True),
)
BOWLING_JUDGED = (
    ("vs_hand", "hand", "average", False),
    ("vs_hand_econ", "hand", "economy", False),
    ("phase", "phase", "economy", False),
    ("phase_sr", "phase", "strike_rate", False),
    ("home", "home", "average", False),
    ("country", "country", "average", False),
    ("opposition", "opposition", "average", False),
)
DIMENSION_LABELS = {
    "vs_type": "Bowling type", "vs_type_sr": "Bowling type", "vs_family": "Pace or spin",
    "phase": "Match phase", "phase_avg": "Match phase", "phase_sr": "Match phase",
    "entry": "Stage of innings", "home": "Home or away", "chase": "Innings context",
    "country": "Country", "opposition": "Opposition", "vs_hand": "Batter hand",
    "vs_hand_econ": "Batter hand",
}
METRIC_LABELS = {
    "average": "average", "strike_rate": "strike rate", "economy": "economy",
    "balls_per_dismissal": "balls per dismissal",
}
#: (axis, label, split dimension or None for overall, subject, metric, higher is better)
BATTING_AXES = (
    ("runScoring", "Run scoring", None, None, "average", True),
    ("tempo", "Scoring rate", None, None, "strike_rate", True),
    ("vsPace", "Against pace", "family", "pace", "average", True),
    ("vsSpin", "Against spin", "family", "spin", "average", True),
    ("durability", "Time at the crease", None, None, "balls_per_dismissal", True),
    ("boundaries", "Boundary hitting", None, None, "boundary_pct", True),
    ("rotation", "Strike rotation", None, None, "dot_pct", False),
)
BOWLING_AXES = (
    ("wicketTaking", "Wicket taking", None, None, "strike_rate", False),
    ("control", "Economy", None, None, "economy", False),
    ("average", "Bowling average", None, None, "average", False),
    ("vsRight", "To right-handers", "hand", "right", "average", False),
    ("vsLeft", "To left-handers", "hand", "left", "average", False),
    ("dots", "Dot pressure", None, None, "dot_pct", True),
)
REFERENCE_METRICS = {
    "batting": ("average", "strike_rate", "dot_pct", "boundary_pct", "balls_per_dismissal"),
    "bowling": ("average", "economy", "strike_rate", "dot_pct"),
}


def _rates(discipline: str) -> dict[str, Column]:
    """Rates as cohorts compare them: 0, not null, without a ball."""
    made = rates.batting_rates() if discipline == "batting" else rates.bowling_rates()
    plain = ("strike_rate", "dot_pct", "boundary_pct") if discipline == "batting" else (
        "economy", "dot_pct", "boundary_pct")
    return {k: F.coalesce(v, F.lit(0.0)) if k in plain else v for k, v in made.items()}


def _judged(discipline: str):
    return BATTING_JUDGED if discipline == "batting" else BOWLING_JUDGED


def judged_dimensions(discipline: str) -> tuple[str, ...]:
    """The dimensions of splits that claims are made of, and the whole they are held against."""
    return ("all", *sorted({dim for _key, dim, _metric, _up in _judged(discipline)}))


def judged_splits(splits: DataFrame, discipline: str,
                  gates: C.Thresholds = C.THRESHOLDS) -> DataFrame:
    """Splits as judged rows: value, baseline, shrunk value, ratio, pool flag.

    A person's ``all`` row carries their baseline and their career balls; a
    window over a person's few judged subjects hands both to every split, so
    the splits are read once and joined to nothing.
    """
    c = F.col
    batting = discipline == "batting"
    split_gate = gates.bat_split if batting else gates.bowl_split
    cohort_gate = gates.bat_cohort if batting else gates.bowl_cohort
    claim_gate = gates.bat_claim if batting else gates.bowl_claim
    k = C.SHRINK_BATTING if batting else C.SHRINK_BOWLING
    made = _rates(discipline)
    judged = _judged(discipline)
    metrics = sorted({m for _k, _d, m, _u in judged})
    whole = c("dimension") == "all"
    person = Window.partitionBy("person_id", "format_key")
    rows = splits.where(c("dimension").isin("all", *{d for _k, d, _m, _u in judged})).withColumns(
        {f"_{m}": made[m] for m in metrics}
    ).withColumns(
        {f"_base_{m}": F.max(F.when(whole, c(f"_{m}"))).over(person) for m in metrics}
        | {"career_balls": F.max(F.when(whole, c("balls"))).over(person)}
    )
    wanted = F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(key).alias("dimension_key"),
                 F.lit(dim).alias("dim"), F.lit(metric).alias("metric"),
                 F.lit(up).alias("higher_is_better"), c(f"_{metric}").alias("value"),
                 c(f"_base_{metric}").alias("baseline"))
        for i, (key, dim, metric, up) in enumerate(judged)
    ])
    rows = rows.where(c("balls") >= split_gate).select(
        "person_id", "format_key", "subject", "balls", "career_balls",
        F.inline(F.filter(wanted, lambda j: j["dim"] == c("dimension"))),
    ).where(c("value").isNotNull() & (c("baseline") > 0)).drop("dim")
    shrunk = rates.shrink(c("value"), c("baseline"), c("balls"), k)
    return rows.withColumn("shrunk", shrunk).withColumns(
        {
            "ratio": c("shrunk") / c("baseline"),
            "in_pool": c("career_balls") >= cohort_gate,
            "claimable": (c("balls") >= claim_gate) & (c("career_balls") >= claim_gate),
            "discipline": F.lit(discipline),
        }
    )


GROUP = ("format_key", "discipline", "dimension_key", "subject")


def claims(judged: DataFrame, gates: C.Thresholds = C.THRESHOLDS,
           per_kind: int = C.CLAIMS_PER_KIND) -> DataFrame:
    """Strengths and weaknesses that survive every gate, ranked by severity.

    Severity ties go by dimension order, then subject.
    """
    c = F.col
    usable = materialise(judged.where(c("in_pool") | c("claimable")), "judged")
    ranks = pool_ranks(usable, GROUP, "ratio", "in_pool")
    ranked = usable.join(ranks, [*GROUP, "ratio"])
    change = pool_quantiles(ranks, GROUP, "ratio", (0.5,))
    median = quantiles(usable.where("in_pool"), GROUP, "shrunk", (0.5,))
    rows = ranked.where(c("claimable") & (c("n") >= gates.cohort_size)).join(
        change.select(*GROUP, (c("p50") - 1).alias("cohort_change")), list(GROUP)
    ).join(median.select(*GROUP, c("p50").alias("cohort_median")), list(GROUP))
    effect = (c("shrunk") - c("baseline")) / c("baseline")
    gate = F.when(c("discipline") == "batting", gates.bat_claim).otherwise(gates.bowl_claim)
    rows = rows.withColumns(
        {
            "percentile": mid_rank(c("below"), c("ties"), c("n"), c("higher_is_better")),
            "effect": F.when(c("higher_is_better"), effect).otherwise(-effect),
        }
    ).withColumns(
        {
            "kind": F.when((c("percentile") >= gates.strength_pct) & (c("effect") > 0), "strength")
            .when((c("percentile") <= gates.weakness_pct) & (c("effect") < 0), "weakness"),
            "confidence": rates.confidence(c("balls"), gate),
        }
    ).where(c("kind").isNotNull() & (F.abs("effect") >= gates.min_effect))
    weight = text.text_lookup(
        c("confidence"), {k: str(v) for k, v in C.CONFIDENCE_WEIGHTS.items()}
    ).cast("double")
    # The published percentile, to one decimal, is what severity weighs.
    shown = F.bround("percentile", 1)
    tail = F.when(c("kind") == "strength", shown).otherwise(F.lit(100.0) - shown)
    rows = rows.withColumn("severity", tail * weight)
    order = (F.desc("severity"), F.desc("discipline_first"), F.asc("ordinal"), F.asc("subject"))
    rows = rows.withColumn("discipline_first", F.when(c("discipline") == "batting", 1).otherwise(0))
    return top_per_group(
        rows, ("person_id", "format_key", "kind"), order, per_kind
    ).drop("discipline_first", "below", "ties", "claimable", "in_pool")


def claim_text(rows: DataFrame) -> DataFrame:
    """Labels and the sentence a claim is shown as."""
    c = F.col
    fmt = F.substring_index("format_key", "-", 1)
    table = {k: d for k, d, _m, _u in BATTING_JUDGED + BOWLING_JUDGED}
    subject = text.subject_label(fmt, text.text_lookup(c("dimension_key"), table), c("subject"))
    digits = lambda v: (
        F.when(c("metric") == "economy", text.fixed(v, 2))
        .when(c("metric") == "balls_per_dismissal", text.fixed(v, 0))
        .otherwise(text.fixed(v, 1)))
    diff = c("value") - c("baseline")
    word = F.when(c("discipline") == "batting", "faced").otherwise("bowled")
    metric = text.text_lookup(c("metric"), METRIC_LABELS)
    rank = F.when(
        c("percentile") >= 50,
        F.concat(F.lit("top "), text.fixed(
            F.greatest(F.lit(1.0), F.lit(100.0) - c("percentile")), 0), F.lit("%")),
    ).otherwise(F.concat(F.lit("bottom "), text.fixed(
        F.greatest(F.lit(1.0), c("percentile")), 0), F.lit("%")))
    sentence = F.concat(
        c("subject_label"), F.lit(": "), metric, F.lit(" of "), digits(c("value")), F.lit(", "),
        digits(F.abs(diff)), F.when(diff > 0, " above").otherwise(" below"), F.lit(" their "),
        metric, F.lit(" of "), digits(c("baseline")), F.lit(" on all balls "), word,
        F.lit(" ("), text.fixed(F.lit(100.0) * diff / c("baseline"), 0, signed=True), F.lit("%)"),
        F.lit(" — allowing for sample size, that change is in the "), rank,
        F.lit(" of comparable players (their median change: "),
        text.fixed(F.lit(100.0) * c("cohort_change"), 0, signed=True), F.lit("%) — "),
        c("balls").cast("string"), F.lit(" balls "), word, F.lit("."),
    )
    return rows.withColumns(
        {
            "dimension": text.text_lookup(c("dimension_key"), DIMENSION_LABELS),
            "subject_label": subject,
            "metric_label": metric,
        }
    ).withColumn("text", sentence)


def profiles(splits: DataFrame, overall: DataFrame, discipline: str,
             gates: C.Thresholds = C.THRESHOLDS) -> DataFrame:
    """Percentile on each radar axis.

    Overall axes rank raw values among raw values. Subject axes rank the raw
    value among the cohort's *shrunk* ones, as the published figures do.
    """
    c = F.col
    batting = discipline == "batting"
    gate = gates.bat_claim if batting else gates.bowl_claim
    cohort_gate = gates.bat_cohort if batting else gates.bowl_cohort
    split_gate = gates.bat_split if batting else gates.bowl_split
    k = C.SHRINK_BATTING if batting else C.SHRINK_BOWLING
    axes = BATTING_AXES if batting else BOWLING_AXES
    made = _rates(discipline)
    whole = [a for a in axes if a[2] is None]
    parts = [a for a in axes if a[2] is not None]
    career = overall.select("person_id", "format_key", c("balls").alias("career_balls"))

    def spec(axis, value):
        key, label, _d, _s, _m, up = axis
        return F.struct(F.lit(key).alias("axis"), F.lit(label).alias("label"),
                        F.lit(up).alias("higher_is_better"), value.alias("value"))

    raw = overall.select(
        "person_id", "format_key", "balls", c("balls").alias("career_balls"),
        F.explode(F.array(*[spec(a, made[a[4]]) for a in whole])).alias("_a"),
    ).select("person_id", "format_key", "balls", "career_balls", "_a.*").where(
        c("value").isNotNull()
    ).withColumns({"member": c("career_balls") >= cohort_gate, "asking": F.lit(True)})

    base = splits.where(c("dimension") == "all").select(
        "person_id", "format_key", *[made[m].alias(f"_base_{m}") for m in {a[4] for a in parts}]
    )
    tagged = [
        F.struct(spec(a, made[a[4]]).alias("a"), F.lit(a[2]).alias("dim"),
                 F.lit(a[3]).alias("sub"), F.lit(a[4]).alias("metric"))
        for a in parts
    ]
    subject = splits.select(
        "person_id", "format_key", "dimension", "subject", "balls",
        F.explode(F.filter(
            F.array(*tagged),
            lambda t: (t["dim"] == c("dimension")) & (t["sub"] == c("subject")))).alias("_t"),
    ).select("person_id", "format_key", "balls", "_t.a.*").where(c("value").isNotNull())
    subject = subject.join(base, ["person_id", "format_key"]).join(
        career, ["person_id", "format_key"]
    )
    metric = parts[0][4]
    shrunk = rates.shrink(c("value"), c(f"_base_{metric}"), c("balls"), k)
    member = (
        (c("career_balls") >= cohort_gate) & (c("balls") >= split_gate)
        & (c(f"_base_{metric}") > 0)
    )
    # One row asks for its rank, another is what the cohort is ranked by.
    pool = subject.where(member).withColumns(
        {"value": shrunk, "member": F.lit(True), "asking": F.lit(False)})
    asks = subject.withColumns({"member": F.lit(False), "asking": F.lit(True)})
    cols = ("person_id", "format_key", "balls", "career_balls", "axis", "label",
            "higher_is_better", "value", "member", "asking")
    rows = materialise(
        raw.select(*cols).unionByName(pool.select(*cols)).unionByName(asks.select(*cols)), "axes")
    ranked = ranks_against_pool(rows, ("format_key", "axis"), "value", "member")
    return ranked.where(
        c("asking") & (c("career_balls") >= gate) & (c("balls") >= gate // 4)
        & (c("n") >= gates.cohort_size)
    ).select(
        "person_id", "format_key", F.lit(discipline).alias("discipline"), "axis", "label",
        "value", mid_rank(c("below"), c("ties"), c("n"), c("higher_is_better")).alias("percentile"),
        "balls",
    )


def reference_quantiles(overall: DataFrame, discipline: str,
                        gates: C.Thresholds = C.THRESHOLDS) -> DataFrame:
    """Cohort p10…p90 of the headline metrics, from at least eight players."""
    c = F.col
    gate = gates.bat_cohort if discipline == "batting" else gates.bowl_cohort
    made = _rates(discipline)
    rows = overall.where(c("balls") >= gate).select(
        "format_key",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), made[m].alias("value"))
            for m in REFERENCE_METRICS[discipline]
        ])).alias("_m"),
    ).select("format_key", F.lit(discipline).alias("discipline"), "_m.*").where(
        c("value").isNotNull()
    )
    rows = materialise(rows, "reference")
    keys = ("format_key", "discipline", "metric")
    return quantiles(rows, keys, "value", (0.10, 0.25, 0.50, 0.75, 0.90)).where(
        c("n") >= gates.cohort_size
    )
