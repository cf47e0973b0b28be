"""Identifiers, over notation and display text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from overstats import config as C
from overstats.functions.flags import bowler_credited


def text_lookup(value: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    """A literal lookup as a map constant: no join for a handful of entries."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), value)
    return found if otherwise is None else F.coalesce(found, otherwise)


def format_key(fmt: Column, gender: Column) -> Column:
    return F.concat(fmt, F.lit("-"), text_lookup(gender, C.GENDER_CODES))


def slug_text(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def person_slug(name: Column, person_id: Column) -> Column:
    base = slug_text(name)
    return F.when(base == "", person_id).otherwise(
        F.concat(base, F.lit("-"), F.substring(person_id, 1, 8))
    )


def team_id(name: Column, gender: Column) -> Column:
    return F.concat(slug_text(name), F.lit("-"), text_lookup(gender, C.GENDER_CODES))


def team_label(name: Column, gender: Column) -> Column:
    return F.when(gender == "female", F.concat(name, F.lit(" Women"))).otherwise(name)


def fixed(value: Column, digits: int, signed: bool = False) -> Column:
    """A number to fixed digits, rounded on its exact binary value.

    ``format_string`` rounds the printed decimal instead: 43.55 would gain.
    """
    pattern = "0" + ("." + "0" * digits if digits else "")
    pattern = f"+{pattern};-{pattern}" if signed else pattern
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def overs_text(balls: Column, per_over: Column | int = 6) -> Column:
    """262 legal balls -> '43.4'; whole overs keep '.0'."""
    per_over = F.lit(per_over) if isinstance(per_over, int) else per_over
    whole = F.floor(balls / per_over).cast("string")
    return F.concat(whole, F.lit("."), (balls % per_over).cast("string"))


def overs_notation(balls: Column) -> Column:
    """662 balls -> '110.2'; whole overs have no fraction."""
    whole = F.floor(balls / F.lit(6)).cast("string")
    rest = balls % 6
    return F.when(rest == 0, whole).otherwise(F.concat(whole, F.lit("."), rest.cast("string")))


def overs_to_balls(overs: Column) -> Column:
    """48.5 overs is 48 overs and 5 balls, 293."""
    whole = F.floor(overs)
    return (whole * 6 + F.round((overs - whole) * 10)).cast("bigint")


def plural(n: Column, one: str, many: str | None = None) -> Column:
    many = many or one + "s"
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def result_type(winner: Column, result: Column) -> Column:
    return (
        F.when(winner.isNotNull(), "win")
        .when(result == "tie", "tie")
        .when(result == "draw", "draw")
        .otherwise("noResult")
    )


def result_text(winner, result, by_runs, by_wickets, by_innings, method,
                eliminator, bowl_out) -> Column:
    """The result as a scorecard states it. All arguments are columns."""
    tie = F.when(
        eliminator.isNotNull(),
        F.concat(F.lit("Match tied ("), eliminator, F.lit(" won the Super Over)")),
    ).when(
        bowl_out.isNotNull(),
        F.concat(F.lit("Match tied ("), bowl_out, F.lit(" won the bowl-out)")),
    ).otherwise("Match tied")
    won = winner.isNotNull()
    innings_win = F.when(
        F.coalesce(by_runs, F.lit(0)) != 0,
        F.concat(winner, F.lit(" won by an innings and "), plural(by_runs, "run")),
    ).otherwise(F.concat(winner, F.lit(" won by an innings")))
    base = (
        F.when(result == "tie", tie)
        .when(result == "draw", "Match drawn")
        .when(result == "no result", "No result")
        .when(won & (F.coalesce(by_innings, F.lit(0)) != 0), innings_win)
        .when(won & by_runs.isNotNull(),
              F.concat(winner, F.lit(" won by "), plural(by_runs, "run")))
        .when(won & by_wickets.isNotNull(),
              F.concat(winner, F.lit(" won by "), plural(by_wickets, "wicket")))
        .when(won & (method == "Awarded"), F.concat(winner, F.lit(" won (awarded)")))
        .when(won, F.concat(winner, F.lit(" won")))
        .otherwise("No result")
    )
    suffix = F.when(
        method.isNotNull() & (method != "Awarded"),
        F.concat(F.lit(" ("), method, F.lit(" method)")),
    ).otherwise("")
    return F.concat(base, suffix)


def missing_fields(missing: Column) -> Column:
    """Names in ``info.missing``: plain names, or the keys of JSON objects."""
    names = F.transform(
        missing,
        lambda x: F.when(x.startswith("{"), F.json_object_keys(x)).otherwise(F.array(x)),
    )
    return F.coalesce(
        F.array_distinct(F.flatten(names)), F.array().cast("array<string>")
    )


def is_featured_final(event_name: Column, stage: Column) -> Column:
    name = F.coalesce(event_name, F.lit(""))
    return (
        F.coalesce(stage == "Final", F.lit(False))
        & name.rlike(C.FEATURED_EVENTS)
        & ~name.rlike(C.NOT_FEATURED_EVENTS)
    )


def dismissal_label(kind: Column, bowler: Column) -> Column:
    credited = bowler_credited(kind) & bowler.isNotNull()
    return (
        F.when(~credited, kind)
        .when(kind == "bowled", F.concat(F.lit("b "), bowler))
        .when(kind == "caught and bowled", F.concat(F.lit("c & b "), bowler))
        .otherwise(F.concat(kind, F.lit(" b "), bowler))
    )


# fixed values: chip suffix and the two spellings of each extra
EXTRA_TEXT = {
    "wides": ("wd", "wide", "wides"),
    "noballs": ("nb", "no-ball", "no-balls"),
    "byes": ("b", "bye", "byes"),
    "legbyes": ("lb", "leg bye", "leg byes"),
    "penalty": ("p", "penalty run", "penalty runs"),
}


def ball_labels() -> dict[str, Column]:
    """Chip text, tone and description of a flagged delivery."""
    c = F.col
    runs = c("runs_batter") + c("runs_extras")
    kinds = F.array_join(F.transform(c("wickets"), lambda w: w["kind"]), " and ")
    also = F.when(F.size("wickets") > 0, F.concat(F.lit(", "), kinds)).otherwise("")
    first_extra = F.coalesce(*[F.when(c(k) > 0, k) for k in C.EXTRA_KINDS])
    parts = [
        F.when(c(k) > 0, F.concat(c(k).cast("string"), F.lit(" "),
                                  F.when(c(k) == 1, EXTRA_TEXT[k][1]).otherwise(EXTRA_TEXT[k][2])))
        for k in C.EXTRA_KINDS
    ]
    parts.append(
        F.when(c("runs_batter") > 0,
               F.concat(c("runs_batter").cast("string"), F.lit(" off the bat")))
    )
    suffix = text_lookup(first_extra, {k: v[0] for k, v in EXTRA_TEXT.items()})
    wicket, extra = c("team_wickets") > 0, first_extra.isNotNull()
    run_word = plural(runs, "run")
    boundary = c("runs_batter").isin(4, 6)
    return {
        "label": F.when(wicket, "W")
        .when(extra, F.concat(runs.cast("string"), suffix))
        .when(c("runs_batter") == 0, "•")
        .otherwise(c("runs_batter").cast("string")),
        "tone": F.when(wicket, "wicket").when(extra, "extra")
        .when(c("runs_batter") == 0, "dot").when(boundary, "boundary").otherwise("run"),
        "description": F.when(
            wicket, F.when(runs > 0, F.concat(kinds, F.lit(", "), run_word)).otherwise(kinds))
        .when(extra, F.concat(F.concat_ws(", ", *parts), also))
        .when(c("runs_batter") == 0, F.concat(F.lit("dot ball"), also))
        .when(boundary, F.concat(F.when(c("runs_batter") == 4, "four").otherwise("six"), also))
        .otherwise(F.concat(plural(c("runs_batter"), "run"), also)),
    }


def licence_accepted(name: Column) -> Column:
    """CC0, public domain, CC BY or BY-SA, or GODL; never NC or ND."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[-_]", " "), r"\s+", " "))
    words = F.split(norm, " ")
    refused = F.arrays_overlap(words, F.array(F.lit("nc"), F.lit("nd")))
    # fixed values: accepted licence names
    accepted = (
        r"^(cc0|cc zero)( \d+(\.\d+)?)?( universal)?$",
        r"^(public domain|pd|pdm)( .*)?$",
        r"^cc by( sa)?( \d+(\.\d+)?)?( [a-z]+)*$",
        r"^godl( india)?$",
    )
    match = F.lit(False)
    for pattern in accepted:
        match = match | norm.rlike(pattern)
    return F.coalesce((norm != "") & ~refused & match, F.lit(False))


def subject_label(fmt: Column, dimension: Column, subject: Column) -> Column:
    """Readable name of a split subject."""
    from overstats.functions.flags import phase_label

    types = {code: spec["label"] for code, spec in C.BOWLING_TYPES.items()}
    return (
        F.when(dimension == "type", text_lookup(subject, types, F.lit("Unknown")))
        .when(dimension == "family", text_lookup(subject, C.FAMILY_LABELS, subject))
        .when(dimension == "phase", phase_label(fmt, subject))
        .when(dimension == "type_phase", F.concat(
            text_lookup(F.substring_index(subject, "|", 1), types, F.lit("Unknown")), F.lit(", "),
            phase_label(fmt, F.substring_index(subject, "|", -1))))
        .when(dimension == "entry", text_lookup(subject, C.ENTRY_LABELS, subject))
        .when(dimension == "home", text_lookup(subject, C.HOME_LABELS, subject))
        .when(dimension == "chase", text_lookup(subject, C.CHASE_LABELS, subject))
        .when(dimension == "hand", text_lookup(subject, C.HAND_LABELS, subject))
        .when(dimension == "innings_no", F.concat(F.lit("Innings "), subject))
        .when(dimension == "position", F.concat(F.lit("No. "), subject))
        .otherwise(subject)
    )
