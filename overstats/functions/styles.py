"""Free-text bowling and batting styles onto a fixed taxonomy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from overstats import config as C
from overstats.functions.text import text_lookup


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", " "))


# fixed values: words that decide a style, spin before pace
LEG_SPIN = r"leg ?break|legspin|leg spin|googly|wrist spin"
LEFT_WRIST = r"chinaman|unorthodox"
OFF_SPIN = r"off ?break|offspin|off spin|offbreak|doosra"
ORTHODOX = r"orthodox"
FAST = r"\bfast\b|\bpace\b|\bquick\b"
MEDIUM = r"medium|\bmed\b"


def bowling_style(text: Column) -> Column:
    """One of the ten bowling codes, '' when nothing is recognised."""
    words = _words(text)
    left, right = words.rlike(r"\bleft\b"), words.rlike(r"\bright\b")
    slow, fast, medium = words.rlike(r"\bslow\b"), words.rlike(FAST), words.rlike(MEDIUM)
    arm = lambda l, r: F.when(left, l).otherwise(r)
    by_words = (
        F.when(words.rlike(LEG_SPIN), arm("slc", "lb"))
        .when(words.rlike(LEFT_WRIST), "slc")
        .when(words.rlike(OFF_SPIN), "ob")
        .when(words.rlike(ORTHODOX), "sla")
        .when(slow & left, "sla")
        .when(slow & right, "ob")
        .when(fast & medium, arm("lfm", "rfm"))
        .when(fast, arm("lf", "rf"))
        .when(medium, arm("lm", "rm"))
        .when(left, "lm")
        .when(right, "rm")
        .otherwise("")
    )
    return text_lookup(F.replace(words, F.lit(" "), F.lit("")), C.BOWLING_ABBREVIATIONS, by_words)


def batting_hand(text: Column) -> Column:
    words = _words(text)
    return (
        F.when(words.contains("left") | words.isin("lhb", "lh"), "left")
        .when(words.contains("right") | words.isin("rhb", "rh"), "right")
        .otherwise("")
    )


def bowling_family(code: Column) -> Column:
    table = {k: spec["family"] for k, spec in C.BOWLING_TYPES.items()}
    return text_lookup(code, table, F.lit(""))


def bowling_label(code: Column) -> Column:
    table = {k: spec["label"] for k, spec in C.BOWLING_TYPES.items()}
    return text_lookup(code, table, F.lit("Unknown"))


def matchup_note(code: Column, hand: Column) -> Column:
    """Which way the stock ball moves for this batter."""
    moves = {k: spec.get("swing") or spec["turn"] for k, spec in C.BOWLING_TYPES.items()}
    into_right = text_lookup(code, moves) == "into_rhb"
    into = F.when(hand == "right", into_right).when(hand == "left", ~into_right)
    pace = bowling_family(code) == "pace"
    return F.coalesce(
        F.when(into & pace, "angles into the batter")
        .when(~into & pace, "shapes away from the batter")
        .when(into, "turns into the batter")
        .when(~into, "turns away from the batter"),
        F.lit(""),
    )


def clean_value(text: Column) -> Column:
    """Blank out the spellings of "no value" found in exported tables."""
    bare = F.trim(F.regexp_replace(F.trim(text), '^"+|"+$', ""))
    # fixed values: null tokens
    missing = F.upper(bare).isin("", "NA", "N/A", "NULL", "NONE", "-")
    return F.when(bare.isNull() | missing, "").otherwise(bare)


def primary_style(text: Column) -> Column:
    """The first of several comma-separated styles."""
    return F.trim(F.substring_index(clean_value(text), ",", 1))
