"""Label and key normalisation as column expressions.

Everything here returns a ``Column`` built from built-in functions, so it runs
inside whole-stage codegen; there are no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Body-part labels of the event feed -> neutral body part.
BODY_PART_MAP = {
    "left foot": "left_foot",
    "right foot": "right_foot",
    "head": "head",
    "keeper arm": "keeper_hands",
    "keeper hand": "keeper_hands",
    "keeper hands": "keeper_hands",
    "no touch": "other",
    "other": "other",
}
# Play patterns of the event feed -> neutral play pattern.
PLAY_PATTERN_MAP = {
    "regular play": "regular_play",
    "from corner": "from_corner",
    "from free kick": "from_free_kick",
    "from throw in": "from_throw_in",
    "from goal kick": "from_goal_kick",
    "from kick off": "from_kick_off",
    "from counter": "from_counter",
    "from keeper": "from_keeper",
    "other": "other",
}
# Pass types ("" means an open-play pass).
PASS_TYPE_MAP = {
    "": "open_play",
    "corner": "corner",
    "free kick": "free_kick",
    "throw in": "throw_in",
    "goal kick": "goal_kick",
    "kick off": "kick_off",
}
# Shot types ("" means open play).
SHOT_TYPE_MAP = {
    "": "open_play",
    "open play": "open_play",
    "penalty": "penalty",
    "free kick": "free_kick",
    "corner": "corner",
}
GENDERS = ("female", "male", "mixed")
MATCH_STATUSES = ("available", "complete", "postponed", "scheduled")
FIXTURE_STATUS = {
    "FT": "complete", "AET": "complete", "PEN": "complete",
    "NS": "scheduled", "TBD": "scheduled",
    "PST": "postponed", "CANC": "postponed", "ABD": "postponed", "SUSP": "postponed",
}
LANGUAGES = ("en", "es", "fr", "pt", "de")
DEFAULT_LANGUAGE = "en"
TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Literal map lookup (``element_at`` on a map literal), null when absent."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), key)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# B1
def normalize_provider_label(c) -> Column:
    """Runs of non-alphanumerics -> one space, trim, lower; null -> ''."""
    return F.coalesce(F.lower(F.trim(F.regexp_replace(col_(c), "[^A-Za-z0-9]+", " "))), F.lit(""))


# B2
def map_body_part(pass_part, shot_part) -> Column:
    """Neutral body part; the pass detail wins over the shot detail."""
    raw = F.coalesce(col_(pass_part), col_(shot_part))
    return lookup(BODY_PART_MAP, normalize_provider_label(raw))


# B3
def map_play_pattern(c) -> Column:
    return lookup(PLAY_PATTERN_MAP, normalize_provider_label(c))


# B4
def map_pass_type(has_pass, pass_type_name) -> Column:
    return F.when(col_(has_pass), lookup(PASS_TYPE_MAP, normalize_provider_label(pass_type_name)))


# B5
def map_shot_type(has_shot, shot_type_name) -> Column:
    return F.when(col_(has_shot), lookup(SHOT_TYPE_MAP, normalize_provider_label(shot_type_name)))


# B6
def cross_flag(has_pass, cross) -> Column:
    return F.when(col_(has_pass), F.coalesce(col_(cross), F.lit(False)))


# B7
def normalize_gender(c) -> Column:
    return F.when(col_(c).isin(*GENDERS), col_(c)).otherwise(F.lit("unknown"))


def normalize_match_status(c) -> Column:
    return F.when(col_(c).isin(*MATCH_STATUSES), col_(c)).otherwise(F.lit("unknown"))


# B8
def map_fixture_status(short) -> Column:
    return F.coalesce(lookup(FIXTURE_STATUS, col_(short)), F.lit("unknown"))


# B9
def map_feed_event_type(type_, detail) -> Column:
    t = F.coalesce(F.lower(F.trim(col_(type_))), F.lit(""))
    return (F.when(t == "goal", F.lit("Goal"))
            .when(t == "card", F.coalesce(col_(detail), F.lit("Card")))
            .when(t == "subst", F.lit("Substitution"))
            .when(t == "var", F.lit("VAR"))
            .otherwise(F.coalesce(col_(detail), col_(type_))))


# B10
def infer_period(minute) -> Column:
    m = col_(minute)
    return F.when(m > 105, 4).when(m > 90, 3).when(m > 45, 2).otherwise(1)


# B11
def prefix_entity_id(c, prefix: str) -> Column:
    """``prefix || id``; a null id stays null (``concat`` propagates nulls)."""
    return F.concat(F.lit(prefix), col_(c).cast("string")) if prefix else col_(c).cast("string")


# B12
def competition_key(a, b) -> Column:
    return F.concat_ws(":", col_(a).cast("string"), col_(b).cast("string"))


def parse_competition_key(c) -> Column:
    """struct(league, season) or null parts when not integers (caller checks)."""
    parts = F.split(col_(c), ":")
    return F.struct(
        parts.getItem(0).try_cast("bigint").alias("league"),
        parts.getItem(1).try_cast("bigint").alias("season"),
    )


# B14
def split_location(arr) -> tuple[Column, Column]:
    a = col_(arr)
    ok = F.size(a) >= 2
    return F.when(ok, a.getItem(0)), F.when(ok, a.getItem(1))


# B15
def author_label(user_id) -> Column:
    handle = F.substring(F.regexp_replace(F.coalesce(col_(user_id), F.lit("")), "-", ""), 1, 6)
    return F.concat(F.lit("Member "), F.coalesce(F.nullif(handle, F.lit("")), F.lit("member")))


# B18
def normalize_entity(c) -> Column:
    return F.lower(F.regexp_replace(F.trim(col_(c).cast("string")), r"\s+", " "))


# B19
def normalize_language(c) -> Column:
    cand = F.lower(F.trim(col_(c)))
    return F.when(cand.isin(*LANGUAGES), cand).otherwise(F.lit(DEFAULT_LANGUAGE))


# B20
def parse_bool(c) -> Column:
    """Text flag -> boolean: true/1/yes, false/0/no; other non-empty text is true.

    The empty string is falsy, as in the reference's Python truthiness rule.
    """
    s = F.lower(F.trim(col_(c)))
    return (F.when(col_(c).isNull(), F.lit(None).cast("boolean"))
            .when(s.isin(*TRUE_WORDS), F.lit(True))
            .when(s.isin(*FALSE_WORDS), F.lit(False))
            .otherwise(F.length(col_(c)) > 0))


# D1
def spadl_label(c) -> Column:
    """Remove '*', '-' -> space, trim, lower; null -> '' (underscores stay)."""
    return F.coalesce(F.lower(F.trim(F.translate(col_(c), "-*", " "))), F.lit(""))
