"""Record shapes: canonical gear rows, talents, stat tokens, merged exports, and samples of pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import list_index, upper_camel
from .aggregate import dealt

# Level caps in the order of ascensions; optional fields of a gear record; talents and their skills.
LEVEL_CAPS = (20, 40, 50, 60, 70, 80, 90)
OPTIONAL = ("weapon_key", "maxLevel", "_equipped")
TALENTS = (("basic", "normal"), ("skill", "resonance"), ("forte", "forte"), ("liberation", "liberation"), ("intro", "intro"))
# Stat names, squashed, and the tokens they are exported as; the second table counts for percent values only and comes first.
STATS = """
cr CritRate, critrate CritRate, cd CritDMG, critdmg CritDMG, energyregen EnergyRegen, er EnergyRegen,
resonanceliberationdmgbonus ResonanceLiberationDMGBonus, resonanceskilldmgbonus ResonanceSkillDMGBonus,
basicattackdmgbonus BasicAttackDMGBonus, heavyattackdmgbonus HeavyAttackDMGBonus, liberationdmg ResonanceLiberationDMGBonus,
skilldmg ResonanceSkillDMGBonus, healingbonus HealingBonus, fusiondmgbonus Fusion, electrodmgbonus Electro, glaciodmgbonus Glacio,
aerodmgbonus Aero, spectrodmgbonus Spectro, havocdmgbonus Havoc, fusion Fusion, electro Electro, glacio Glacio, aero Aero,
spectro Spectro, havoc Havoc, hpflat HP_FLAT, atkflat ATK_FLAT, defflat DEF_FLAT
"""
PERCENT_STATS = """
skill ResonanceSkillDMGBonus, skilldmg ResonanceSkillDMGBonus, resonanceskill ResonanceSkillDMGBonus,
resonanceskilldmg ResonanceSkillDMGBonus, basic BasicAttackDMGBonus, basicattack BasicAttackDMGBonus, heavy HeavyAttackDMGBonus,
heavyattack HeavyAttackDMGBonus, liberation ResonanceLiberationDMGBonus, resonanceliberation ResonanceLiberationDMGBonus,
glacio Glacio, fusion Fusion, electro Electro, aero Aero, spectro Spectro, havoc Havoc
"""
#: Stats that are flat or percent under one name.
BASES = ("hp", "atk", "def")


def _lookup(text: str, key: Column) -> Column:
    pairs = [x.split() for x in text.split(",")]
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), key)


def canonical_gear(entry: Column) -> Column:
    """A JSON row of either shape as {"id": {level, ascension, rank, ...}}, without null or empty optional fields.

    Rows of the keyed shape (one key, with a level, ascension or rank below it) and rows that aren't recognised pass
    through unchanged; a level or rank that is no number becomes 0 or 1.
    """
    keys = F.coalesce(F.json_object_keys(entry), F.array().cast("array<string>"))
    modern = F.array_contains(keys, "id") & F.arrays_overlap(keys, F.array(F.lit("level"), F.lit("maxLevel"), F.lit("rank"))) & F.get_json_object(entry, "$.id").isNotNull()

    def whole(name: str, default: int) -> Column:
        return F.coalesce(F.get_json_object(entry, f"$.{name}").try_cast("bigint"), F.lit(default))

    def filled(name: str, kind: str = "string") -> Column:
        return F.nullif(F.get_json_object(entry, f"$.{name}"), F.lit("")).try_cast(kind).alias(name)

    record = F.struct(
        whole("level", 0).alias("level"), list_index(whole("maxLevel", -1), list(LEVEL_CAPS)).alias("ascension"), whole("rank", 1).alias("rank"),
        *[filled(n, "bigint" if n == "maxLevel" else "string") for n in OPTIONAL],
    )
    return F.when(modern, F.to_json(F.create_map(F.get_json_object(entry, "$.id"), record))).otherwise(entry)


def unwrap_id(value: Column) -> Column:
    """The id of a JSON object that has one, else the value itself."""
    return F.coalesce(F.get_json_object(value, "$.id"), value)


def talents(skills: Column) -> Column:
    """Talents by name, as whole numbers in text, of a map of skill levels; what is no number goes."""
    pairs = [F.struct(F.lit(to).alias("key"), F.try_element_at(skills, F.lit(of)).try_cast("double").cast("bigint").cast("string").alias("value")) for to, of in TALENTS]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def stat_token(name: Column, value: Column, is_main: Column) -> Column:
    """The token of a stat: aliases of percent values first, then aliases, bases flat or not, else its words joined."""
    raw = F.trim(name)
    key = F.regexp_replace(F.lower(raw), "[^a-z0-9]", "")
    percent = raw.contains("%") | F.coalesce(value, F.lit("")).contains("%")
    base = F.when(percent | is_main, F.upper(key)).otherwise(F.concat(F.upper(key), F.lit("_FLAT")))
    rest = upper_camel(F.when(raw.endswith("%") & (key != ""), key).otherwise(raw))
    return F.coalesce(F.when(percent, _lookup(PERCENT_STATS, key)), _lookup(STATS, key), F.when(key.isin(*BASES), base), rest)


def merge_exports(old: DataFrame, new: DataFrame, section: str, key: str, value: str, summed: Sequence[str]) -> DataFrame:
    """Rows (section, key, value) of both: summed by key in some sections; of the others, those of the new export replace the old ones."""
    stay = old.join(new.filter(~F.col(section).isin(*summed)).select(section).distinct(), section, "left_anti")
    both = stay.select(section, key, value).unionByName(new.select(section, key, value))
    add = both.filter(F.col(section).isin(*summed)).groupBy(section, key).agg(F.sum(value).alias(value))
    return add.unionByName(both.filter(~F.col(section).isin(*summed)))


def neighbourhood_median(pixels: DataFrame, points: DataFrame, image: str, value: str, radius: int) -> DataFrame:
    """points (image, x, y) with the median of the pixels (image, x, y, value) at most radius away in x and y, rounded half to even."""
    near = F.sequence(F.lit(-radius), F.lit(radius))
    p = points.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
    p = p.select(image, F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y"))
    found = p.join(pixels, [image, "x", "y"]).groupBy(image, "_x", "_y").agg(F.bround(F.median(value), 0).cast("bigint").alias(value))
    return found.withColumnsRenamed({"_x": "x", "_y": "y"})


def colour_summary(pixels: DataFrame, image: str, channels: Sequence[str]) -> DataFrame:
    """By image, how many different colours it has, and the range of each channel."""
    ends = [f(c).alias(f"{n}_{c}") for c in channels for f, n in ((F.min, "min"), (F.max, "max"))]
    different = dealt(pixels.select(image, *channels), image).groupBy(image, *channels).agg(F.lit(1).alias("_one"))
    return different.groupBy(image).agg(F.count("*").alias("colours"), *ends)
