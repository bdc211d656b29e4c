"""The tag ontology: normalising, synonyms, categories and conflicts as column builders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from curato.functions.columns import lookup

# The ontology's categories in order, with their tags.
CATEGORIES: dict[str, tuple[str, ...]] = {
    name: tuple(tags.split())
    for name, tags in {
        "person_class": "1girl 1boy woman man person furry animal",
        "count": "solo 2girls 2boys multiple_girls multiple_boys group",
        "appearance": "black_hair blonde_hair blue_hair brown_hair green_hair grey_hair orange_hair pink_hair purple_hair red_hair silver_hair white_hair aqua_hair black_eyes blue_eyes brown_eyes green_eyes grey_eyes orange_eyes pink_eyes purple_eyes red_eyes yellow_eyes long_hair short_hair medium_hair twintails ponytail braid",
        "species": "animal_ears cat_ears dog_ears fox_ears rabbit_ears tail wings horns",
        "permanent_accessory": "halo facial_mark eyepatch",
        "clothing": "dress white_dress shirt t-shirt jacket coat skirt pants shorts school_uniform sailor_collar swimsuit armor kimono maid gloves thighhighs footwear",
        "temporary_accessory": "hat cap beret hair_ornament hairclip necklace earrings bracelet",
        "expression": "smile smiling grin open_mouth closed_mouth blush angry sad crying",
        "pose": "standing sitting kneeling lying walking running arms_up crossed_arms",
        "view": "looking_at_viewer looking_away from_above from_below from_side back",
        "composition": "portrait upper_body full_body cowboy_shot close-up dutch_angle",
        "background": "simple_background white_background black_background outdoors indoors classroom city forest sky",
        "lighting": "day night sunset backlighting dramatic_lighting soft_lighting",
        "object": "weapon sword gun book phone cup food flower vehicle",
        "style": "anime_coloring sketch watercolor oil_painting monochrome lineart pixel_art",
        "artist": "",
        "character": "",
        "copyright": "",
        "quality": "masterpiece best_quality high_quality great_quality normal_quality low_quality worst_quality",
        "rating": "rating_safe rating_questionable rating_explicit safe sensitive questionable explicit",
        "resolution": "highres absurdres incredibly_absurdres lowres",
        "text_watermark": "text watermark signature logo username",
        "unclassified": "",
    }.items()
}
SYNONYMS = {"gray_hair": "grey_hair", "gray_eyes": "grey_eyes", "smiling": "smile", "t-shirt": "tshirt"}
# Tags that contradict a tag.
CONFLICTS: dict[str, tuple[str, ...]] = {
    "1girl": ("1boy", "man"),
    "1boy": ("1girl", "woman"),
    "black_hair": ("blonde_hair", "blue_hair", "brown_hair", "green_hair", "pink_hair", "purple_hair", "red_hair", "white_hair"),
    "blonde_hair": ("black_hair", "blue_hair", "brown_hair", "green_hair", "pink_hair", "purple_hair", "red_hair", "white_hair"),
    "blue_hair": ("black_hair", "blonde_hair", "brown_hair", "green_hair", "pink_hair", "purple_hair", "red_hair", "white_hair"),
    "white_hair": ("black_hair", "blonde_hair", "blue_hair", "brown_hair", "green_hair", "pink_hair", "purple_hair", "red_hair"),
}

RANK = {name: i for i, name in enumerate(CATEGORIES)}
CATEGORY_OF = {tag: name for name, tags in CATEGORIES.items() for tag in tags}
IDENTITY = ("appearance", "species", "permanent_accessory")
CONTENT = ("person_class", "appearance", "clothing", "pose", "composition", "background", "object")
SOURCES = ("artist", "character", "copyright", "style", "quality", "rating", "resolution", "text_watermark")
EMPTY_OF_CONTENT = ("quality", "rating", "resolution", "text_watermark")


def closure(synonyms: Mapping[str, str]) -> dict[str, str]:
    """Each synonym with the end of its chain; a cycle ends before it would repeat."""
    out = {}
    for start in synonyms:
        at, seen = start, set()
        while at in synonyms and at not in seen:
            seen.add(at)
            at = synonyms[at]
        out[start] = at
    return out


def normalize(tag: Column) -> Column:
    """Lower case without outer blanks, blanks and runs of underscores being one underscore."""
    bare = F.lower(F.regexp_replace(tag, "^\\s+|\\s+$", ""))
    return F.regexp_replace(F.replace(bare, F.lit(" "), F.lit("_")), "_+", "_")


def canonical(tag: Column, synonyms: Mapping[str, str] = SYNONYMS) -> Column:
    """The normalised tag, or what it is a synonym of."""
    key = normalize(tag)
    return F.coalesce(lookup(key, closure(synonyms)), key)


def by_affix(name: Column) -> Column:
    """The category that a canonical tag's prefix or suffix gives it."""
    return (
        F.when(name.startswith("artist:") | name.endswith("_(artist)"), "artist")
        .when(name.startswith("character:") | name.endswith("_(character)"), "character")
        .when(name.startswith("copyright:") | name.startswith("series:"), "copyright")
        .when(name.startswith("rating:"), "rating")
        .when(name.endswith("_quality"), "quality")
        .otherwise("unclassified")
    )


def category(name: Column, model_category: Column | None = None) -> Column:
    """The category of a canonical tag: the model's, the ontology's, or by its prefix or suffix."""
    return of_model(F.coalesce(lookup(name, CATEGORY_OF), by_affix(name)), model_category)


def of_model(found: Column, model_category: Column | None) -> Column:
    """The model's category for characters and ratings, else the one found."""
    if model_category is None:
        return found
    return F.when(model_category.isin("character", "rating"), model_category).otherwise(found)


def rank(name: Column) -> Column:
    """The place of a category in captions."""
    return lookup(name, RANK)


def display(tag: Column) -> Column:
    """A tag as it stands in captions, with blanks for underscores."""
    return F.replace(normalize(tag), F.lit("_"), F.lit(" "))


def conflicts(name: Column) -> Column:
    """The canonical tags that contradict a tag; none for most."""
    found = F.array().cast("array<string>")
    for head, others in CONFLICTS.items():
        found = F.when(name == head, F.array(*map(F.lit, others))).otherwise(found)
    return found
