"""Scalar functions of ingest and display: Column in, Column out, all within code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import values as V


def matches(c: Column, pattern: str, parts: tuple[str, ...] = ()) -> Column:
    """Case-insensitive search with Unicode letters and boundaries; null counts as no match.

    parts are small letters one of which any match holds: a text without them is not searched.
    """
    found = F.coalesce(c.rlike("(?iuU)" + pattern), F.lit(False))
    return F.coalesce(holds(c, parts), F.lit(False)) & found if parts else found


def holds(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether c holds one of the parts in any case; the long s counts as one."""
    return any_of(F.translate(F.lower(c), "ſ", "s"), parts)


def any_of(c: Column, words) -> Column:
    """Whether c holds one of the words as a substring."""
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words), F.lit(False))


def lookup(table: dict, key: Column) -> Column:
    """The table's value for key, null where it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Trimmed; empty and NULL in any case are null."""
    t = strip(c)
    return F.when((t != "") & (F.upper(t) != "NULL"), t)


def parse_float(c: Column) -> Column:
    """Apostrophes dropped, comma as point; what is no plain number is null."""
    t = F.translate(clean_text(c), ",'", ".")
    t = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t)
    return t.try_cast("double")


def half_even(c: Column) -> Column:
    """The nearest integer, halves to the even one."""
    return F.bround(c, 0).cast("int")


def parse_int(c: Column) -> Column:
    return half_even(parse_float(c))


def parse_bool(c: Column) -> Column:
    """Anything present that is no spelling of false counts as true."""
    t = F.lower(clean_text(c))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False).when(t.isNotNull(), True)


def truthy(c: Column) -> Column:
    """Of a JSON value as text: true, a number over 0, or a word for yes."""
    t = F.lower(strip(c))
    return F.coalesce(t.isin("true", "1", "yes", "y", "ja") | (F.coalesce(t.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), F.lit(False)) & (t.try_cast("double") > 0)), F.lit(False))


def tri_or(*flags: Column) -> Column:
    """True if any flag is; else false if any is; else null."""
    return F.greatest(*(f.cast("int") for f in flags), *([F.lit(None).cast("int")] * (len(flags) == 1))) == 1


def parse_date(c: Column) -> Column:
    """ISO, or day.month.year; anything else is null."""
    t = clean_text(c)
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")), F.when(t.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(t, "d.M.yyyy")))


def derive_price(gross: Column, price: Column, net: Column, extra: Column) -> Column:
    g, p, n, x = map(parse_int, (gross, price, net, extra))
    return F.coalesce(F.when(g > 0, g), F.when(p > 0, p), F.when(n > 0, n + F.coalesce(x, F.lit(0))))


def rooms_in(title: Column) -> Column:
    """The room count that a title names, null if none."""
    return F.replace(F.nullif(F.regexp_extract(title, "(?iu)" + V.ROOMS_IN_TITLE, 1), F.lit("")), F.lit(","), F.lit(".")).cast("double")


def markup_dropped(c: Column) -> Column:
    """Tags become blanks, stars go, runs of blanks and tabs become one; new lines stay."""
    return F.regexp_replace(F.replace(F.regexp_replace(c, r"<[^>]+>", " "), F.lit("*"), F.lit("")), r"[ \t]{2,}", " ")


def strip_markup(c: Column) -> Column:
    """Without markup, and trimmed."""
    return strip(markup_dropped(c))


def listing_id(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\.0$", "")


def slugify(c: Column, most: int = 60) -> Column:
    """Word characters of the lower-cased text, blanks and hyphens as one underscore; `query` if nothing is left."""
    t = F.regexp_replace(strip(F.regexp_replace(F.lower(c), r"(?U)[^\w\s-]", "")), r"(?U)[-\s]+", "_")
    return F.coalesce(F.nullif(F.left(t, F.lit(most)), F.lit("")), F.lit("query"))


def file_slug(c: Column, most: int = 60) -> Column:
    """Runs of other than word characters as one underscore."""
    return F.left(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", "_"), F.lit(most))


def image_key(path: Column) -> Column:
    """A `platform_id=` segment, `sred_` and the tile's listing, or the path itself."""
    segment = F.nullif(F.regexp_extract(path, r"(?:^|/)(platform_id=[^/]*)", 1), F.lit(""))
    tile = F.when(F.startswith(path, F.lit("sred/")), F.concat(F.lit("sred_"), F.element_at(F.split(F.element_at(F.split(path, "/"), -1), "_tile"), 1)))
    return F.coalesce(segment, tile, path)


def place_city(c: Column) -> Column:
    """Canonical city of a gazetteer's place: district suffixes stripped, then the map."""
    t = strip(F.regexp_replace(c, r"(?i)\s*\(Kreis\s*\d+\)|\s*/.*$", ""))
    return F.coalesce(lookup(V.PLACE_CITIES, F.lower(t)), t)


def canonical_city(c: Column) -> Column:
    """Canonical city of a search: district, then alias, else trimmed."""
    t = strip(c)
    return F.coalesce(lookup({k: v[0] for k, v in V.DISTRICTS.items()}, F.lower(t)), lookup(V.CITY_ALIASES, F.lower(t)), t)


def canonical_features(names: Column) -> Column:
    """Feature names of four languages as ours, in order, each once; unknown ones dropped; none left is null."""
    table = F.create_map(*(F.lit(x) for feature, words in V.FEATURE_SYNONYMS.items() for w in words for x in (w, feature)))
    known = F.array_distinct(F.array_compact(F.transform(names, lambda n: F.try_element_at(table, F.lower(n)))))
    return F.when(F.size(known) > 0, known)


def image_urls(images: Column) -> Column:
    """`images[].url` or plain strings of a JSON text, then `image_paths[]`; empty if there is none or the text is no JSON object."""
    own = F.from_json(images, "images array<string>, image_paths array<string>")
    urls = F.transform(F.coalesce(own["images"], F.array().cast("array<string>")), lambda x: F.when(F.startswith(F.ltrim(x), F.lit("{")), F.get_json_object(x, "$.url")).otherwise(x))
    return F.filter(F.concat(urls, F.coalesce(own["image_paths"], F.array().cast("array<string>"))), lambda u: u.isNotNull() & (u != ""))


def short(c: Column, most: int) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.concat(F.left(c, F.lit(most)), F.when(F.length(c) > most, "…").otherwise(""))


def judge_text(city, canton, category, rooms, area, price, offer, distances: list[tuple[str, Column]], features, title, description) -> Column:
    """A listing as a few lines for a judge; unknown values show as `?`."""
    or_mark = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    desc = reduce(lambda c, tag: F.replace(c, F.lit(tag), F.lit(" ")), ("<br />", "<br>", "<br/>", "<p>", "</p>"), F.coalesce(description, F.lit("")))
    desc = short(strip(F.regexp_replace(desc, r"(?U)\s+", " ")), 500)
    near = F.concat_ws(", ", *(F.concat(F.lit(f"{label}="), c.cast("string"), F.lit("m")) for label, c in distances))
    blank = lambda c, text: F.coalesce(F.nullif(c, F.lit("")), F.lit(text))
    return F.concat(
        F.lit("City: "), or_mark(city), F.lit(" ("), or_mark(canton), F.lit(")\nType: "), or_mark(category), F.lit(" | "), or_mark(rooms), F.lit(" rooms | "), or_mark(area), F.lit(" m² | CHF "), or_mark(price), F.lit("/mo | offer="), or_mark(offer),
        F.lit("\nDistances: "), blank(near, "(no POI distances)"), F.lit("\nFeatures: "), blank(F.concat_ws(", ", features), "none"), F.lit("\nTitle: "), blank(title, "(no title)"), F.lit("\nDesc: "), blank(desc, "(no description)"),
    )


def card_text(title, score, reason, price, rooms, area, street, postal_code, city, canton, available, features, distances: list[tuple[str, Column]], description, url, images) -> Column:
    """A result as a block of lines: headline, facts, distances, 300 characters of description, images by https."""
    show = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    near = F.concat_ws(", ", *(F.concat(F.lit(f"{label} "), c.cast("string"), F.lit("m")) for label, c in distances))
    https = F.filter(F.coalesce(images, F.array().cast("array<string>")), lambda u: F.startswith(u, F.lit("https://")))
    return F.concat(
        F.lit("Title: "), show(title), F.lit("\nScore: "), F.format_string("%.3f", score), F.lit(" ("), F.coalesce(reason, F.lit("")), F.lit(")\nPrice: CHF "), show(price), F.lit("/mo\nRooms: "), show(rooms), F.lit(" | Area: "), show(area), F.lit(" sqm\nAddress: "),
        show(street), F.lit(", "), show(postal_code), F.lit(" "), show(city), F.lit(", "), show(canton), F.lit("\nAvailable: "), show(available), F.lit("\nFeatures: "), F.coalesce(F.nullif(F.concat_ws(", ", features), F.lit("")), F.lit("none")),
        F.when(near != "", F.concat(F.lit("\nNearby (distance): "), near)).otherwise(""), F.lit("\nDescription: "), F.left(F.coalesce(description, F.lit("")), F.lit(300)), F.lit("\nListing URL: "), show(url),
        F.when(F.size(https) > 0, F.concat(F.lit("\nImage URLs:\n  "), F.concat_ws("\n  ", https))).otherwise(""),
    )
