"""Text, name, url and price columns of listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The entities decoded by html_to_text.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def event_id(name: Column, venue: Column, source: Column) -> Column:
    """name-venue-source; a missing part reads None, as no part may vanish silently."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(part(name), F.lit("-"), part(venue), F.lit("-"), part(source))


def html_to_text(html: Column) -> Column:
    """Markup without script, style and comments becomes trimmed non-blank lines; null becomes empty."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    body = F.regexp_replace(body, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|footer|header|nav|title|head|body|html)(\s[^>]*)?/?>", "\n")
    body = F.regexp_replace(body, r"<[^>]*>", "")
    for entity, char in ENTITIES.items():
        body = F.replace(body, F.lit(entity), F.lit(char))
    lines = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"^[\s\x{A0}]+|[\s\x{A0}]+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def cut_at(text: Column, *markers: str) -> Column:
    """What stands before the first of the literal markers."""
    for marker in markers:
        text = F.substring_index(text, marker, 1)
    return text


def training_description(name: Column, long_description: Column) -> Column:
    return F.concat(name, F.lit(", "), long_description)


def title_of(description: Column) -> Column:
    """Text before the first comma."""
    return F.substring_index(description, ",", 1)


def skip_flag(description: Column, *boilerplates: str, least: int = 110) -> Column:
    """Too short, or holding one of the boilerplates, or too short without what one matches as a pattern."""
    out = F.length(description) < least
    for b in boilerplates:
        out = out | F.contains(description, F.lit(b)) | (F.length(F.regexp_replace(description, b, "")) < least)
    return out


def confidence_text(p: Column) -> Column:
    return F.format_string("Confidence: %.2f%%", p * 100)


def clean_name(name: Column) -> Column:
    """Runs of characters that aren't Unicode word characters become a blank; trimmed."""
    return F.trim(F.regexp_replace(name, r"(?U)\W+", " "))


def camel_slug(label: Column) -> Column:
    """& becomes And, blanks and commas go, the first letter is lower-cased."""
    s = F.translate(F.replace(label, F.lit("&"), F.lit("And")), " ,", "")
    return F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20))


def display_name(label: Column) -> Column:
    """Title case, also after apostrophes and hyphens."""
    parts = F.regexp_extract_all(F.lower(label), F.lit(r"(?U)(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, F.initcap), "")


def dash_slug(label: Column) -> Column:
    return F.replace(F.lower(label), F.lit(" "), F.lit("-"))


def drop_ordinals(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)(\d+)(st|nd|rd|th)", "$1")


def rich_text(raw: Column) -> Column:
    """Values of a JSON document tree, one nested level deep, each on a line."""
    inner = "struct<value:string>"
    tree = F.from_json(raw, f"struct<content:array<struct<value:string,content:array<{inner}>>>>")
    values = lambda node: F.concat(F.array(node["value"]), F.coalesce(F.transform(node["content"], lambda x: x["value"]), F.array().cast("array<string>")))
    return F.array_join(F.filter(F.flatten(F.transform(tree["content"], values)), lambda v: v.isNotNull()), "\n")


def meal_available(lunch: Column, dinner: Column) -> Column:
    return F.when(lunch & dinner, "Lunch & Dinner").when(lunch, "Lunch").otherwise("Dinner")


def dietary(*pairs: tuple[str, Column, Column]) -> Column:
    """Labels, in the order given, of pairs of which a flag is set."""
    return F.array_compact(F.array(*[F.when(F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), F.lit(name)) for name, a, b in pairs]))


def protein_text(protein: Column) -> Column:
    """Without what stands in parentheses; commas get a blank."""
    return F.replace(F.trim(F.regexp_replace(protein, r"\(.*\)", "")), F.lit(","), F.lit(", "))


def venue_line(name: Column, *address: Column) -> Column:
    return F.concat_ws(", ", name, *address)


def with_city(venue: Column, city: str) -> Column:
    """The city is added to venues that don't mention it; empty ones stay empty."""
    return F.when((venue != "") & ~F.contains(F.lower(venue), F.lit(city.lower())), F.concat(venue, F.lit(f", {city}"))).otherwise(venue)


def css_url(style: Column) -> Column:
    return F.regexp_extract(style, r"""url\(["']?([^"')]+)["']?\)""", 1)


def canonical_url(url: Column, pattern: str) -> Column:
    """The part of a url that matches; null if none does."""
    found = F.regexp_extract(url, pattern, 0)
    return F.when(found != "", found)


def image_expiry(image_url: Column) -> Column:
    """The time in an image's ``oe=`` parameter, a hex epoch; null without one."""
    code = F.regexp_extract(image_url, r"[?&]oe=([0-9A-Fa-f]+)", 1)
    return F.when(code != "", F.timestamp_seconds(F.conv(code, 16, 10).cast("long")))


def value_after(text: Column, label: str, last: bool = False) -> Column:
    """The first line after a line that contains a label, or the ``last``, that doesn't contain it itself; null if there is none."""
    lines = F.split(text, "\n")
    has = lambda x: F.contains(x, F.lit(label))
    at = F.array_position(F.transform(lines, has), True).cast("int")
    after = F.filter(F.slice(lines, at + 1, F.size(lines)), lambda x: ~has(x))
    return F.when(at > 0, F.try_element_at(after, F.lit(-1 if last else 1)))


def gig_time(text: Column, start: str = "GIG STARTS", doors: str | None = "Doors open") -> Column:
    """The start time in a side bar of labels and values; else what follows the doors' label; else 1:01AM."""
    tries = [value_after(text, start)] + ([value_after(text, doors, last=True)] if doors else [])
    return F.coalesce(*tries, F.lit("1:01AM"))


#: Status lines of cards that can't be visited, and tag lines that say nothing.
SOLD_TAGS = ("Sold Out", "Sales Ended", "Unavailable", "Sales ended")
CARD_TAGS = ("Sales end soon", "Selling quickly", "Nearly full", "Just added", "Not Yet On Sale")


def card_lines(card: Column, least: int = 3) -> Column:
    """A card's lines without a tag in front; null if it is sold out or has fewer than ``least``."""
    lines = F.split(card, "\n")
    first = F.get(lines, 0)
    lines = F.when(first.isin(*CARD_TAGS), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    return F.when(~first.isin(*SOLD_TAGS) & (F.size(lines) >= least), lines)


def texts_within(html: Column, least: int = 1) -> Column:
    """The texts of an element tree in the order of its leaves, those of at least ``least`` characters."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    leaves = F.transform(F.split(bare, r"<[^>]*>"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(leaves, lambda x: F.length(x) >= least)


def element_text(html: Column, tag: str, css_class: str | None = None) -> Column:
    """The inner markup of the first element of a tag (and a class) that has no element of that tag inside; empty if there is none."""
    named = rf"""[^>]*class=["'][^"']*\b{css_class}\b[^"']*["'][^>]*""" if css_class else r"(?:\s[^>]*)?"
    return F.regexp_extract(html, rf"(?is)<{tag}{named}>((?:(?!</?{tag}[\s>]).)*+)</{tag}>", 1)


def attribute(html: Column, tag: str, name: str) -> Column:
    """An attribute of the first element of a tag that has it; empty if none has."""
    return F.regexp_extract(html, rf"""(?is)<{tag}\s[^>]*\b{name}=["']([^"']*)["']""", 1)


#: What is removed from addresses, as patterns, ``city`` and ``country`` filled in.
ADDRESS_CLEANUPS = (
    r" - Mana",
    r"(\d+\s*st|\d+\s*th)\s*[fF]{1}loor",
    r"(\d+\s*st|\d+\s*th)\s*[Ll]{1}evel",
    r"#?[Ll](?:evel)?\s?(\d+)|\s*#(\d+)",
    r", {city} \d{{4}}",
    r", {country}",
)


def address_variants(address: Column, city: str, country: str) -> Column:
    """Ways to look an address up, best first.

    The cleaned address; what follows its first part, alone and with the place; the address with
    the place; what precedes its last two parts. An address of several parts without a digit is
    also tried as number 1, each variant right after itself. Empty variants are left out.
    """
    for pattern in ADDRESS_CLEANUPS:
        address = F.regexp_replace(address, pattern.replace("{city}", city).replace("{country}", country).replace("{{4}}", "{4}"), "")
    place = f", {city}, {country}"
    once = lambda value, body: F.transform(F.array(value), body)[0]

    def tries(address: Column, parts: Column) -> Column:
        cut = lambda first, n: F.nullif(F.trim(F.array_join(F.slice(parts, first, F.greatest(n, F.lit(0))), ",")), F.lit(""))
        listed = lambda rest: F.array_compact(F.array(address, rest, F.concat(rest, F.lit(place)), F.concat(address, F.lit(place)), cut(1, F.size(parts) - 2)))
        unnumbered = (F.size(parts) > 1) & ~address.rlike("[0-9]")
        numbered = lambda found: F.when(unnumbered, F.flatten(F.transform(found, lambda v: F.array(v, F.concat(F.lit("1 "), v))))).otherwise(found)
        return once(once(cut(2, F.size(parts) - 1), listed), numbered)

    return once(address, lambda a: once(F.split(a, ","), lambda parts: tries(a, parts)))
