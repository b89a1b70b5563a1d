"""What is particular to each source, as data: frontier shape, categories, dates, venues, exclusions.

Pages are fetched elsewhere; these profiles turn raw listings (schemas.RAW_LISTING) of a source
into events. Each source is registered as a reader of raw listings in Parquet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import dates, text
from gleaner.functions.date_grammar import bound, free_dates
from gleaner.functions.elements import Find, attribute_of, elements, find_all, find_first, text_of
from gleaner.operators.filters import is_closed, mentions, not_past
from gleaner.sources import schemas
from gleaner.sources.readers import reader

DAY_FORMATS = ["d MMM yyyy h:mma", "d MMMM yyyy h:mma", "d MMM yyyy", "d MMMM yyyy", "d MMM h:mma", "d MMMM h:mma", "d MMM", "d MMMM", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd-HH:mm", "yyyy-MM-dd"]


@dataclass(frozen=True)
class Layout:
    """Where a page has what. A field takes its first selector that any element fits.

    ``gone``: an element that means there is no listing. ``image``: the element with the image, in
    src or as a style's url. ``venue_line`` and ``dates_line`` take one line of the element's text;
    ``venue_joined`` joins all venues with commas, ``venue_cut`` ends the venue. ``dates_all`` has a
    text for each of the elements instead of the first one's lines, ``dates_attribute`` an attribute
    of each, ``dates_index`` only one of them, ``dates_cut`` what follows the mark. ``clocks`` are
    times that go with the dates one by one; ``one_clock``, if there is such an element, goes with
    the first date and is all there is. ``more``: where the first selector fits, the second one's
    elements are the dates. ``calendar``: (months of days, month, day, time) of a calendar.
    ``labelled``: (block, date's label, venue's label), each followed by a line with the value.
    ``panel``: a block that runs on without lines: name, Date, dates, Venue, venue. ``header``: a
    block of lines of which the third is the date and the fifth the venue."""

    name: tuple[Find, ...] = (Find("h1"),)
    venue: tuple[Find, ...] = (Find("div", css="venue"),)
    dates: tuple[Find, ...] = (Find("div", css="dates"),)
    category: tuple[Find, ...] = (Find("span", css="category"),)
    description: tuple[Find, ...] = (Find("article"),)
    card: tuple[Find, ...] = (Find("div", css="card"),)
    info: tuple[Find, ...] = (Find("div", css="info"),)
    slot: tuple[Find, ...] = (Find("div", css="slot"),)
    image: tuple[Find, ...] = (Find("img"),)
    gone: tuple[Find, ...] = ()
    name_line: int | None = None
    venue_line: int | None = None
    venue_joined: bool = False
    venue_cut: str | None = None
    dates_line: int | None = None
    dates_all: bool = False
    dates_attribute: str | None = None
    dates_index: int | None = None
    dates_cut: str | None = None
    slot_pattern: str | None = None
    clocks: Find | None = None
    one_clock: Find | None = None
    more: tuple[Find, Find] | None = None
    calendar: tuple[Find, Find, Find, Find] | None = None
    labelled: tuple[Find, str, str] | None = None
    panel: tuple[Find, ...] | None = None
    header: Find | None = None


GIG_PAGE = Layout(name=(Find("h1", css="display_title_1"),), header=Find("div", css="col-md-9"), info=(Find("div", css="gig-guide-side-bar"),), description=(Find("div", css="description"),))

#: The sources' own tags, classes, ids and attributes.
EVENT_BRITE = Layout(
    name=(Find("h1", attribute_part=("data-testid", "event-title")),),
    venue=(Find("a", attribute_part=("data-testid", "event-venue")),),
    dates=(Find("div", attribute=("data-testid", "event-datetime")), Find("p", css_part="EventInfoCard-module__dateWrapper")),
    description=(Find("div", css_part="AboutThisEventEmbedded_container"), Find("div", attribute_part=("data-testid", "section-wrapper-overview")), Find("div", css_part="Overview_summary")),
    image=(Find("img", attribute=("data-testid", "hero-img")),),
    info=(Find("div", css_part="EventSignalsBar_signals"),),
    card=(Find("div", attribute=("data-testid", "search-event")),),
    calendar=(
        Find("div", css_part="Stack_root", inside=Find("div", attribute=("data-testid", "calendar-container"))),
        Find("p", css_part="CompactCalendar-module__monthName"), Find("p", css_part="CompactCalendar-module__dateText"), Find("p", css_part="CompactCalendar-module__timeSlotText"),
    ),
)
EVENT_FINDER = Layout(
    name=(Find(css="value-title"),), venue=(Find(css="venue"),), description=(Find(css="description"),), image=(Find(css="photo"),),
    dates=(Find("time", inside=Find(css="sessions-info")),), dates_attribute="datetime",
)
ALL_EVENTS_IN = Layout(
    name=(Find(css="eps-heading-1"),), venue=(Find("p", css_part="event-location"),), venue_joined=True, dates=(Find("p", css_part="event-time-label"),),
    description=(Find("div", css_part="event-description"),), image=(Find(css="event-banner"),), gone=(Find("span", says="Event Ended"),),
)
HUMANITIX = Layout(
    name=(Find(css="titlewrapper"),), name_line=0, venue=(Find(css="address", inside=Find(css="EventLocation")), Find(css="address")), venue_line=1, venue_cut="  ·  ",
    dates=(Find(css="datetime"), Find("div", css_part="datetime")), dates_line=0, more=(Find("button", says="more dates"), Find("li", inside=Find("form"), of_first=True)),
    description=(Find(css="RichContent"),), image=(Find("img", inside=Find(css="banner")),),
)
TICKETEK = Layout(
    name=(Find(css="sectionHeading"),), venue=(Find(css="selectVenueBlock"),), venue_line=1, dates=(Find(css="selectDateBlock"),), dates_line=1,
    description=(Find(css="info-details"),), image=(Find(css="desktop-tablet-banner"),), gone=(Find("p", css_part="alert-warning", says="unavailable"),),
)
TICKET_MASTER = Layout(panel=(Find("section", attribute=("data-testid", "panel")), Find("div", css_part="SidePanel__StyledContent")), image=(Find("img", attribute_part=("src", "EVENT_DETAIL_PAGE")),))
FRINGE = Layout(
    name=(Find("h2", css_part="primary-color"),), venue=(Find("div", css_part="addres-pin"),), dates=(Find("li", inside=Find(css="schedule"), of_first=True),), dates_all=True, dates_index=2,
    slot=(Find(css="schedule"),), slot_pattern=r"\d{1,2}:\d{1,2}", description=(Find("div", css_part="content"),), image=(Find("img", css_part="event-image-square"),),
)
ROXY = Layout(
    name=(Find(css="single-movie__title"),), dates=(Find(css="single-session__date", inside=Find(css="single-session")),), dates_all=True, dates_cut=" | ", slot=(Find(css="time-slot__time"),),
    description=(Find(css="single-movie__description"),), image=(Find("img", inside=Find("div", css_part="sticky-inner-wrapper"), of_first=True),),
)
VALHALLA = Layout(
    name=(Find(css_part="eventitem-title"),), dates=(Find(css="event-date"),), dates_all=True, clocks=Find(css="eventitem-meta-time"), one_clock=Find(css="event-time-localized-start"),
    description=(Find(css="sqs-html-content"),),
)
HIGH_SCHOOL = Layout(name=(Find(css="page-title"),), dates=(Find("div", css_part="event ", inside=Find(css="event-list")),), dates_all=True, image=(Find(css="image-hero"),), description=(Find(css="content-field-text"),))
CITY_GUIDE = Layout(
    name=(Find("h1", css_part="image-header__title"),), labelled=(Find("section", css_part="image-header__details--layout-listing"), "DATE", "VENUE"),
    description=(Find(css="typography"), Find(css="image-header__intro")), image=(Find("img", css_part="site-picture__img"),),
)


@dataclass(frozen=True)
class Profile:
    """``dates``: "free" (all dates of the texts), "daily" (dates joined by a range mark are all days
    between), "list" (a date a text), "span" (texts name a range), "relative" (Today, weekdays),
    "pair" (start and end), "gig" (day and month, the time from the side bar), "both" (day, month and
    time or nothing), "sessions" (starts to the minute). ``slotted``: the page's slot goes with each
    of the dates. ``halves`` False ignores am and pm, ``clocked`` takes only dates with a time,
    ``bump`` moves past years to this one, ``title_dates`` are those of the name where there are no
    others. ``constant`` values replace what the pages lack. ``card``: sold-out and short cards are
    dropped. ``bans_undated``: listings without a date to come are banned, not only left out.
    ``drops_past``: a listing whose last date is past is dropped, not banned. ``doors``: the doors'
    time stands in for a start time. ``no_time``: times aren't readable. ``venue_label``: the venue
    is the line after this one. ``excluded`` words are looked for in venues, ``excluded_text`` in
    descriptions."""

    name: str
    shape: str = "url_category"
    dates: str = "list"
    category: str | None = None
    venue: str | None = None
    match_title: bool = False
    excluded: tuple[str, ...] = ()
    excluded_text: tuple[str, ...] = ()
    required_city: bool = False
    add_city: bool = False
    keeps_history: bool = True
    zone_tag: str | None = None
    slotted: bool = False
    halves: bool = True
    clocked: bool = False
    bump: bool = False
    title_dates: bool = False
    bans_undated: bool = False
    card: bool = False
    drops_past: bool = False
    doors: str | None = None
    no_time: bool = False
    venue_label: str | None = None
    clean_title: bool = False
    layout: Layout = Layout()


PROFILES = {
    p.name: p
    for p in (
        Profile("Event Brite", dates="free", excluded=("leadflake",), excluded_text=("copyright",), card=True, bump=True, title_dates=True, bans_undated=True, layout=EVENT_BRITE),
        Profile("Facebook", dates="relative", drops_past=True, bans_undated=True),
        Profile("Event Finder", dates="daily", bump=True, layout=EVENT_FINDER),
        Profile("All Events In", shape="category_url", dates="free", match_title=True, zone_tag="nzst", layout=ALL_EVENTS_IN),
        Profile("Humanitix", shape="url_category_multiple", dates="free", bans_undated=True, layout=HUMANITIX),
        Profile("Ticketek", dates="free", required_city=True, no_time=True, bans_undated=True, layout=TICKETEK),
        Profile("Ticket Master", dates="free", match_title=True, clocked=True, bans_undated=True, layout=TICKET_MASTER),
        Profile("Under The Radar", shape="url", category="Music & Concerts", dates="gig", doors="Doors open", bans_undated=True, layout=GIG_PAGE),
        Profile("Rogue & Vagabond", shape="url", category="Music & Concerts", venue="Rogue & Vagabond", dates="gig", layout=GIG_PAGE),
        Profile("San Fran", shape="url", category="Music & Concerts", venue="San Fran", clean_title=True),
        Profile("Valhalla", shape="url_image", category="Music & Concerts", venue="Valhalla", dates="pair", bans_undated=True, layout=VALHALLA),
        Profile("High School", venue="High School", dates="both", bans_undated=True, layout=HIGH_SCHOOL),
        Profile("City Guide", dates="span", add_city=True, bans_undated=True, layout=CITY_GUIDE),
        Profile("Burger Festival", category="Food & Drink", keeps_history=False, dates="sessions"),
        Profile("Roxy", category="Film & Media", venue="Roxy Cinema", dates="free", slotted=True, layout=ROXY),
        Profile("Heritage Festival", category="Community & Culture", dates="span"),
        Profile("Fringe", category="Arts & Theatre", dates="daily", slotted=True, halves=False, layout=FRINGE),
    )
}


def parsed_dates(texts: Column, profile: Profile, asof: Column, info: Column, slot: Column, name: Column) -> Column:
    """An array of timestamps; texts without a date give nothing."""
    year, rule = F.year(asof), profile.dates
    clean = lambda t: F.trim(F.regexp_replace(text.drop_ordinals(t), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+", ""))
    one = lambda t: dates.parse_any(clean(t), DAY_FORMATS, year)
    if rule in ("free", "daily"):
        if profile.slotted:
            texts = bound(slot, lambda s: F.transform(texts, lambda t: F.concat_ws(" ", t, s)))
        how = {"daily": rule == "daily", "tag": profile.zone_tag, "halves": profile.halves, "bump": profile.bump, "clocked": profile.clocked}
        found = F.flatten(F.transform(texts, lambda t: free_dates(t, asof, **how)))
    elif rule == "relative":
        found = F.flatten(F.transform(texts, lambda t: dates.relative_dates(t, asof)))
    elif rule == "span":
        ranges = F.transform(texts, lambda t: dates.span_dates(clean(t)))
        found = F.flatten(F.transform(ranges, lambda r: F.when(r["start"] < r["end"], dates.date_range(r["start"], r["end"], asof)).otherwise(F.array(r["start"]))))
        found = bound(F.array_compact(found), lambda x: F.when(F.size(x) > 0, x).otherwise(F.transform(texts, one)))
    elif rule == "pair":
        found = bound(F.transform(texts, lambda t: F.coalesce(one(t), F.get(free_dates(t, asof), 0))), lambda x: F.when(F.size(x) > 1, dates.start_and_end(F.get(x, 0), F.get(x, 1))).otherwise(x))
    elif rule == "gig":
        words = F.split(F.substring_index(F.get(texts, 0), ",", 1), " ")
        found = F.array(dates.parse_any(F.concat_ws(" ", F.get(words, 1), F.get(words, 2), text.gig_time(info, doors=profile.doors)), ["d MMM h:mma", "d MMMM h:mma"], year))
    elif rule == "both":
        found = F.transform(texts, lambda t: dates.day_and_time(t, year))
    elif rule == "sessions":
        found = F.transform(texts, lambda t: F.date_trunc("MINUTE", one(t)))
    else:
        found = F.transform(texts, one)
    found = F.array_distinct(F.array_compact(found))
    if profile.title_dates:
        found = bound(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array_distinct(free_dates(name, asof))))
    return found


def listings_from_pages(pages: DataFrame, profile: Profile) -> DataFrame:
    """RAW_LISTING rows of a source from its rendered pages (page_id, url, html)."""
    page, html, tree = profile.layout, F.col("html"), F.col("_tree")
    rows = pages.select("page_id", "url", "html", elements(F.col("html")).alias("_tree"))
    if page.gone:
        rows = rows.where(find_first(html, tree, *page.gone).isNull())  # the tree is made once, below the filter
    nothing = F.array().cast("array<string>")
    part = lambda where: F.nullif(text_of(html, find_first(html, tree, *where)), F.lit(""))
    lines = lambda t: F.coalesce(F.split(t, "\n"), nothing)
    texts = lambda found: F.transform(found, lambda e: text_of(html, e))
    every = lambda where: texts(find_all(html, tree, where))
    line = lambda t, n: t if n is None else F.get(lines(t), n)
    name, venue = line(part(page.name), page.name_line), part(page.venue)
    if page.venue_line is not None:
        venue = F.coalesce(line(venue, page.venue_line), part(page.venue[-1:]))
    if page.venue_joined:
        venue = bound(every(page.venue[0]), lambda x: F.when(F.contains(F.get(x, 1), F.get(x, 0)), F.get(x, 0)).otherwise(F.array_join(x, ",")))
    if page.venue_cut:
        venue = F.substring_index(venue, page.venue_cut, 1)
    if page.dates_attribute:
        when = F.array_compact(F.transform(find_all(html, tree, page.dates[0]), lambda e: attribute_of(e, page.dates_attribute)))
    elif page.dates_all:
        when = F.coalesce(*[F.nullif(every(f), nothing) for f in page.dates], nothing)
    elif page.dates_line is not None:
        when = F.array_compact(F.array(line(part(page.dates), page.dates_line)))
    else:
        when = lines(part(page.dates))
    if page.dates_index is not None:
        when = F.array_compact(F.array(F.get(when, page.dates_index)))
    if page.dates_cut:
        when = F.transform(when, lambda t: F.substring_index(t, page.dates_cut, -1))
    if page.clocks:
        paired = lambda ds: F.array_compact(F.zip_with(ds, every(page.clocks), lambda d, c: F.concat(d, F.lit(" "), c)))
        when = bound(when, lambda ds: bound(part((page.one_clock,)), lambda c: F.when(c.isNotNull(), F.array(F.concat(F.get(ds, 0), F.lit(" "), c))).otherwise(paired(ds))))
    if page.more:
        when = F.when(find_first(html, tree, page.more[0]).isNotNull(), every(page.more[1])).otherwise(when)
    if page.calendar:
        days = _calendar(html, tree, page.calendar)
        when = bound(F.array_join(when, "\n"), lambda t: F.when(F.contains(t, F.lit("Multiple dates")), days).otherwise(F.array(t)))
    if page.labelled:
        rows = rows.withColumn("_block", part(page.labelled[:1]))
        when, venue = F.array_compact(F.array(text.value_after(F.col("_block"), page.labelled[1]))), text.value_after(F.col("_block"), page.labelled[2])
    if page.panel:
        rows, run = rows.withColumn("_run", F.regexp_replace(part(page.panel), r"\s+", " ")), F.col("_run")
        name, venue, when = F.regexp_extract(run, r"^(?:Back)? ?(?:Event Info)? ?(.*?) ?Date", 1), F.regexp_extract(run, r"Venue ?(.*?) ?(?:Please|$)", 1), F.array_compact(F.array(run))
    if page.header:
        rows, block = rows.withColumn("_block", lines(part((page.header,)))), F.col("_block")
        when, venue = F.array_compact(F.array(F.get(block, 2))), F.get(block, 4)
    slot = part(page.slot)
    if page.slot_pattern:
        slot = F.element_at(F.nullif(F.regexp_extract_all(slot, F.lit(f"({page.slot_pattern})"), 1), nothing), -1)
    rows, picture = rows.withColumn("_picture", find_first(html, tree, *page.image)), F.col("_picture")
    style = text.css_url(text.attribute(html, "[a-z]+", "style"))
    return rows.select(
        F.col("page_id").cast("long").alias("seq"), F.lit(profile.name).alias("source"), "url", part(page.category).alias("category"), name.alias("name"),
        F.coalesce(F.nullif(attribute_of(picture, "src"), F.lit("")), F.nullif(text.css_url(attribute_of(picture, "style")), F.lit("")), F.nullif(style, F.lit(""))).alias("image"),
        venue.alias("venue"), when.alias("date_texts"), part(page.description).alias("description"),
        F.lit(None).cast(schemas.COORDINATES).alias("coordinates"), part(page.card).alias("card"), part(page.info).alias("info"), slot.alias("slot"),
    )


def _calendar(html: Column, tree: Column, calendar: tuple[Find, Find, Find, Find]) -> Column:
    """Texts "month day time" of a calendar's sections; a section without a month has the last one's."""
    section, *parts = calendar
    found = F.struct(find_all(html, tree, section).alias("section"), *[find_all(html, tree, f).alias(k) for k, f in zip(("month", "day", "time"), parts, strict=True)])

    def texts(f: Column) -> Column:
        within = lambda s, k: text_of(html, F.get(F.filter(f[k], lambda e: (s["start"] < e["start"]) & (e["start"] <= s["last"])), 0))
        said = F.transform(f["section"], lambda s: F.struct(*[within(s, k).alias(k) for k in ("month", "day", "time")]))

        def joined(rows: Column) -> Column:
            month = lambda i: F.element_at(F.nullif(F.array_compact(F.slice(F.transform(rows, lambda x: x["month"]), 1, i + 1)), F.array().cast("array<string>")), -1)
            return F.array_compact(F.transform(rows, lambda x, i: F.concat(month(i), F.lit(" "), x["day"], F.lit(" "), F.coalesce(x["time"], F.lit("")))))

        return bound(said, joined)

    return bound(found, texts)


def judged(raw: DataFrame, profile: Profile, asof: Column, city: str) -> DataFrame:
    """A source's raw listings with their ``dates`` and with ``_out``: true for those to ban, null for those that are left out.

    Listings with an excluded word or elsewhere are banned, those without a readable date by the
    sources that ban such; other undated ones, closed ones (by their status line) and those that a
    source drops are left out and may come again.
    """
    rows = raw.where(F.col("source") == profile.name)
    if profile.card:
        rows = rows.where(F.col("card").isNull() | text.card_lines(F.col("card")).isNotNull())
    if profile.dates != "gig":
        rows = rows.where(~F.coalesce(is_closed(F.col("info")), F.lit(False)))
    venue = text.value_after(F.col("info"), profile.venue_label) if profile.venue_label else F.col("venue")
    venue = F.lit(profile.venue) if profile.venue else F.coalesce(venue, F.col("venue"))
    venue = text.with_city(venue, city) if profile.add_city else venue
    rows = rows.withColumns({"venue": venue, "category": F.lit(profile.category) if profile.category else F.coalesce("category", F.lit("Other"))})
    if profile.clean_title:
        rows = rows.withColumn("name", text.clean_name(F.col("name")))
    out = F.lit(False)
    if profile.excluded:
        out = out | F.coalesce(mentions(F.col("venue"), *profile.excluded), F.lit(False))
    if profile.excluded_text:
        out = out | F.coalesce(mentions(F.col("description"), *profile.excluded_text), F.lit(False))
    if profile.required_city:
        out = out | ~F.coalesce(mentions(F.col("venue"), city), F.lit(False))
    found = parsed_dates(F.col("date_texts"), profile, asof, F.col("info"), F.col("slot"), F.col("name"))
    if profile.no_time:
        found = F.transform(found, lambda d: F.date_trunc("DAY", d) + F.make_dt_interval(F.lit(0), F.lit(1), F.lit(1)))
    rows = rows.withColumn("dates", F.sort_array(found))
    if profile.drops_past:
        rows = rows.where(not_past(F.col("dates"), asof))
    dated = F.size("dates") > 0
    return rows.withColumn("_out", out | ~dated if profile.bans_undated else F.when(out, F.lit(True)).when(dated, F.lit(False)))


def to_events(raw: DataFrame, profile: Profile, asof: Column, city: str) -> tuple[DataFrame, DataFrame]:
    """(events, urls to ban) of a source's raw listings, as ``judged``."""
    rows = judged(raw, profile, asof, city)
    events = rows.where(~F.col("_out")).select(
        "seq", text.event_id(F.col("name"), F.col("venue"), F.col("source")).alias("id"), "name", F.col("image").alias("imageUrl"), "venue", "coordinates",
        "dates", "url", "source", F.col("category").alias("eventType"), F.col("description").alias("long_description"), text.html_to_text(F.col("description")).alias("description"),
    )
    return events, rows.where("_out").select("source", "url")


def _register(name: str) -> None:
    @reader(name)
    def read(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(schemas.RAW_LISTING).parquet(path).where(F.col("source") == name)


for _name in PROFILES:
    _register(_name)
