"""Explicit schemas; nothing is inferred."""

COORDINATES = "struct<lat:double,long:double>"
EVENT = f"id string, name string, imageUrl string, venue string, coordinates {COORDINATES}, dates array<string>, displayDate string, url string, source string, eventType string, long_description string, description string, labels array<string>"
FEED = f"events array<struct<{','.join(f.strip().replace(' ', ':', 1) for f in EVENT.split(', '))}>>, filters struct<sources:array<string>,eventTypes:array<string>>"
RAW_LISTING = f"seq long, source string, url string, category string, name string, image string, venue string, date_texts array<string>, description string, coordinates {COORDINATES}, card string, info string, slot string"
FRONTIER = "url string, category string, image string, multiple_dates boolean"
TRAINING = "description string, label string, skip boolean, new boolean"
KID_FRIENDLY = "description string, skip boolean, kid_friendly boolean"
FESTIVAL = "id string, name string, icon string, url string"
BURGER = "id string, name string, image string, description string, price double, beerMatchPrice double, availableForLunch boolean, availableForDinner boolean, beerMatch string, mainProtein string, sidesIncluded boolean"
