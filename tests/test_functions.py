"""Text and date functions on small inline rows, with the edge cases of real listings."""

from gleaner.functions import dates, text
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]))
    return row.select(column.alias("x")).first()["x"]


def asof():
    return F.lit("2024-01-17 10:30:45").cast("timestamp")  # a Wednesday



def ts(s):
    return F.lit(s).cast("timestamp")


def test_event_id_keeps_missing_parts(spark):
    assert one(spark, text.event_id(F.lit("a"), F.lit(None).cast("string"), F.lit("s"))) == "a-None-s"


def test_html_drops_scripts_before_tags(spark):
    html = '<p>One</p><script>var t="</p>";</script><style>p{}</style>  <div>Two &amp; three<br>four</div><!-- no -->'
    assert one(spark, text.html_to_text(F.lit(html))) == "One\nTwo & three\nfour"
    assert one(spark, text.html_to_text(F.lit(None).cast("string"))) == ""


def test_cut_and_title(spark):
    assert one(spark, text.cut_at(F.lit("abc--def~~ghi"), "~~", "--")) == "abc"
    assert one(spark, text.cut_at(F.lit("--all gone"), "--")) == ""
    assert one(spark, text.title_of(F.lit("no comma"))) == "no comma"


def test_skip_flag_lengths(spark):
    for n, want in ((109, True), (110, False), (111, False)):
        assert one(spark, text.skip_flag(F.lit("𝒳" * n), "zz")) is want
    assert one(spark, text.skip_flag(F.lit("a" * 120 + "b.c"), "b.c")) is True
    assert one(spark, text.skip_flag(F.lit("a" * 105 + "bXcbXc"), "b.c")) is True


def test_names(spark):
    assert one(spark, text.clean_name(F.lit("  Āpirana--& co! "))) == "Āpirana co"
    assert one(spark, text.camel_slug(F.lit("Food & Drink, Etc"))) == "foodAndDrinkEtc"
    assert one(spark, text.display_name(F.lit("o'neil's JAZZ-night"))) == "O'Neil'S Jazz-Night"
    assert one(spark, text.dash_slug(F.lit("Doc Edge Fest"))) == "doc-edge-fest"
    assert one(spark, text.drop_ordinals(F.lit("1st and 22ND of May"))) == "1 and 22 of May"


def test_rich_text_and_burgers(spark):
    raw = '{"content":[{"value":"a"},{"content":[{"value":"b"},{"value":"c"}]}]}'
    assert one(spark, text.rich_text(F.lit(raw))) == "a\nb\nc"
    assert one(spark, text.meal_available(F.lit(False), F.lit(False))) == "Dinner"
    assert one(spark, text.dietary(("x", F.lit(None).cast("boolean"), F.lit(True)), ("y", F.lit(False), F.lit(None).cast("boolean")))) == ["x"]
    assert one(spark, text.protein_text(F.lit("beef (wagyu) ,pork (x)"))) == "beef"
    assert one(spark, text.protein_text(F.lit("beef,pork"))) == "beef, pork"


def test_places(spark):
    assert one(spark, text.with_city(F.lit("Town Hall"), "Metro")) == "Town Hall, Metro"
    assert one(spark, text.with_city(F.lit("METRO Hall"), "Metro")) == "METRO Hall"
    assert one(spark, text.with_city(F.lit(""), "Metro")) == ""
    assert one(spark, text.css_url(F.lit("background: url('http://x/y.png') no-repeat"))) == "http://x/y.png"
    assert one(spark, text.canonical_url(F.lit("https://f.com/events/123/?a"), r"events/\d+")) == "events/123"
    assert one(spark, text.canonical_url(F.lit("nothing"), r"events/\d+")) is None
    assert one(spark, text.image_expiry(F.lit("https://x/i.jpg?oe=65A00000&z"))).timestamp() == 0x65A00000
    assert one(spark, text.value_after(F.lit("Doors\n7pm\nStart\n8pm"), "Start")) == "8pm"
    assert one(spark, text.value_after(F.lit("a\nThe GIG STARTS at\nGIG STARTS\n8pm\n9pm"), "GIG STARTS")) == "8pm"
    assert one(spark, text.gig_time(F.lit("Doors open\n6pm\nx\n7pm"))) == "7pm"
    assert one(spark, text.gig_time(F.lit("Doors open\n6pm"), doors=None)) == "1:01AM"
    assert one(spark, text.card_lines(F.lit("Sold Out\na\nb\nc"))) is None and one(spark, text.card_lines(F.lit("Just added\na\nb"))) is None
    assert one(spark, text.card_lines(F.lit("Just added\na\nb\nc"))) == ["a", "b", "c"]
    assert one(spark, text.texts_within(F.lit("<div>a <b>bold  word</b><script>x</script>c</div>"), 2)) == ["bold word"]
    assert one(spark, text.element_text(F.lit('<div class="x venue y"><p>Hall</p></div>' + "z" * 20000), "div", "venue")) == "<p>Hall</p>"
    assert one(spark, text.element_text(F.lit("<h1>" + "long " * 5000 + "</h1>"), "h1")) == "long " * 5000


def test_address_variants(spark):
    got = one(spark, text.address_variants(F.lit("Hall, Main St, Metro 6011, Land"), "Metro", "Land"))
    assert got == ["Hall, Main St", "1 Hall, Main St", "Main St", "1 Main St", "Main St, Metro, Land", "1 Main St, Metro, Land", "Hall, Main St, Metro, Land", "1 Hall, Main St, Metro, Land"]
    got = one(spark, text.address_variants(F.lit("2nd Floor, 5 Main St"), "Metro", "Land"))
    assert got[0].endswith("5 Main St") and not any(v.startswith("1 ") for v in got)


def test_display_and_year(spark):
    d = F.array(ts("2024-02-29 19:30:00"), ts("2024-03-01 19:30:00"))
    assert one(spark, dates.display_date(d)) == "Thu 29 Feb + more"
    assert one(spark, dates.stamp(dates.bump_year(ts("2020-02-29 01:00:00"), ts("2023-05-05 00:00:00")))) is None
    assert one(spark, dates.stamp(dates.bump_year(ts("2020-02-28 01:00:00"), ts("2023-05-05 00:00:00")))) == "2023-02-28-01:00"


def test_range_is_clamped_to_now_with_the_starts_hour(spark):
    got = one(spark, F.transform(dates.date_range(ts("2024-01-01 09:00:00"), ts("2024-01-19 09:00:00"), asof()), dates.stamp))
    assert got == ["2024-01-17-09:30", "2024-01-18-09:30"]  # the end keeps its own minute
    got = one(spark, F.transform(dates.date_range(ts("2024-01-18 09:00:00"), ts("2024-01-19 09:00:00"), asof()), dates.stamp))
    assert got == ["2024-01-18-09:00", "2024-01-19-09:00"]


def test_future_dates(spark):
    got = one(spark, F.transform(dates.future_dates(F.array(ts("2024-01-20"), ts("2020-01-01"), ts("2024-01-17 10:30:45")), asof()), dates.stamp))
    assert got == ["2024-01-17-10:30", "2024-01-20-00:00"]


def test_relative_dates(spark):
    rel = lambda s: one(spark, F.transform(dates.relative_dates(F.lit(s), asof()), dates.stamp))
    assert rel("Tomorrow at 7:30 PM") == ["2024-01-18-07:30"]
    assert rel("Today") == ["2024-01-17-01:01"]
    assert rel("Wednesday 9:05") == ["2024-01-17-09:05"]
    assert rel("Sat, 3 Feb and 4 Feb at 18:00") == ["2024-02-03-18:00", "2024-02-04-18:00"]
    assert rel("whenever") == []


def test_other_dates(spark):
    span = lambda s: one(spark, F.concat_ws("|", dates.stamp(dates.span_dates(F.lit(s))["start"]), dates.stamp(dates.span_dates(F.lit(s))["end"])))
    assert span("3 – 5 May 2024") == "2024-05-03-00:00|2024-05-05-00:00"
    assert span("30 April – 2 May 2024") == "2024-04-30-00:00|2024-05-02-00:00"
    assert span("2 May 2024") == "2024-05-02-00:00|2024-05-02-00:00"
    assert span("soon") == ""
    assert one(spark, dates.clock_24(F.lit("Today 12:05am"))) == "00:05"
    assert one(spark, dates.clock_24(F.lit("Tomorrow 7:05 PM"))) == "19:05"
    assert one(spark, F.size(dates.start_and_end(ts("2024-01-01 20:00"), ts("2024-01-02 00:30")))) == 1
    assert one(spark, F.size(dates.start_and_end(ts("2024-01-01 20:00"), ts("2024-01-02 02:00")))) == 2
    assert one(spark, dates.in_season(F.array(F.lit("events2025"), F.lit("x")), F.lit(2025))) is True
    assert one(spark, dates.in_season(F.array(F.lit("events2023"), F.lit("x")), F.lit(2025))) is False
    assert one(spark, dates.stamp(dates.zone_tag_shift(ts("2024-01-01 20:00"), F.lit("8pm GMT"), "gmt"))) == "2024-01-02-06:00"
