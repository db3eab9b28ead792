"""Missing values, times and number texts on hand-made rows."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from claimsift.functions import text as tx, values as vl


def values(spark, rows, schema, *columns):
    out = spark.createDataFrame(rows, schema).select(*columns).collect()
    return [tuple(r) if len(r) > 1 else r[0] for r in out]


def test_whole_days_floor(spark):
    rows = [
        (datetime(2024, 1, 1, 23), datetime(2024, 1, 2, 1)),
        (datetime(2024, 1, 2, 1), datetime(2024, 1, 1, 23)),
        (datetime(2024, 1, 1), datetime(2024, 1, 4)),
        (datetime(2024, 1, 4), datetime(2024, 1, 1, 0, 0, 0, 1)),
        (None, datetime(2024, 1, 1)),
    ]
    days = vl.whole_days(F.col("a"), F.col("b"))
    assert values(spark, rows, "a timestamp, b timestamp", days) == [0, -1, 3, -3, None]


def test_timestamps_that_do_not_parse_are_null(spark):
    texts = ["2024-01-05 10:30:00", "2024-01-05", "01/31/2024 08:15", "01/31/2024", "junk", "", None, "2024-13-45"]
    got = values(spark, [(t,) for t in texts], "t string", vl.parse_timestamp(F.col("t")))
    assert got == [
        datetime(2024, 1, 5, 10, 30),
        datetime(2024, 1, 5),
        datetime(2024, 1, 31, 8, 15),
        datetime(2024, 1, 31),
        None,
        None,
        None,
        None,
    ]


def test_usual_layouts_of_dates_and_times(spark):
    day, morning, evening = datetime(2024, 1, 25), datetime(2024, 1, 25, 10, 30), datetime(2024, 1, 25, 22, 30, 5)
    layouts = {
        "25-01-2024": day,
        "25/01/2024 10:30": morning,
        "25.1.2024 22:30:05": evening,
        "2024/01/25": day,
        "2024/1/25 10:30": morning,
        "25 Jan 2024": day,
        "25-Jan-2024 10:30 am": morning,
        "25 January 2024": day,
        "Jan 25, 2024 10:30 PM": datetime(2024, 1, 25, 22, 30),
        "01/25/2024 10:30 AM": morning,
        "1/25/2024 10:30:05 PM": evening,
        " 2024-01-25T10:30:00 ": morning,
        "03/04/2024": datetime(2024, 3, 4),
        "31/31/2024": None,
        "25-01": None,
    }
    got = values(spark, [(t,) for t in layouts], "t string", vl.parse_timestamp(F.col("t")))
    assert dict(zip(layouts, got)) == layouts


def test_nan_never_satisfies_a_rule(spark):
    rows = [(math.nan,), (None,), (3.0,), (math.inf,), (1.0,)]
    clean = vl.nan_to_null(F.col("x"))
    assert values(spark, rows, "x double", vl.holds(clean > 2.5)) == [False, False, True, True, False]
    assert values(spark, rows, "x double", vl.finite_or_null(F.col("x"))) == [None, None, 3.0, None, 1.0]


def python_amount(amount):
    if amount >= 10_000_000:
        return f"₹{amount / 10_000_000:.1f} Cr"
    if amount >= 100_000:
        return f"₹{amount / 100_000:.1f} L"
    return f"₹{amount:,.0f}"


def test_amount_labels_round_like_python(spark):
    amounts = [99_999.0, 99_999.5, 100_000.0, 125_000.0, 135_000.0, 9_999_999.0, 1e7, 1.25e7, 1.35e7, 0.5, 1.5, 2.5, 1234.5, 1.5e12]
    got = values(spark, [(a,) for a in amounts], "a double", tx.fmt_amount(F.col("a")))
    assert got == [python_amount(a) for a in amounts]


def test_strip_and_one_line_like_python(spark):
    texts = ["  a b  ", " 　x\ny ", "\n\nline one\nline two\n", "", "\t", "a\u0085"]
    assert values(spark, [(t,) for t in texts], "t string", tx.one_line(F.col("t"))) == [t.strip().replace("\n", " ") for t in texts]


def test_display_names_like_python(spark):
    mails = ["john.doe@x.org", "o'neil_2nd@x.org", "JANE@x", "plain"]
    assert values(spark, [(m,) for m in mails], "m string", tx.display_name(F.col("m"))) == [m.split("@")[0].title() for m in mails]


def test_labels_of_texts_that_do_not_parse(spark):
    texts = ["2024-01-05T15:07:00+00:00", "2024-01-05T00:07:00Z", "sometime in January 2024"]
    got = values(spark, [(t,) for t in texts], "t string", tx.date_label(F.col("t")), tx.datetime_label(F.col("t")))
    assert got == [
        ("05 Jan 2024", "05 Jan 2024, 03:07 PM"),
        ("05 Jan 2024", "05 Jan 2024, 12:07 AM"),
        ("sometime i", "sometime in Janu"),
    ]


@pytest.mark.parametrize(
    "seconds, label",
    [(0, "0S AGO"), (59, "59S AGO"), (60, "1M AGO"), (3599, "59M AGO"), (3600, "1H AGO"), (86399, "23H AGO"), (86400, "1D AGO"), (-5, "-5S AGO")],
)
def test_age_labels(spark, seconds, label):
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    created = F.timestamp_micros(F.unix_micros(as_of) - F.lit(seconds * 1_000_000))
    assert spark.range(1).select(tx.age_label(created, as_of)).first()[0] == label


def test_keyword_order_and_initials(spark):
    texts = ["Ghost data?", "upcode my DATA", "show data", "hello"]
    got = values(spark, [(t,) for t in texts], "t string", tx.keyword_reply(F.col("t"), F.lit(7)))
    assert got[0] == tx.GHOST_REPLY and got[1] == tx.UPCODE_REPLY
    assert got[2] == "Currently, I see 7 critical cases in the cloud database."
    assert got[3].startswith("Forensic DB indicates 7 ")
    assert values(spark, [("ann",), ("",), (None,)], "n string", tx.initial(F.col("n"))) == ["A", "G", "G"]


def test_only_texts_of_a_layouts_shape_reach_the_parser(spark):
    """What a layout's shape keeps from the parser is nothing that the parser reads."""
    days = ["5", "05", "005", "0", "13", "31", "32", "-3", "+5"]
    names = ["Jan", "jan", "JANUARY", "Sep", "Sept", "May", "may", "\u017fep", "Foo"]
    years = ["2020", "20", "-2020", "+12020", "12020"]
    texts = [f"{a}{s}{b}{s}{c}{end}" for a in days for b in [*days, *names] for c in years for s in "/-. " for end in ("", " 9:05 PM", " 25:00")]
    texts += [f"{y}/{m}/{d}" for y in years for m in days for d in days] + [f"{n} {d}, {y}" for n in names for d in days for y in years]
    cells = spark.createDataFrame([(t,) for t in texts], "t string")
    for layout in vl.DATE_FORMATS:
        whole = F.try_to_timestamp("t", F.lit(layout + vl.CLOCK))
        kept = F.col("t").rlike(vl.shape(layout))
        row = cells.agg(F.count_if(kept).alias("kept"), F.count(whole).alias("read"), F.count_if(~whole.eqNullSafe(vl.parse_layout(F.col("t"), layout))).alias("other")).first()
        assert row.other == 0 and 0 < row.read <= row.kept < len(texts) / 4, layout
