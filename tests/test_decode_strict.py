"""Strict decode: substitution table, field patterns, numbers, reject order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strike_analytics.functions.decode import decode_payload, SUBSTITUTIONS
from strike_analytics.operators.decode import accepted_strikes, decode_frames

C = "Ć"  # decodes to ": "

GOOD = '{"time":1699564800,"lat' + C + '32.5,"lon' + C + '-117.25,"al' + C + '150,"pol' + C + '"positive","mds' + C + '8,"mcg' + C + '12,'


def decode_one(make_frames, payload):
    return decode_frames(make_frames([payload])).collect()[0]


def test_substitution_bytes_from_docs(make_frames, spark):
    raw = bytes.fromhex("c488c489c48ac48bc48cc48dc48ec48fc490c491c486c487c4b8c4b9c4bac4bb")
    text = make_frames([raw]).select(decode_payload(F.col("payload")).alias("t")).collect()[0].t
    assert text == '0123456789: .""""'


def test_substitution_table_shape():
    assert len(SUBSTITUTIONS) == 68
    assert all(0x100 <= ord(k) <= 0x17F for k in SUBSTITUTIONS)
    assert "Ŏ" not in SUBSTITUTIONS          # U+014E is not a key
    assert SUBSTITUTIONS["Ď"] == "6"          # the repeated key C4 8E


def test_every_key_decodes(make_frames):
    text = "".join(SUBSTITUTIONS)
    out = make_frames([text]).select(decode_payload(F.col("payload")).alias("t")).collect()[0].t
    assert out == "".join(SUBSTITUTIONS.values())


def test_good_frame(make_frames):
    r = decode_one(make_frames, GOOD)
    assert r.reason is None
    assert (r.latitude, r.longitude, r.altitude, r.polarity, r.mds, r.mcg) == (32.5, -117.25, 150, "positive", 8, 12)
    assert r.strike_timestamp == dt.datetime(2023, 11, 9, 21, 20)


@pytest.mark.parametrize("raw,expected", [
    ("1699564800", dt.datetime(2023, 11, 9, 21, 20)),
    ("1699564800000", dt.datetime(2023, 11, 9, 21, 20)),
    ("1699564800123456", dt.datetime(2023, 11, 9, 21, 20, 0, 123456)),
    ("1699564800123", dt.datetime(2023, 11, 9, 21, 20, 0, 123000)),
    ("1000000000000", None),          # exactly 1e12 is seconds -> year > 9999
    ("1000000000000000", None),       # exactly 1e15 is milliseconds -> year > 9999
    ("253402300800", None),
    ("253402300799", dt.datetime(9999, 12, 31, 23, 59, 59)),
    ("1704067207179575000", None),    # nanoseconds
    ("99999999999999999999999", None),
    ("0", dt.datetime(1970, 1, 1)),
])
def test_epoch_units(make_frames, raw, expected):
    r = decode_one(make_frames, GOOD.replace("1699564800", raw))
    assert r.strike_timestamp == expected
    assert r.reason == (None if expected else "time_out_of_range")


@pytest.mark.parametrize("lon,expected", [
    ("16040089", 16.040089), ("1613330", 16.1333), ("-16040089.7", -16.040089),
    ("123456", 1.23456), ("123456789", 1.23456789), ("-123456", -1.23456),
    ("1001", 1001.0), ("1000", 1000.0), ("99999", 99999.0), ("-179.5", -179.5),
    ("1234567890123", 1.234567890123),
])
def test_longitude_repair(make_frames, lon, expected):
    r = decode_one(make_frames, GOOD.replace("-117.25", lon))
    assert r.longitude == pytest.approx(expected, rel=0, abs=0)
    assert r.reason == (None if abs(expected) <= 180 else "out_of_bounds")


@pytest.mark.parametrize("lon", ["-", "1.2.3", "--5", "."])
def test_bad_longitude(make_frames, lon):
    r = decode_one(make_frames, GOOD.replace("-117.25", lon))
    assert r.longitude is None and r.reason == "bad_longitude"


def test_quote_before_colon_is_no_match(make_frames):
    # T1: "lat":x does not match lat[:\s]*, while "time:x (after decode) does not match time.
    assert decode_one(make_frames, GOOD.replace('"lat' + C, '"lat":')).reason == "no_coordinates"
    assert decode_one(make_frames, GOOD.replace('"time":', '"time' + C)).reason == "no_time"


def test_altitude_pattern(make_frames):
    # T2: "alt: 150" never matches the "al" pattern -> altitude NULL, frame kept.
    r = decode_one(make_frames, GOOD.replace('"al' + C, '"alt' + C))
    assert r.reason is None and r.altitude is None


@pytest.mark.parametrize("pol_part,expected", [
    ('"pol' + C + '0', "0,"),
    ('"pol":"positive"', ":"),
    ('"pol' + C + '"negative"', "negative"),
    ('"pol' + C + '"mds"', None),
])
def test_polarity_capture(make_frames, pol_part, expected):
    r = decode_one(make_frames, GOOD.replace('"pol' + C + '"positive"', pol_part))
    assert r.polarity == expected


def test_unicode_whitespace_matches_like_python(make_frames):
    # T16: NBSP is whitespace for Python's \s.
    r = decode_one(make_frames, GOOD.replace('"lat' + C + '32.5', '"lat: 32.5'))
    assert r.latitude == 32.5 and r.reason is None


@pytest.mark.parametrize("change,reason", [
    (('"mcg' + C + '12', '"mcg' + C + '1.2.3'), "bad_number"),
    (('"al' + C + '150', '"al' + C + '1.5.0'), "bad_number"),
    (('"lat' + C + '32.5', '"lat' + C + '3.2.5'), "bad_number"),
    (('"mds' + C + '8', '"mds' + C + '99999999999'), "storage"),
    (('"al' + C + '150', '"al' + C + '2147483648'), "storage"),
    (('"al' + C + '150', '"al' + C + '2147483647.9'), None),
    (('"al' + C + '150', '"al' + C + '-2147483648.5'), None),
    (('"lat' + C + '32.5', '"lat' + C + '95'), "out_of_bounds"),
    (('"lat' + C + '32.5', '"lat' + C + '-90'), None),
    (('"al' + C + '150', '"al' + C + '1' + '0' * 400), "bad_number"),     # int(inf) raises
    (('"lat' + C + '32.5', '"lat' + C + '1' + '0' * 400), "out_of_bounds"),  # inf latitude
])
def test_reject_reasons(make_frames, change, reason):
    r = decode_one(make_frames, GOOD.replace(*change))
    assert r.reason == reason


def test_reject_order(make_frames):
    # no time wins over bad latitude; bad number wins over bad longitude and bounds.
    p = GOOD.replace('"time":', '"time' + C).replace("32.5", "3.2.5")
    assert decode_one(make_frames, p).reason == "no_time"
    p = GOOD.replace("32.5", "95").replace("12,", "1.2.3,")
    assert decode_one(make_frames, p).reason == "bad_number"
    p = GOOD.replace("32.5", "95").replace("-117.25", "-")
    assert decode_one(make_frames, p).reason == "bad_longitude"


def test_polarity_storage_limits(make_frames):
    base = '"pol' + C + '"positive"'
    r = decode_one(make_frames, GOOD.replace(base, '"pol' + C + '"' + "p" * 51 + '"'))
    assert r.reason == "storage"
    r = decode_one(make_frames, GOOD.replace(base, '"pol' + C + '"' + "p" * 50 + "   " + '"'))
    assert r.reason is None and r.polarity == "p" * 50          # excess spaces are dropped
    r = decode_one(make_frames, GOOD.replace(base, '"pol' + C + '"a\u0000b"'))
    assert r.reason == "storage"                                  # T17


def test_invalid_utf8_is_replaced(make_frames):
    r = decode_one(make_frames, GOOD.encode("utf-8") + b"\xff\xc4")
    assert r.reason is None and r.latitude == 32.5


def test_accepted_schema(make_frames):
    df = accepted_strikes(decode_frames(make_frames([GOOD, "{}"])))
    assert df.columns == ["id", "strike_time", "strike_timestamp", "latitude", "longitude",
                          "altitude", "polarity", "mds", "mcg", "inserted_at"]
    assert df.count() == 1


def test_reasons_are_the_documented_ones(spark):
    from conftest import SF_SMALL
    from strike_analytics.schemas import REJECT_REASONS
    from strike_analytics.sources.events import read_frames_from_events
    seen = {r.reason for r in decode_frames(read_frames_from_events(spark, SF_SMALL))
            .select("reason").distinct().collect()}
    assert seen - {None} <= set(REJECT_REASONS)
    assert seen - {None} == set(REJECT_REASONS) - {"bad_longitude"}   # the fixture has no bad longitude


def test_invalid_utf8_replaced_like_python(spark):
    # D2: one U+FFFD per maximal ill-formed subpart, as Python's "replace" handler.
    from strike_analytics.functions.decode import payload_text
    cases = [b"a\xc4b", b"a\xe2\x82b", b"a\xf0\x9f\x98b", b"a\xed\xa0\x80b", b"a\xc0\xafb", b"a\xffb",
             b"a\xf4\x90\x80\x80b", b"a\xe0\x80\x80b", b"\xc4\xc4\x88", b"a\x80\x80b", b"ok\xc4\x88"]
    df = spark.createDataFrame([(bytearray(c),) for c in cases], "payload binary")
    got = [r.t for r in df.select(payload_text(F.col("payload")).alias("t")).collect()]
    assert got == [c.decode("utf-8", "replace") for c in cases]


# The field patterns in Python syntax (the behaviour to match).
PY_PATTERNS = {
    "time": r'time[":]+(\d+)',
    "lat": r"lat[:\s]*([0-9.-]+)",
    "lon": r"lon[:\s]*([0-9.-]+)",
    "alt": r'"?al"?[:\s]*([0-9.-]+)',
    "pol": r'pol[:\s]*"?([^"]+)"?',
    "mds": r"mds[:\s]*([0-9.-]+)",
    "mcg": r"mcg[:\s]*([0-9.-]+)",
}


def test_patterns_match_python_re(spark):
    import random
    import re
    from strike_analytics.functions.decode import PATTERNS, extract
    tokens = ["time", "lat", "lon", "al", "alt", "pol", "mds", "mcg", '"', ":", ": ", " ", " ",
              " ", "\t", "\n", "\x1c", ",", "x", "-", ".", "0", "7", "12", "3.5", "-0.25", "{", "}"]
    random.seed(5)
    texts = ["".join(random.choice(tokens) for _ in range(random.randint(1, 18))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", *[extract(F.col("t"), f).alias(f) for f in PATTERNS]).collect()
    for r in rows:
        for f, pat in PY_PATTERNS.items():
            m = re.search(pat, r.t)
            assert r[f] == (m.group(1) if m else None), (f, r.t)
