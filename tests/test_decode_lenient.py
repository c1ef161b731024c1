"""Lenient decode: per-field NULLs, dropped frames, JSON verdict, warnings."""

from strike_analytics.operators.decode import decode_frames
from strike_analytics.operators.ingest_stats import decode_report

C = "Ć"
GOOD = '{"time":1699564800,"lat' + C + '32.5,"lon' + C + '-117.25,"al' + C + '150,"pol' + C + '"positive","mds' + C + '8,"mcg' + C + '12,'


def lenient(make_frames, payloads):
    return decode_frames(make_frames(payloads), "lenient").orderBy("frame_id").collect()


def test_bad_fields_become_null(make_frames):
    r = lenient(make_frames, [GOOD.replace("12,", "1.2.3,").replace('"al' + C + '150', '"al' + C + '-')])[0]
    assert r.mcg is None and r.altitude is None and r.json_ok


def test_bad_latitude_drops_the_frame(make_frames):
    rows = lenient(make_frames, [GOOD.replace("32.5", "3.2.5"), GOOD])
    assert [r.frame_id for r in rows] == [1]


def test_infinite_altitude_drops_the_frame(make_frames):
    rows = lenient(make_frames, [GOOD.replace('"al' + C + '150', '"al' + C + "9" * 400)])
    assert rows == []


def test_empty_document_is_a_success(make_frames):
    r = lenient(make_frames, ["nothing here"])[0]
    assert r.json == "{}" and r.json_ok and r.warnings == []


def test_json_verdicts(make_frames):
    rows = lenient(make_frames, [
        GOOD,
        GOOD.replace("positive", "pos\\itive"),              # invalid escape
        GOOD.replace("1699564800", "01699564800"),           # leading zero number
        GOOD.replace("positive", "a\tb"),                    # raw control character
    ])
    assert [r.json_ok for r in rows] == [True, False, False, False]


def test_polarity_is_stripped_python_style(make_frames):
    r = lenient(make_frames, [GOOD.replace('"positive"', '"  positive  "')])[0]
    assert r.polarity == "positive"
    r = lenient(make_frames, [GOOD.replace('"positive"', '"   "')])[0]
    assert r.polarity is None


def test_warnings_and_report(make_frames, spark):
    frames = make_frames([GOOD, GOOD.replace("32.5", "95.0"), GOOD.replace("-117.25", "99999"),
                          GOOD.replace("positive", "bad\\q")])
    rows = decode_frames(frames, "lenient").orderBy("frame_id").collect()
    assert rows[1].warnings == ["Invalid latitude: 95.0 (must be -90 to 90)"]
    assert rows[2].warnings == ["Invalid longitude: 99999.0 (must be -180 to 180)"]
    rep = decode_report(decode_frames(frames, "lenient")).collect()[0]
    assert (rep.samples_processed, rep.successful_decodes, rep.validation_warnings, rep.success_rate) == (4, 3, 2, 75.0)


def test_rebuilt_json_parses_to_fields(make_frames):
    import json
    r = lenient(make_frames, [GOOD.replace("-117.25", "16040089")])[0]
    assert json.loads(r.json) == {"time": 1699564800, "lat": 32.5, "lon": 16.040089, "alt": 150,
                                  "pol": "positive", "mds": 8, "mcg": 12}


def test_other_fields(make_frames):
    r = lenient(make_frames, [GOOD])[0]
    assert r.other_fields.asDict() == {"alt": 150, "pol": "positive", "mds": 8, "mcg": 12}


def test_display_time(make_frames):
    import datetime as dt
    rows = lenient(make_frames, [GOOD, GOOD.replace("1699564800", "1699564800000000000")])
    assert rows[0].strike_timestamp == dt.datetime(2023, 11, 9, 21, 20)
    assert rows[1].strike_timestamp is None and rows[1].time_text == "1699564800000000000" and rows[1].json_ok


def test_long_time_digits_follow_python_json(make_frames):
    import json
    rows = lenient(make_frames, [GOOD.replace("1699564800", "1" + "0" * 2999),
                                 GOOD.replace("1699564800", "1" + "0" * 4300),
                                 GOOD.replace("1699564800", "0")])
    assert [r.json_ok for r in rows] == [True, False, True]
    json.loads(rows[0].json)                      # Python agrees with the first verdict


def test_polarity_escapes_follow_python_json(make_frames):
    import json
    pols = ["\\ud800", "\\ud83d\\ude00", "\\uZZZZ", "\\/", "a\\", "\U0001F600", "\x7f", "\\u0000"]
    rows = lenient(make_frames, [GOOD.replace("positive", p) for p in pols])

    def py_ok(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False
    assert [r.json_ok for r in rows] == [py_ok(r.json) for r in rows]
