"""Numbers and dates with text on both sides: nothing stays in clear, nothing beside them changes, equal values stay linked."""

import re

import pytest

from tidemark.llm.pii import Pseudonyms, with_pseudonyms

KEY = b"a key"
AROUND = [("", ""), ("call ", " now"), ("tel ", " 12 Uhr"), ("tel ", ", 12 Uhr"), ("x ", " 2024 times"), ("(", ")"), ("no: ", " 0049 151 now"), ("a ", "\n2024-03-05"), ("", " 7"), ("é ", " é")]


def rewrite(text):
    return Pseudonyms(KEY).rewrite(text)


@pytest.mark.parametrize("number", ["+49 151 23456789", "+4915123456789", "+1 415 555 2671", "+1-415-555-2671", "+33 6 12 34 56 78", "+44 20 7946 0958", "+44 (0)20 7946 0958", "+353 1 234 5678"])
def test_a_number_is_the_same_whatever_stands_around(number):
    made = set()
    for before, after in AROUND:
        new, spans = rewrite(before + number + after)
        assert spans[0][:3] == (len(before), len(before) + len(number), "phone")
        assert new.startswith(before) and new[len(before) + len(number) :].startswith(re.split("[0-9]{4}-", after)[0])
        made.add(spans[0][3])
    assert len(made) == 1 and made != {number}


def test_the_spellings_of_one_number_agree():
    digits = {re.sub(r"\D", "", rewrite(f"a {x} b 12")[1][0][3]) for x in ("+1 415 555 2671", "+14155552671", "+1.415.555.2671")}
    assert len(digits) == 1
    assert re.sub(r"\D", "", rewrite("(415) 555-2671")[0]) == digits.pop()[1:]


@pytest.mark.parametrize("text", ["2024-03-05T10:00:00Z", "2024-03-05_log", "at 2024-03-05.", "log_2024-03-05", "[2024-03-05]", "x 2024-03-05 y"])
def test_dates_in_instants_and_names(text):
    day = rewrite("2024-03-05")[0]
    assert rewrite(text)[0] == text.replace("2024-03-05", day) != text


@pytest.mark.parametrize("text", ["id 2024-03-05-12 stays", "v2024-03-05", "2024-03-05Tx", "2024-13-45T10:00"])
def test_what_is_no_date_stays(text):
    assert rewrite(text) == (text, [])


def test_in_rows(spark):
    texts = ["call +4915123456789 0049 151 now", "tel +49 151 23456789 12 Uhr", "tel +49 151 23456789, ok", "+1 415 555 2671 2024 times", "2024-03-05T10:00:00Z", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.private.n_phone, r.private.n_date, r.private.spans) for r in with_pseudonyms(docs, KEY).collect()}
    assert got[0][1:] == (1, 0, "phone:5:19") and got[0][0].endswith(" 0049 151 now")
    assert got[1][1:] == (1, 0, "phone:4:20") and got[1][0].endswith(" 12 Uhr")
    assert got[2][0][4:20] == got[1][0][4:20] and re.sub(r"\D", "", got[0][0][5:19]) == re.sub(r"\D", "", got[1][0][4:20])
    assert got[3][1:] == (1, 0, "phone:0:15") and got[3][0].endswith(" 2024 times")
    assert got[4][1:] == (0, 1, "date:0:10") and got[5][0] is None and got[6][0] == ""
