import datetime
import ipaddress
import re

import pytest
from pyspark.sql import functions as F

from anamnesis.llm import pii


def _texts(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n_private) for r in pii.private_values(frame).orderBy("doc_id").collect()]


def _iban(text):
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


PHONES = [
    "+33 1 23 45 67 89", "+33 (0)1 23 45 67 89", "+34 612 34 56 78", "+41 44 668 18 00", "+14155550100", "(555) 123-4567", "555-123-4567",
    "555.123.4567", "01 23 45 67 89", "030 12345678", "020 7946 0958", "612 34 56 78",
]
CARDS = ["3782 822463 10005", "3782-822463-10005", "3056 930902 5904"]
IBANS = ["GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000", "FR14 2004 1010 0505 0001 3M02 606", "MT84MALT011000012345MTLCAST001S"]
ADDRESSES = ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "::ffff:9", "1::"]
DATES = {
    "31/12/1990": "%d/%m/%Y", "31.12.1990": "%d.%m.%Y", "12/31/1990": "%m/%d/%Y", "31-12-1990": "%d-%m-%Y", "1990/12/31": "%Y/%m/%d",
    "03/04/1990": "%d/%m/%Y", "29.02.2000": "%d.%m.%Y", "12 May 1990": "%d %B %Y", "May 12, 1990": "%B %d, %Y", "12 Jan 1990": "%d %b %Y",
}


@pytest.mark.parametrize("values", [PHONES, CARDS, IBANS, ADDRESSES, list(DATES)])
def test_values_become_others_of_their_format(spark, values):
    got = _texts(spark, [f"It is {v}, or ({v}) here" for v in values])
    for value, (text, n) in zip(values, got):
        new = text.removeprefix("It is ").split(", or (")[0]
        assert n == 2 and value not in text and text == f"It is {new}, or ({new}) here"
        if values is PHONES:
            assert re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", value)
        elif values is CARDS:
            digits = [int(c) for c in reversed(new) if c.isdigit()]
            assert [len(x) for x in re.split("[ -]", new)] == [len(x) for x in re.split("[ -]", value)]
            assert sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
        elif values is IBANS:
            shape = lambda x: re.sub("[A-Z]", "A", re.sub("[0-9]", "9", x))
            assert _iban(new) and new[:2] == value[:2] and shape(new) == shape(value)
        elif values is ADDRESSES:
            assert ipaddress.IPv6Address(new)
        elif DATES[value] in ("%d %B %Y", "%B %d, %Y", "%d %b %Y"):
            datetime.datetime.strptime(new.replace("Sept ", "Sep "), DATES[value])
        else:
            datetime.datetime.strptime(new, DATES[value])


def test_written_dates_of_other_languages(spark):
    for text, n in _texts(spark, ["am 3. März 1990 ", "le 1er août 1990 ", "el 12 de mayo de 1990 ", "the 2nd of June 1990 "]):
        assert n == 1 and "1990 " not in text


def test_lookalikes_stay(spark):
    texts = [
        "31/02/1990", "32.12.1990", "13/13/1990", "3782 822463 10006", "GB29 NWBK 6016 1331 9268 18", "12:30:45", "00:1a:2b:3c:4d:5e", "std::vector",
        "a :: b", "1:2:3:4:5:6:7", "chapters 12 and 13", "2024-13-01", "99 May 1990",
    ]
    assert _texts(spark, texts) == [(t, 0) for t in texts]


def test_days_are_permuted(spark):
    days = spark.range(146_097).select(F.expr("date_add(date'1800-01-01', cast(id as int))").alias("d"))
    for form in ("dd/MM/yyyy", "MM/dd/yyyy", "d.M.yyyy"):
        texts = days.select(F.date_format("d", form).alias("m")).select("m", F.expr(pii._day_month("m", "'k'")).alias("p"))
        parsed = "MM/dd/yyyy" if form == "MM/dd/yyyy" else form
        seen = texts.select(F.count("*"), F.count_distinct("p"), F.count(F.expr(f"try_to_timestamp(p, '{parsed}')")), F.sum(F.expr("cast(m = p as int)"))).first()
        assert seen[0] == seen[1] == seen[2] == 146_097 and seen[3] < 50


def test_first_digits_are_permuted(spark):
    texts = spark.range(2_000, 10_000).select(F.col("id").cast("string").alias("d")).select(F.expr(pii._digits_from("d", 2, "'k'")).alias("p"))
    assert texts.distinct().count() == 8_000 and texts.filter("p < '2' OR length(p) != 4").count() == 0
