"""Personal data in sentences written by hand, none by the generator of the training candidates; and odd tables."""

import pytest

from stallwise.llm import pii, secrets

SCHEMA = "doc_id long, text string, token string"

#: (sentence, kind, what must be found)
MEANT = [
    ("Write to jane.doe [at] example.org for the keys.", "email", "jane.doe [at] example.org"),
    ("You may reach me under k.mueller(at)firma.de any time.", "email", "k.mueller(at)firma.de"),
    ("contact: sales (at) widgets (dot) com, answers within a day", "email", "sales (at) widgets (dot) com"),
    ("Call (212) 555-0187 before noon.", "phone", "(212) 555-0187"),
    ("My phone is 415-555-0132, leave a message.", "phone", "415-555-0132"),
    ("Tel: 0171 555 0199 ask for Ms Brown", "phone", "0171 555 0199"),
    ("fax 206.555.0143 is out of order", "phone", "206.555.0143"),
    ("Pay with card 4111.1111.1111.1111 please.", "card", "4111.1111.1111.1111"),
    ("the visa 5500_0000_0000_0004 was declined", "card", "5500_0000_0000_0004"),
    ("credit card: 4012888888881882 expires in May", "card", "4012888888881882"),
    ("The server answers at 2001:0db8:85a3:0000:0000:8a2e:0370:7334 only.", "ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
    ("Send the rent to DE89 3704 0044 0532 0130 00 by Friday.", "iban", "DE89 3704 0044 0532 0130 00"),
    ("account FR14 2004 1010 0505 0001 3026 06 belongs to the club", "iban", "FR14 2004 1010 0505 0001 3026 06"),
    ("Her social security number is 219-09-9999.", "national_id", "219-09-9999"),
    ("ssn: 078-05-1120", "national_id", "078-05-1120"),
]
CLEAN = [
    "The parcel 4111111111111112 left the depot on Monday.",
    "Write a.b@c.com or d@e.org about lot 9182736455463728 and nothing else.",
    "Reference 1234567890123456 must be quoted.",
    "Serial no 4929123412341235 is on the back.",
    "They met on 2019-04-12 and again on 12.05.2020.",
    "The score was 21-19 21-17 in two sets.",
    "It started at 10:15:30:22 by the house clock.",
    "Order 000-12-3456 was cancelled.",
    "Version 10.2.133.4567 came out in spring.",
    "Part QT12345678901234567 fits both models.",
    "We looked (at) the old.st houses by the river.",
    "Pages 112-118 and 203-209 treat the war.",
    "Nothing personal stands in this sentence at all.",
    "Between 1914 and 1918, then 1939 to 1945.",
    "The ratio is 3.14159 26535 89793 to many places.",
]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def learned(spark):
    contexts = ["It was a quiet evening by the lake and the boats had all come in before the storm. " * 3, "Nous avons mangé du pain. Die Katze schläft auf dem Sofa. El perro corre por la calle. " * 3] * 30
    return pii.learn(rows(spark, contexts))


def test_recall_and_precision_by_hand(learned):
    hit = sum((kind, s.index(what), s.index(what) + len(what)) in pii.find(s, *learned)[1] for s, kind, what in MEANT)
    meant = [pii.find(s, *learned)[1] for s, *_ in MEANT]
    false = [(s, found) for s in CLEAN for found in [[x for x in pii.find(s, *learned)[1] if x not in pii.base_spans(s)]] if found]
    spurious = sum(len(x) for _, x in false) + sum(len(x) for x in meant) - hit
    assert hit >= 0.85 * len(MEANT), [s for (s, kind, what), m in zip(MEANT, meant) if (kind, s.index(what), s.index(what) + len(what)) not in m]
    assert hit >= 0.9 * (hit + spurious), (false, meant)


def test_a_wrong_check_digit_needs_a_word_for_cards(learned):
    near = "a.b@c.com, d.e@f.org, +1 (212) 555-0187 and "
    for s in (CLEAN[0], CLEAN[2], near + "9182736455463728 stand there."):
        assert pii.find(s, *learned)[0] == pii.find(s, *learned)[1], s


def test_of_overlapping_kinds_the_checked_one_stays(learned):
    assert pii.checked("card", "4111.1111.1111.1111") and not pii.checked("card", "4111.1111.1111.1112")
    assert pii.checked("iban", "DE89 3704 0044 0532 0130 00") and not pii.checked("iban", "DE88 3704 0044 0532 0130 00")
    assert not any(k == "phone" for k, *_ in pii.candidates("4111.1111.1111.1111"))
    assert any(k == "phone" for k, *_ in pii.candidates("call 555-123-4567 24 hours"))


@pytest.mark.parametrize("find", [pii.find_pii, secrets.find_secrets])
def test_empty_tables_and_repeated_rows(spark, find):
    assert find(rows(spark, []), made=600).count() == 0
    text = "mail a@b.com, token = abcdef123456, call (212) 555-0187"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, text, "x"), (None, text, "x"), (3, None, "x"), (4, "", "x")], SCHEMA)
    got = [(x.doc_id, x.base_sha256, x.spans) for x in find(df, made=600).collect()]
    same = {x[1:] for x in got if x[0] in (1, 2)}
    assert sorted(x[0] for x in got) == [1, 1, 2, 3, 4] and len(same) == 1
    assert {x[2] for x in got if x[0] in (3, 4)} == {""}
