"""Entities in every form that is promised, and texts that hold none."""

import re

FOUND = [
    ("Contact Anna Smith now", ["Anna", "Smith"], ["name"]),
    ("Signed, John Ronald Tolkien", ["John", "Ronald", "Tolkien"], ["name"]),
    ("my name is Anna Smith. Contact Mr Smith", ["Anna", "Smith"], ["name", "name_m"]),
    ("passwd=abcd1 pwd: hunter22", ["abcd1", "hunter22"], ["secret", "secret"]),
    ("my password is Hunter2222 now", ["Hunter2222"], ["secret"]),
    ("Authorization: Bearer abcDEF1234567890xyz", ["abcDEF1234567890xyz"], ["secret"]),
    ("ghp_abcdEFGH1234ijkl5678mnop", ["abcdEFGH"], ["secret"]),
    ("token=abc:def:0123456789abcdef", ["abc:def"], ["secret"]),
    ("pay GB29 NWBK 6016 1331 9268 19 or DE89370400440532013000.", ["NWBK", "6016", "0440532013"], ["iban", "iban"]),
    ("at 2001:db8:0:0:1:0:0:1 and fe80::1ff:fe23:4567:890a", ["db8", "fe23"], ["ipv6", "ipv6"]),
    ("call 030 1234567 or 0171/1234567 or 01 23 45 67 89 or 020 7946 0958", ["1234567", "23 45", "7946"], ["phone"] * 4),
]
NONE = ["Dear Sir or Madam, Contact Us Today", "Contact Customer Support", "std::vector and 12:30:45 and abc::def", "date 01.02.2024, from 0 to 100 000", "the password is wrong, bearer responsibilities", "sk-learn and GB of RAM"]


def sample(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_found_and_replaced(spark):
    from spanloom.llm.pii import pseudonymise

    got = {r.doc_id: r for r in pseudonymise(sample(spark, [t for t, _, _ in FOUND] + NONE), report=True).collect()}
    for k, (text, gone, kinds) in enumerate(FOUND):
        assert [e.kind for e in got[k].entities] == kinds, text
        assert not any(g in got[k].text for g in gone), got[k].text
    for k, text in enumerate(NONE, len(FOUND)):
        assert got[k].text == text and not got[k].entities


def rest(iban):
    body = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97


def test_account_numbers_stay_valid_and_addresses_distinct(spark):
    from spanloom.llm.pii import pseudonymise

    good, bad = "GB29 NWBK 6016 1331 9268 19", "GB28 NWBK 6016 1331 9268 19"
    got = [r.text for r in pseudonymise(sample(spark, [f"to {good} now", f"to {bad} now", f"to {good.replace(' ', '')} now"])).orderBy("doc_id").collect()]
    new = [re.search("to (.*) now", t).group(1) for t in got]
    assert rest(good) == 1 and rest(new[0]) == 1 and new[0][:2] == "GB" and new[0] != good
    # the same account in both spellings, the other one apart
    assert new[0].replace(" ", "") == new[2] and new[1] != new[0]
    short = [f"a::{k:x}" for k in range(1, 200) if any(c.isdigit() for c in f"{k:x}")]
    made = [r.text for r in pseudonymise(sample(spark, [f"at {x} now" for x in short])).collect()]
    assert len(set(made)) == len(short) and not {f"at {x} now" for x in short} & set(made)
