"""Surrogates: each clause of the format, distinctness by construction, and drawn ones against each other."""

import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("bytequarry.llm")
from bytequarry.llm import pii  # noqa: E402

KEY = "a key of these tests"


def replaced(text, key=KEY):
    out, at = [], 0
    for e in pii.detect(text):
        out += (text[at : e.start], pii.shaped(e.kind, text[e.start : e.end], pii.surrogate(key, e.kind, e.canon)))
        at = e.end
    return "".join(out) + text[at:]


def test_one_person_has_one_surrogate():
    new = replaced("Dr Anna Smith met Mrs Anna Smith, and Mrs Smith left. MRS ANNA SMITH came, with Prof Angela Smith")
    m = re.fullmatch(r"Dr (\w+) (\w+) met Mrs (\w+) (\w+), and Mrs (\w+) left. MRS (\w+) (\w+) came, with Prof (\w+) (\w+)", new)
    a, f = m[1], m[2]
    assert (m[3], m[4], m[5], m[9]) == (a, f, f, f) and (m[6], m[7]) == (a.upper(), f.upper())
    assert pii.GIVEN_OF[a] == ("f", "latin") and a != "Anna" and f != "Smith" and m[8].endswith("a") and m[8] != "Angela"


def test_scripts_and_forms():
    m = re.fullmatch(r"(\w+) (\w+)а и Господин (\w+)", replaced("Анна Иванова и Господин Иванов"))
    assert pii.GIVEN_OF[m[1]] == ("f", "cyrillic") and m[2] == m[3] != "Иванов" and m[3].endswith("ов")
    new = replaced("Κυρία Μαρία Παπαδά")
    assert pii.GIVEN_OF[new.split()[1]] == ("f", "greek") and pii.script_of(new.split()[2]) == "greek"
    new = replaced("王小明先生说, 王小明。")
    assert new[:3] == new[8:11] != "王小明" and new[3:6] == "先生说" and new[0] in pii.HAN_FAMILY
    assert re.fullmatch(r"Señor O'[A-Z][a-z]{4}", replaced("Señor O'Brien")) or replaced("Señor O'Brien").startswith("Señor ")


def test_case_and_layout_stay():
    new = replaced("Ann.Lee7@Mail.Example.com ann.lee7@mail.example.com")
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}[0-9]@[A-Z][a-z]{3}\.[A-Z][a-z]{6}\.com [a-z]{3}\.[a-z]{3}[0-9]@[a-z]{4}\.[a-z]{7}\.com", new)
    assert new.split()[0].lower() == new.split()[1]
    iban = replaced("DE89 3704 0044 0532 0130 00").replace(" ", "")
    assert iban[:2] == "DE" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 3000), st.text("abc", max_size=3))
def test_permutations_have_no_fixed_points(size, tweak):
    got = [pii.permuted(KEY, tweak, k, size) for k in range(0, size)]
    assert sorted(got) == list(range(size)) and all(a != k for k, a in enumerate(got))


def test_full_domains_stay_distinct():
    low = [f"192.168.{a}.{b}" for a in range(256) for b in range(0, 256, 5)]
    made = {pii.surrogate(KEY, "ip", x) for x in low}
    assert len(made) == len(low) and all(x.startswith("192.168.") for x in made)
    cards = [f"4{k:015d}" for k in range(2000)]
    made = [pii.surrogate(KEY, "card", x) for x in cards]
    assert len(set(made)) == len(cards) and all((pii.luhn(a) == 0) == (pii.luhn(b) == 0) and a[0] == b[0] for a, b in zip(cards, made, strict=True))
    for check in range(100):
        assert pii.surrogate(KEY, "iban", f"DE{check:02d}12345678") != f"DE{check:02d}12345678"
    assert len({pii.surrogate(KEY, "iban", f"DE{k:02d}{a}345678") for k in range(100) for a in range(10, 30)}) == 2_000
    names = ["".join(x) for x in itertools.product("bcst", "aei", "rtv", "io", "xz")] + [*pii.LISTED_OF] + ["иванов", "иванова", "ивановос", "петрина", "петрин", "παπαδόπουλος", "παπαδοπούλου", "λάκου", "λάκος"]
    for name in (pii.given_name, pii.family_name):
        made = [name(KEY, x) for x in names]
        assert len(set(made)) == len(names) and not any(a == b for a, b in zip(names, made, strict=True))


def test_the_key_decides():
    assert replaced("10.1.2.3 and Mrs Weber", "x") != replaced("10.1.2.3 and Mrs Weber", "y") and replaced("10.1.2.3", "x") == replaced("10.1.2.3", "x")


def test_rows_without_id_get_their_redraws(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_BROADCAST", 0)
    mails = [f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame([(None, " ".join(mails), 1, 2, 3), (None, mails[0], 1, 2, 3)], "doc_id long, text string, exceptions int, text_mark int, _other int")
    out = pii.pseudonymize(df, KEY)
    rows = sorted((r.text.split(" ") for r in out.collect()), key=len)
    assert len(set(rows[1])) == 26 and not set(rows[1]) & set(mails) and rows[0][0] == rows[1][0]
    assert out.columns == [*df.columns, "_found"]


def test_too_many_collisions_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_ROUNDS", 1)
    found = spark.createDataFrame([("email", f"{c}@x.org") for c in "abcdefghijklmnopqrstuvwxyz"], "kind string, canon string")
    with pytest.raises(RuntimeError):
        pii.exceptions(found, KEY)
