"""Surrogates: nothing planted is left, formats hold, coreference and distinctness hold."""

from __future__ import annotations

import re

import pytest

from geoledger.llm import queries, surrogates

from ..conftest import SF

KEY = b"test"


def texts_of(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    return {r["doc_id"]: r for r in surrogates.replaced(docs, KEY, **options).collect()}


def test_formats_and_coreference(spark):
    texts = [
        "Call +1 (017) 555-7713, or 1.017.555.7713? Mail Anna.12@mail7.example.com now.", "ANNA.12@MAIL7.EXAMPLE.COM!! and été.9@mail7.example.com",
        "ip 97.51.17.173*** not 1.2.3 or 999.1.1.1 or 1.2.3.4.5", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', 'TOKEN = "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF"!!',
        "card 4111 1111 1111 1111 and 4111111111111111 and 9807915762804490", "Mrs Anna Smith met Mr. Tom Smith; Anna Smith left, Smith too. Госпожа Анна Иванова.",
        "", None, "Clean text with 12 numbers, 3.14 and 2024-01-02, version 4.0.", "x " * 50_000 + "a.b@c.example.org",
    ]
    got = texts_of(spark, texts)
    assert len(got) == len(texts) and got[8]["text"] is None and got[7]["text"] == "" and got[9]["text"] == texts[9]
    phone = re.fullmatch(r"Call \+1 \((\d{3})\) (\d{3})-(\d{4}), or 1\.(\d{3})\.(\d{3})\.(\d{4})\? Mail (\S+) now\.", got[0]["text"]) or re.fullmatch(r"Call \+1 \((\d{3})\) (\d{3})-(\d{4}), or .* Mail (\S+) now\.", got[0]["text"])
    assert phone and phone[1] + phone[2] + phone[3] != "0175557713"
    mail = re.search(r"Mail (\S+) now", got[0]["text"])[1]
    assert re.fullmatch(r"[A-Z][a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", mail)
    assert got[1]["text"].split("!!")[0] == mail.upper()
    second = got[1]["text"].split()[-1]
    assert second.split("@")[1] == mail.split("@")[1] and re.fullmatch(r"[áàâäçéèêëíìîïñóòôöúùûü]t?[a-z]?.*\.\d@.*", second)
    assert re.fullmatch(r"ip (\d+\.){3}\d+\*\*\* not 1\.2\.3 or 999\.1\.1\.1 or 1\.2\.3\.4\.5", got[2]["text"]) and "97.51.17.173" not in got[2]["text"]
    secret = re.search('"([0-9a-f]{40})"', got[3]["text"])[1]
    assert secret.upper() in got[4]["text"] and secret not in texts[3]
    a, b, c = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16}) and (\d{16})", got[5]["text"]).groups()
    assert a.replace(" ", "") == b != "4111111111111111" and surrogates._luhn(b[:-1]) == int(b[-1])
    assert (surrogates._luhn(c[:-1]) == int(c[-1])) == (surrogates._luhn("980791576280449") == 0)
    name = re.fullmatch(r"Mrs (\w+) (\w+) met Mr\. (\w+) (\w+); (\w+) (\w+) left, (\w+) too\. Госпожа ([А-Я][а-я]+) ([А-Я][а-я]+)\.", got[6]["text"])
    assert name[1] == name[5] and len({name[2], name[4], name[6], name[7]}) == 1 and name[1].endswith("a") and name[3].endswith("o") and name[8].endswith("а")
    assert not re.search("Anna|Tom|Smith|Анна|Иванова", got[6]["text"])
    assert got[10]["n_replaced"] == 1 and "a.b@c.example.org" not in got[10]["text"]


def test_collisions_are_drawn_again(spark, monkeypatch):
    names = [chr(65 + i) + chr(97 + j) + "x" for i in range(26) for j in range(26)]
    found = spark.createDataFrame([("surname", n.lower()) for n in names] + [("given_f", "Lia".lower())], "kind string, entity string")
    drawn = surrogates.assign(found, KEY).collect()
    assert len({(r["kind"], r["surrogate"]) for r in drawn}) == len(names) + 1 and max(r["attempt"] for r in drawn) > 0
    texts = [f"Mr {n} spoke." for n in names] + [f"Mr {names[0]} and Mr {names[5]}"]
    got = texts_of(spark, texts)
    assert len({got[i]["text"] for i in range(len(names))}) == len(names)
    first, last = got[0]["text"].split()[1], got[5]["text"].split()[1]
    assert got[len(names)]["text"] == f"Mr {first} and Mr {last}"


@pytest.mark.parametrize("size", [1, 2, 10, 1000])
def test_permutation(size):
    assert sorted(surrogates._shuffled(i, size, KEY, "t") for i in range(size)) == list(range(size))


def test_empty_table(spark):
    assert surrogates.replaced(spark.createDataFrame([], "doc_id long, text string"), KEY).collect() == []


def test_query_on_whole_table(spark):
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    after = {r["doc_id"]: r["text"] for r in queries.QUERIES["op2_surrogates"](spark, SF).collect()}
    assert set(before) == set(after)
    real, made, mapping = set(), set(), {}
    for i, text in before.items():
        a, b = surrogates.detect(text), surrogates.detect(after[i])
        assert [(k, y - x) for x, y, k, _ in a if k != "ipv4"] == [(k, y - x) for x, y, k, _ in b if k != "ipv4"]
        for (_, _, k, x), (_, _, l, y) in zip(a, b):
            assert k == l and mapping.setdefault((k, x), y) == y
            real.add((k, x))
            made.add((k, y))
        if not a:
            assert after[i] == text
    assert real and not real & made and len(made) == len(mapping)


def test_given_names_alone_and_other_scripts(spark):
    texts = [
        "Mrs Anna Smith spoke. Anna left; Annabel stayed.", "Mr Αλέξανδρος Παπαδόπουλος and Αλέξανδρος again", "Frau Іванна Їжак rief an. Іванна ging.",
        "Mr 山田 太郎 met Ms 김 민지.", "Mr გიორგი ბერიძე spoke", "Mr Thomas met Mr Thomas Brown",
    ]
    got = [r["text"] for _, r in sorted(texts_of(spark, texts).items())]
    english = re.fullmatch(r"Mrs (\w+) (\w+) spoke\. (\w+) left; Annabel stayed\.", got[0])
    assert english and english[1] == english[3] != "Anna"
    greek = re.fullmatch(r"Mr ([Α-Ωα-ως]+) ([Α-Ωα-ως]+) and ([Α-Ωα-ως]+) again", got[1])
    assert greek and greek[1] == greek[3] and greek[1].endswith("ος")
    cyrillic = re.fullmatch(r"Frau ([А-Яа-я]+) ([А-Яа-я]+) rief an\. ([А-Яа-я]+) ging\.", got[2])
    assert cyrillic and cyrillic[1] == cyrillic[3]
    assert re.fullmatch(r"Mr [一-鿿]{2} [一-鿿]{2} met Ms [가-힣] [가-힣]{2}\.", got[3]) and re.fullmatch(r"Mr [ა-ჿ]{6} [ა-ჿ]{6} spoke", got[4])
    thomas = re.fullmatch(r"Mr (\w+) met Mr (\w+) (\w+)", got[5])
    assert thomas and not re.search("Thomas|Brown", got[5])


def test_ipv6(spark):
    texts = ["from 2001:db8:85a3::8a2e:370:7334, 2001:0DB8:85A3:0000:0000:8A2E:0370:7334.", "a[1::2], std::x, ::1, fe80::1, 12:30:45, 00:1b:44:11:3a:b7 and 1:2:3:4:5:6:7:8:9", "x 2001:db8:85a3::8a2e:370:7334"]
    got = texts_of(spark, texts)
    assert got[1]["text"] == texts[1]
    short, full = re.fullmatch(r"from ([0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4}::[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4}), ([0-9A-F]{4}(?::[0-9A-F]{4}){7})\.", got[0]["text"]).groups()
    assert surrogates._groups(short) == surrogates._groups(full) != surrogates._groups("2001:db8:85a3::8a2e:370:7334") and got[2]["text"] == f"x {short}"


def test_clashing_columns(spark):
    names = [chr(65 + i) + chr(97 + j) + "x" for i in range(26) for j in range(26)]  # so many that some are drawn again
    docs = spark.createDataFrame([(i, f"Mr {n} spoke.", "o", "m", "r", "a") for i, n in enumerate(names)], "doc_id long, text string, Again string, made string, row_name string, row_key string")
    rows = surrogates.replaced(docs, KEY).collect()
    assert len({r["text"] for r in rows}) == len(names) and {tuple(r)[2:6] for r in rows} == {("o", "m", "r", "a")}
