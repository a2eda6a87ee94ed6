import ipaddress
import json
import random
import re
from datetime import date, timedelta

from wanderframe.llm import pii, queries

KEY = b"k" * 32


def valid(d):
    return pii.luhn_digit(d[:-1]) == d[-1]


def test_permutation_is_one():
    for n in (1, 2, 10, 97, 1000, 4096):
        assert sorted(pii.permuted(i, n, KEY, "t") for i in range(n)) == list(range(n))


def test_formats_stay():
    text = "a.b@mail.example.com +1 (743) 555-3824 4785380592391139 10.20.30.40 2024-02-29 29/02/2024 123-45-6789 GB82 WEST 1234 5698 7654 32 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" 4785-3805-9239-1139"
    new, found = pii.pseudonymize(text, KEY)
    assert [k for k, _, _ in found] == ["email", "phone", "card", "ip", "date", "date", "national_id", "iban", "secret", "card"]
    assert len(re.sub(r"\d+\.\d+\.\d+\.\d+", "", new)) == len(re.sub(r"\d+\.\d+\.\d+\.\d+", "", text))
    part = {k: new[s : s + n] for k, s, n in found}
    assert all(p not in text for p in part.values())
    digits = re.sub(r"\D", "", part["card"])
    assert valid(digits) and digits[0] == "4" and part["card"].count("-") == 3
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", part["phone"])
    assert pii.number97(part["iban"].replace(" ", "")[4:] + part["iban"].replace(" ", "")[:4]) % 97 == 1
    d, m, y = map(int, part["date"].split("/"))
    assert date(y, m, d)
    first = next(new[s : s + n] for k, s, n in found if k == "date")
    assert date.fromisoformat(first) == date(y, m, d)  # one day in two formats stays one day
    assert re.fullmatch(r"[0-9a-f]{40}", part["secret"])
    assert all(0 <= int(o) < 256 for o in part["ip"].split("."))


def test_what_is_not_valid_stays():
    for t in ("2123465659789240", "999.1.1.1", "2024-02-30", "000-12-3456", "1.2.3", "version 10.2", "GB00 WEST 1234 5698 7654 32", "a@b", "12345678901234567890123", "words only", "4785380592391138"):
        assert pii.pseudonymize(t, KEY) == (t, []), t


def test_equal_values_stay_linked():
    a, _ = pii.pseudonymize("x 4785380592391139 y", KEY)
    b, _ = pii.pseudonymize("4785380592391139", KEY)
    assert a[2:-2] == b
    assert pii.pseudonymize("4785380592391139", b"z" * 32)[0] != b


def test_documents(spark, docs_of):
    pairs = [(1, "mail a.b@mail.example.com twice a.b@mail.example.com"), (2, None), (3, ""), (None, "10.0.0.1"), (1, "mail a.b@mail.example.com twice a.b@mail.example.com"), (4, "long " * 20000 + "10.0.0.1")]
    got = pii.pseudonymize_documents(docs_of(pairs), "key").collect()
    assert [r.doc_id for r in got] == [1, 2, 3, None, 1, 4] and got[0].text == got[4].text and got[0].kept == "k"
    assert got[0].pii_counts == {"email": 2} and got[1].text is None and got[2].pii_spans == []
    assert got[5].text.endswith(got[3].text)
    s = got[0].pii_spans
    assert got[0].text[s[0].start :][: s[0].length] == got[0].text[s[1].start :][: s[1].length]
    assert pii.pseudonymize_documents(docs_of([]), "key").count() == 0
    assert pii.pseudonymize_documents(docs_of(pairs), "key", counts=None, spans=None).columns == docs_of(pairs).columns


def test_secrets_in_upper_case():
    low = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    want, _ = pii.pseudonymize(f"token={low}", KEY)
    for name in ("TOKEN = ", "API_KEY=", "Password: ", "Access-Key="):
        for value in (low, low.upper()):
            new, found = pii.pseudonymize(name + value, KEY)
            assert [k for k, _, _ in found] == ["secret"] and value not in new
            assert new == name + (want[6:].upper() if value != low else want[6:])
    assert pii.pseudonymize("PASSWORD=QwErTyUiOpAsDfGh", KEY)[1]


def luhn_ok(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def iban_ok(v):
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def planted(rng):
    """(kind or None where the value is not valid, value, what stands before it)."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    good, bad = [], []
    while len(good) < 3:
        c = "4" + digits(15)
        (good if luhn_ok(c) else bad).append(c)
    body = digits(14)
    iban = next(f"DE{k:02d}{body}" for k in range(100) if iban_ok(f"DE{k:02d}{body}"))
    d = date(1950, 1, 1) + timedelta(rng.randrange(30_000))
    hexa = "".join(rng.choice("0123456789abcdef") for _ in range(36))
    return [
        ("email", f"{rng.choice('xyz')}{digits(2)}.b@mail-{rng.choice('pq')}.example.com", ""), ("card", good[0], ""), (None, bad[0], ""), ("iban", iban, ""), ("date", d.isoformat(), ""),
        ("date", f"{d.day}/{d.month}/{d.year}", ""), (None, f"{d.year}-02-30", ""), ("ip", f"10.{rng.randrange(256)}.0.{rng.randrange(256)}", ""), (None, "10.300.0.1", ""), ("national_id", f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", ""),
        ("phone", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", ""), ("phone", f"415555{digits(4)}", ""), (None, f"17000{digits(5)}", ""), ("secret", hexa, "token = "), ("secret", hexa.upper(), "API_KEY="), ("secret", f"pass{digits(4)}", "Password: "), (None, "required", "password: "), ("secret", "AKIA" + hexa[:16].upper(), ""),
        ("ipv6", f"2001:db8::{hexa[:4]}:{hexa[4:8]}", ""), (None, "12:30:45", ""),
    ]


def test_query_against_what_was_planted(spark, tmp_path):
    """Every valid value is replaced, nothing else is; pseudonyms are valid and one to one."""
    rng = random.Random(9)
    pool = [v for _ in range(12) for v in planted(rng)]
    rows, want = [], {}
    for i in range(300):
        text, spans = "", []
        for _ in range(rng.randint(0, 6)):
            kind, value, before = rng.choice(pool)
            text += rng.choice(["lorem ", "ipsum dolor\n", "(sit) ", "\u00e9t\u00e9 "]) + before
            if kind:
                spans.append((kind, len(text), value))
            text += value + rng.choice([" ", "\n", ", "])
        rows.append((i, text + "end"))
        want[i] = spans
    rows += [(900, None), (901, ""), (902, "word " * 50_000)]
    spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, spans long").write.parquet(f"file://{tmp_path}/documents.parquet")
    texts, names, seen = dict(rows), {}, 0
    for r in queries.op7_pseudonyms(spark, f"file://{tmp_path}").collect():
        if r.doc_id >= 900:
            assert (r.text, r.n_replaced) == (texts[r.doc_id], 0)
            continue
        found = json.loads(r.spans)
        assert [x["kind"] for x in found] == [k for k, _, _ in want[r.doc_id]], texts[r.doc_id]
        at = now = 0
        for x, (kind, start, value) in zip(found, want[r.doc_id], strict=True):
            assert r.text[now : x["start"]] == texts[r.doc_id][at:start]
            new = r.text[x["start"] : x["start"] + x["length"]]
            at, now = start + len(value), x["start"] + x["length"]
            assert names.setdefault((kind, value), new) == new
            seen += 1
            if kind == "card":
                assert luhn_ok(new) and len(new) == len(value)
            elif kind == "iban":
                assert iban_ok(new)
            elif kind in ("ip", "ipv6"):
                ipaddress.ip_address(new)
            elif kind == "date":
                y, m, d = map(int, new.split("-") if "-" in new else reversed(new.split("/")))
                assert date(y, m, d) and (len(new) == 10 if len(value) == 10 else not re.search(r"(?<!\d)0", new))
            elif kind == "email":
                assert re.fullmatch(r"[a-z]\d\d\.[a-z]@[a-z]{4}-[a-z]\.[a-z]{7}\.com", new)
            else:
                assert re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", new)) == re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", value)) or kind == "secret"
        assert r.text[now:] == texts[r.doc_id][at:]
    assert seen > 500 and len(set(names.values())) == len(names)


def test_spellings_of_one_address_stay_linked():
    a, b = (pii.pseudonymize(t, KEY)[0] for t in ("Bob.X@Mail.com", "bob.x@mail.com"))
    assert a.lower() == b and a != b and a[0].isupper()


def digits(s):
    return re.sub(r"\D", "", s)


def test_spellings_of_one_number_stay_linked():
    """Phones bare and laid out, days with and without zeros, addresses short and long."""
    rng = random.Random(4)
    for _ in range(200):
        d = f"{rng.randint(2, 9)}{rng.randint(0, 99):02d}{rng.randint(2, 9)}{rng.randint(0, 999999):06d}"
        bare, dashed, country = (pii.pseudonymize(t, KEY)[0] for t in (d, f"{d[:3]}-{d[3:6]}-{d[6:]}", f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}"))
        assert bare != d and bare == digits(dashed) == digits(country)[1:]
    for y, m, d in ((2024, 1, 5), (1999, 12, 3), (2031, 10, 10)):
        new = [pii.pseudonymize(t, KEY)[0] for t in (f"{y}-{m:02d}-{d:02d}", f"{y}-{m}-{d}", f"{y}/{m}/{d}", f"{d:02d}.{m:02d}.{y}")]
        days = [tuple(map(int, re.split("[-/.]", t))) for t in new]
        assert days[0] == days[1] == days[2] == days[3][::-1] and days[0] != (y, m, d)
    full, short = (pii.pseudonymize(t, KEY)[0] for t in ("2001:0db8:0000:0000:0000:0000:0000:0001", "2001:db8::1"))
    assert ipaddress.ip_address(full) == ipaddress.ip_address(short) != ipaddress.ip_address("2001:db8::1") and len(full) == 39
    assert pii.pseudonymize("::1 0000:0000:0000:0000:0000:0000:0000:0001", KEY)[1] == []


def test_secrets_behind_prefixes_and_bearers():
    value = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f"MY_TOKEN={value}", f"aws_secret_access_key = {value}", f"Authorization: Bearer {value}", f'"authorization": "Basic {value}"', f"x-api-key: {value}", f"token={value}"]
    new = [pii.pseudonymize(t, KEY) for t in texts]
    assert all(value not in t and [k for k, _, _ in found] == ["secret"] for t, found in new)
    assert len({t[s : s + n] for t, [(_, s, n)] in new}) == 1
    assert "hunter2xyz" not in pii.pseudonymize("db_password=hunter2xyz", KEY)[0]
    for t in ("the bearer of this letter", "my tokens = words", "secretary: Mr. Smithson"):
        assert pii.pseudonymize(t, KEY) == (t, [])


def test_columns_of_result_names_are_replaced(spark):
    rows = spark.createDataFrame([(1, "call 212-555-0142", "mine", 3)], "doc_id long, text string, pii_counts string, pii_spans int")
    r = pii.pseudonymize_documents(rows, "k").first()
    assert r.pii_counts == {"phone": 1} and r.pii_spans[0].kind == "phone" and "212-555-0142" not in r.text


def test_the_key_is_a_setting(spark):
    assert queries.pseudonym_key(spark) == queries.PSEUDONYM_KEY
    spark.conf.set(queries.PSEUDONYM_SETTING, "other")
    assert queries.pseudonym_key(spark) == "other"
    spark.conf.unset(queries.PSEUDONYM_SETTING)
