import hashlib
import re

from helpers import odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionmill.llm import pii

# The patterns of the contract, searched in the plainest way.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = sum(int(c) for c in digits[::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


def found(text):
    return {k: [text[a:b] for a, b in v] for k, v in pii.disguised(text, pii.detect(text)).items() if v}


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab@.-109 25+(_%)é", max_size=40))
def test_plain_spans_are_those_of_the_patterns(text):
    assert pii.detect(text) == brute(text)


def test_cards_phones_and_limits():
    for text in ("4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999.", "+12345678901234567", "256.1.1.1 1.2.3.4.5.6.7.8", "a@b.c_d@e.f a@b.c@d.e"):
        assert pii.detect(text) == brute(text)
    assert pii.detect("4111 1111 1111 1111")["card"] == [(0, 19)]


def test_disguises_map_back_to_the_source():
    assert found("write jane.doe [at] mail (dot) example (dot) com now") == {"email": ["jane.doe [at] mail (dot) example (dot) com"]}
    assert found("jane dot doe at mail dot example dot com") == {"email": ["jane dot doe at mail dot example dot com"]}
    assert found("é ｊａｎｅ＠example．com é") == {"email": ["ｊａｎｅ＠example．com"]}
    assert found("x us​er@exam​ple.com x") == {"email": ["us​er@exam​ple.com"]}
    assert found("ip one nine two dot one six eight dot zero dot one!") == {"ip": ["one nine two dot one six eight dot zero dot one"]}
    assert found("plus one five five five zero one zero nine nine") == {"phone": ["plus one five five five zero one zero nine nine"]}
    spelled = " ".join(["four"] + ["one"] * 15)
    assert found(f"card {spelled} ok") == {"card": [spelled]}


def test_clean_text_is_left_alone():
    for text in ("meet me at noon. the dot com era", "one two buckle my shoe, at home", "look at example.com", "[at] (dot)", "1.2.3", "Zwölf – plus one"):
        assert found(text) == {} and not any(pii.detect(text).values())


def test_plain_spans_stay_beside_added_ones():
    text = "real@example.com and other (at) example (dot) org, аdmin@example.com"
    plain = pii.detect(text)
    assert plain == brute(text) and found(text) == {"email": ["other (at) example (dot) org"]}


def test_hint_admits_all_disguises():
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = ["jane (at) b.c", "a dot b", "ｊ", "one two three", "plain text of kings, größer"]
    assert pc.match_substring_regex(pa.array(texts), pii._HINT).to_pylist() == [True, True, True, True, False]


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 100_000, "a@" * 100_000, "+1-" * 100_000, "one " * 50_000, "a.b@" + "c." * 100_000):
        pii.disguised(text, pii.detect(text))


def test_table_of_odd_rows(spark):
    docs = odd_docs(spark, [(1, "a@b.cd 1.2.3.4"), (1, "a@b.cd 1.2.3.4"), (2, None), (3, ""), (None, "+1 555 010 9999"), (4, "é" * 9 + "a (at) b.cd")])
    rows = sorted(pii.find_pii(docs).collect(), key=str)
    assert len(rows) == 6
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[1].n_email, by_id[1].n_ip, by_id[1].spans) == (1, 1, "email:0:6,ip:7:14")
    assert by_id[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert by_id[2].spans == by_id[3].spans == "" and by_id[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert (by_id[None].n_phone, by_id[4].n_email, by_id[4].n_added, by_id[4].spans) == (1, 0, 1, "email:9:20")
    assert pii.find_pii(docs.where("false")).collect() == []
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns and {r.text for r in masked.collect()} == {"[email] [ip]", None, "", "[phone]", "é" * 9 + "[email]"}


def test_partly_disguised_identifiers_are_found_whole(spark):
    cases = ["j\u043ehn.doe@example.com", "john@mail.ex\u0430mple.com", "1\uff192.168.0.1", "+1 555 010 99\uff19\uff19"]
    docs = odd_docs(spark, list(enumerate(f"x {c} y" for c in cases)))
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    masked = {r.doc_id: r.text for r in pii.mask_pii(docs).collect()}
    for i, (case, kind) in enumerate(zip(cases, ("email", "email", "ip", "phone"), strict=True)):
        text = f"x {case} y"
        assert f"{kind}:2:{2 + len(case)}" in rows[i].spans.split(",") and rows[i].n_added == 1
        assert rows[i].base_sha256 == hashlib.sha256(pii._line(brute(text)).encode()).hexdigest()
        assert masked[i] == f"x [{kind}] y"


def test_plain_disguises_are_found(spark):
    cases = ["jane @ example.com", "jane@ example.com", "jane.doe at example.com", "+1 555 010 nine nine 9 9", "+1 555 010 99 nine nine"]
    docs = odd_docs(spark, [(i, f"({c}) y") for i, c in enumerate(cases)] + [(9, "email: jane at example.com")])
    rows = {r.doc_id: r.spans.split(",") for r in pii.find_pii(docs).collect()}
    for i, (case, kind) in enumerate(zip(cases, ["email"] * 3 + ["phone"] * 2, strict=True)):
        assert f"{kind}:1:{1 + len(case)}" in rows[i], (case, rows[i])
    assert rows[9] == ["email:7:26"]
    for text in ("apples @ 3.50", "look at example.com", "we met at www.example.com", "going to look at example.com", "contact us at example.com", "chapter 3 one day"):
        assert found(text) == {}


def test_addresses_with_very_many_zeros(spark):
    text = "0" * 5000 + "1.2.3.4 and 0256.1.1.1 and " + "9" * 5000 + ".1.1.1"
    docs = spark.createDataFrame([("x", text)], "doc_id string, text string")
    row = pii.find_pii(docs).first()
    assert (row.doc_id, row.n_ip) == ("x", 1) and "ip:0:5007" in row.spans
