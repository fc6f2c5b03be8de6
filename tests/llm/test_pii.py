import pytest

from engramite.llm import pii
from tests.llm.frames import clashing, docs, prose

CASES = [
    ("mail me at jane.doe@example.com now", "email", "jane.doe@example.com", "jane.doe@example.com"),
    ("write jane (at) example (dot) com today", "email", "jane (at) example (dot) com", "jane@example.com"),
    ("write jane at example dot com today", "email", "jane at example dot com", "jane@example.com"),
    ("bob [at] mail.example.org", "email", "bob [at] mail.example.org", "bob@mail.example.org"),
    ("jаne@exаmple.com", "email", "jаne@exаmple.com", "jane@example.com"),
    ("ja​ne@exam​ple.com!", "email", "ja​ne@exam​ple.com", "jane@example.com"),
    ("call 555-123-4567 soon", "phone", "555-123-4567", "555-123-4567"),
    ("call five five five one two three four five six seven soon", "phone", "five five five one two three four five six seven", "5551234567"),
    ("card 4111 1111 1111 1111.", "card", "4111 1111 1111 1111", "4111 1111 1111 1111"),
    ("host 192.168.10.20 up", "ip", "192.168.10.20", "192.168.10.20"),
    ("id 123-45-6789", "ssn", "123-45-6789", "123-45-6789"),
    ("pay DE89 3704 0044 0532 0130 00 now", "iban", "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00"),
    ("write to jane at example.com please", "email", "jane at example.com", "jane@example.com"),
    ("ｊａｎｅ＠example．com", "email", "ｊａｎｅ＠example．com", "jane@example.com"),
]


@pytest.mark.parametrize(("text", "kind", "source", "value"), CASES)
def test_detects_and_maps_back(text, kind, source, value):
    assert [(k, text[a:b], v) for k, a, b, v in pii.detect(text)] == [(kind, source, value)]


@pytest.mark.parametrize("text", ["look at example.com or visit us at www.example.org", "we met at noon dot dot dot", "version 1.2.3.4.5", "card 4111 1111 1111 1112", "one two three", "999.1.1.1", "year 1999 and 2024", prose(4, 300)])
def test_leaves_clean_text_alone(text):
    assert [d for d in pii.detect(text) if d[0] != "phone"] == []


def test_screen_never_loses_a_finding(spark):
    texts = [prose(k, 30) + " " + c[0] + " " + prose(k + 99, 30) for k, c in enumerate(CASES)] + [prose(k, 50) for k in range(20)]
    got = sorted((r.doc_id, r.kind, r.start, r.end, r.value) for r in pii.findings(docs(spark, texts)).collect())
    assert got == sorted((i, *f) for i, t in enumerate(texts) for f in pii.detect(t))
    assert len(got) >= len(CASES)


def test_unedited_text_maps_to_itself():
    mapped = pii.normalised("plain ascii text")
    assert mapped.text == "plain ascii text" and mapped.start.tolist() == list(range(16)) and (mapped.end - mapped.start == 1).all()


def test_digits_of_every_script_are_screened(spark):
    texts = ["id ๑๒๓-๔๕-๖๗๘๙ end", "id ١٢٣-٤٥-٦٧٨٩ end", "id 𝟏𝟐𝟑-𝟒𝟓-𝟔𝟕𝟖𝟗 end", f"jane (at) {'a' * 45} (dot) {'b' * 45} (dot) com"]
    got = {r.doc_id: (r.kind, r.value) for r in pii.findings(docs(spark, texts)).collect()}
    assert got == {**{k: ("ssn", "123-45-6789") for k in range(3)}, 3: ("email", f"jane@{'a' * 45}.{'b' * 45}.com")}


def test_cases(spark):
    table = clashing(docs(spark, [CASES[0][0], CASES[0][0], None, "", CASES[0][0], prose(1, 20_000) + " " + CASES[0][0]], [1, 1, 2, 3, None, 4]))
    got = sorted(str(r.doc_id) for r in pii.findings(table).collect())
    assert got == ["1", "1", "4", "None"]
    assert pii.findings(docs(spark, [])).count() == 0


def test_dots_far_from_the_at():
    host = "a" * 63
    text = f"write name (at) {host} (dot) {'b' * 63} (dot) com today"
    assert [(k, v) for k, _, _, v in pii.detect(text)] == [("email", f"name@{host}.{'b' * 63}.com")]
    name = "c" * 31
    text = f"write {name} (dot) {'d' * 20} (dot) {'e' * 5}{' ' * 60}(dot) x (at) example (dot) com"
    assert [v for _, _, _, v in pii.detect(text)] == [f"{name}.{'d' * 20}.{'e' * 5}.x@example.com"]
