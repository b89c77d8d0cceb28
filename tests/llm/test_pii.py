import random
import re

from logstrata.llm import pii

from .brute import frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(int(c) for c in reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group())]


def test_base_spans():
    rnd = random.Random(7)
    pieces = ["a@b.com", "a@b", "_d@e.f-g.h", "@", ".", "1.2.3.4", "1.2.3.256", "0001.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+12", "+", " ", "é", "x", "9", "-", "@x.y", "%", "٣", "a.b@c.d.@e.f"]
    for _ in range(4000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 9)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "1.1." * 50_000, "+1" + "(" * 300_000, "a@" * 100_000, "a.b" * 100_000 + "@"):
        pii.base_spans(text)


def test_secrets_are_added_and_plain_numbers_left(spark):
    rnd, docs = random.Random(9), []
    for k in range(200):
        secret = "".join(rnd.choice("0123456789abcdef") for _ in range(32))
        key = "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(14)) + "27"
        docs.append((k, ["Plain words in Version 2.0 of 2019.", f'the token = "{secret}" is', f"password={secret[:16]} here", "number 2123465659789240 fails or part 12345", f"mail x{k}@mail.example.com now", f"access {key} given"][k % 6]))
    docs += [(500, None), (501, ""), (None, "a@b.co"), (3, "again 10.0.0.1")]
    found = pii.personal_data(frame(spark, docs)).collect()
    assert len(found) == len(docs)
    for r in found:
        text = next((t for k, t in docs if k == r.doc_id and (k != 3 or ("again" in t) == bool(r.base))), None)
        if r.doc_id is not None and text is not None:
            assert [tuple(s) for s in r.base] == brute(text)
            added = [text[s.start : s.end] for s in r.added]
            assert bool(added) == any(w in text for w in ("token", "password", "access")), (text, added)
    assert pii.personal_data(frame(spark, []).where("false")).collect() == []


def values(text):
    return [text[c[1] : c[2]] for c in pii.scan(text)[1]]


def test_candidates():
    assert values("write to jane(at)mail(dot)org, or (joe[at]mail[dot]org).") == ["jane(at)mail(dot)org", "joe[at]mail[dot]org"]
    assert values("password=CorrectHorse and colour=blue, note=") == ["password=CorrectHorse"]
    assert values("her 123 45 6789, then (020) 7946 0958. and 12x 45 678y 9") == ["123 45 6789", "(020) 7946 0958"]
    assert values("x 12 34 56,z 7 8") == ["12 34"]
    assert pii.kind_of("jane(at)mail(dot)org") == "contact" and pii.kind_of("123 45 6789") == "number"


def test_only_refused_matches_fail_the_check():
    name = pii.LABELERS.index("failed check")
    failed = lambda text: {text[c[1] : c[2]]: c[3] // 3 ** (len(pii.LABELERS) - 1 - name) % 3 == pii.BAD for c in pii.scan(text)[1]}
    assert failed("his 123-45-6789 or 123 45 6789 or (020)7946-0958") == {"123-45-6789": False, "123 45 6789": False, "020)7946-0958": False}
    assert failed("at 1.2.3.256 with 2123465659789240 or 41111 11111 111112 or +12345") == {k: True for k in ("1.2.3.256", "2123465659789240", "41111", "11111", "111112", "41111 11111 111112", "+12345")}


def test_candidates_take_linear_time():
    for text in ("1 " * 200_000, "1 " * 200_000 + "1,x", "(" * 300_000 + "1 2", "1 2" + "," * 300_000 + "x", "a(at)" * 80_000, "1-" * 200_000):
        pii.scan(text)


def test_addresses_secrets_and_numbers_without_digits_or_in_groups_are_added(spark):
    rnd, docs = random.Random(4), []
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for k in range(300):
        ssn = f"{rnd.randint(100, 899)} {rnd.randint(10, 99)} {rnd.randint(1000, 9999)}"
        docs.append((k, [f"write {letters(5)}(at){letters(6)}(dot)org soon", f"then password={letters(7).title()}{letters(6).title()} here", f"my ssn {ssn} is", "plain words of page 12 in 2019", f"mail {letters(6)}@mail.example.com now", f"call {ssn[:3]} {ssn[-4:]} today"][k % 6]))
    found = {r.doc_id: r for r in pii.personal_data(frame(spark, docs)).collect()}
    for k, text in docs:
        added = [text[s.start : s.end] for s in found[k].added]
        assert bool(added) == (k % 6 in (0, 1, 2, 5)), (text, added)
