import hashlib
import random
import re

from glasspane.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]


def base(text):
    return [s for s in pii.find(text, pii.automaton()) if s[0] in PATTERNS]


def test_base_kinds_equal_the_patterns():
    machine, r = pii.automaton(), random.Random(5)
    for alphabet in ("0123 .-", "ab@.-", "+01 ().-x", "0125.@ab+- é(", "4 1-"):
        for _ in range(4000):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert [s for s in pii.find(text, machine) if s[0] in PATTERNS] == brute(text), text


def test_hand_cases():
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4111  1111 1111 1111", "411111111111111"]
    assert [bool(base(x)) for x in cards] == [True, True, True, False, False]
    assert base("x 1.2.3.4.5.6.7.8 y") == [("ip", 2, 9), ("ip", 10, 17)]
    assert base("256.1.1.1 1.1.1.1") == [("ip", 10, 17)]
    assert base("a@b@c.d, a@b.c@d.e") == [("email", 2, 7), ("email", 9, 14)]
    assert base("é+1 (389) 555-5010.") == [("phone", 1, 18)]
    assert base("9" * 5000) == [] and base("0" * 4400 + ".1.1.1") == [("ip", 0, 4406)]


def test_accounts():
    one = lambda t: [s for s in pii.find(t, pii.automaton()) if s[0] == "account"]
    assert one('token = "24be64439e3e49cf"') == [("account", 9, 25)]
    assert one("PASSWORD: hunter2hunter2") == [("account", 10, 24)]
    assert one("the token was lost, secret = nothing here") == [] and one("secretarial = 12345678") == []
    assert one("IBAN DE89 3704 0044 0532 0130 00.") == [("account", 5, 32)] and one("IBAN DE89 3704 0044 0532 0130 01.") == []
    assert one("see https://joe:s3cret@example.com/x") == [("account", 12, 22)] and one("https://example.com/a:b@c") == []


SECRETS = [
    ("password: {}", "Hunter2!secretXY99"), ('api_key = "{}"', "abc1$def123456789"), ("secret: {}.", "s3cr3t#pass.word"), ("token={}", "eyJhbGciOiJI1.eyJzdWIiOiIx.SflKxwRJ"),
    ("Secret_Key={}", "9fk30dkfl2"), ("passWord={}", "kd93kdl2"), ("(PassWord: {})", "kd93kdl2"), ("account number: {},", "12345678901"), ("my IBAN is not here, iban {} it is", "de89370400440532013000"),
    ("see http://{}@host.org/x", "u:p:w1"), ("see https://{}@host.org", "joe:a@b@c"), ("{{\"client_secret_id\": \"{}\"}}", "a1-b2,c3;d4"), ("authToken := '{}'", 'q"w1e2r3t4'), ("İ TOKEN={}", "abcd1234"), ("secret = {}", "Correct+Horse!s"), ('password=token="{}"', "abcd1234"),
]


def test_secrets_are_found_whole_and_redacted():
    for form, value in SECRETS:
        text = form.format(value)
        found = [text[a:b] for k, a, b in pii.find(text, pii.automaton()) if k == "account"]
        assert found == [value], (text, found)
        left = pii.redact(text, pii.find(text, pii.automaton()))
        assert "<ACCOUNT>" in left and ("@" in text or left == form.format("<ACCOUNT>")) and not any(value[i : i + 4] in left for i in range(len(value) - 3)), left
    for text in ("secret: nothing-to-see", "token: https://a.b/c12345678", "account: joe99@example.com", "the secretarial=12345678", "passport control 12345678", "password:", "token = <ACCOUNT>", "iban is de00123"):
        assert not [s for s in pii.find(text, pii.automaton()) if s[0] == "account"], text


def test_accounts_of_any_length_and_in_linear_time():
    import time

    machine = pii.automaton()
    one = lambda t: [s for s in pii.find(t, machine) if s[0] == "account"]
    gap = " " * 5000
    assert one(f"token{gap}={gap}abcd1234") == [("account", 10_006, 10_014)] and one(f"iban{gap}DE89370400440532013000") == [("account", 5004, 5026)]
    assert one("http://joe:" + "x" * 9000 + "@a.b") == [("account", 7, 9011)]
    began = time.perf_counter()
    for part in ("http://a:b", "token = ", "token" + " " * 50, "iban ", "iban DE89 ", "http://" + "a" * 50, "secret=1 ", "http://a:b@", "http:a:@", "secret-", "token number ", "password=", "token=http://", "token=a@b.c"):
        one(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 60


def test_redaction():
    text = 'mail a.b@c.org or +1 (389) 555-5010, token = "9b0b3c6a43eb78aa99cb"'
    assert pii.redact(text, pii.find(text, pii.automaton())) == 'mail <EMAIL> or <PHONE>, token = "<ACCOUNT>"'
    assert pii.redact("abcdef", [("x", 1, 3), ("y", 2, 5)]) == "a<X>f" and pii.redact("abc", []) == "abc"


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


def test_rows(spark):
    rows = [(1, "a@b.cd", 9), (1, "a@b.cd", 9), (None, "1.2.3.4", 1), (2, None, 0), (3, "", 0), (4, "é " * 50_000 + "+1 389 555 5010", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, len(r.spans)) for r in pii.spans(docs).collect()), key=str)
    assert got == sorted([(1, 1, 0, 0, 0, 1)] * 2 + [(None, 0, 1, 0, 0, 1), (2, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0), (4, 0, 0, 0, 1, 1)], key=str)
    assert pii.spans(docs.where("false")).collect() == []
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns
    assert sorted((r.text or "null")[-7:] for r in clean.collect()) == sorted(["<EMAIL>", "<EMAIL>", "<IP>", "null", "null", "<PHONE>"])


def test_query_over_a_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in pii.op2_pii_spans(spark, d).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        want = brute(t)
        assert got[i].base_sha256 == digest(want)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got[i].spans.split(","))
    assert sum(r.n_card for r in got.values()) > 0 < sum(r.n_email for r in got.values())
