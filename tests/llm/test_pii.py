import hashlib
import random
import re

import pytest

from brindle.llm import boosting, pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def brute(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out[kind].append((m.start(), m.end()))
    return out


def check(df):
    rows = pii.digest(pii.find_spans(df)).collect()
    found = {}
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert len(rows) == df.count()
    for r in rows:
        want = brute(texts[r["doc_id"]])
        listed = [f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k]]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS]
        spans = [s for s in r["spans"].split(",") if s]
        assert set(listed) <= set(spans)
        keys = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert keys == sorted(keys)
        found[r["doc_id"]] = set(spans) - set(listed)
    return found


ODD = ["", None, "a@b.c_d@e.f x@y", "a@b.c@d.e", "..a@b-.c..d", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "256.1.1.1.1 1.1.1.255",
       "4111 1111 1111 1111, 4111111111111111-", "4111-1111 1111-1111", "4111  1111 1111 1111", "+1 (555) 123-4567--", "é🎉 +49 30 1234567 a.b@c.de 🎉 x@ß",
       "+1" + "2" * 30, "1" * 300, "a" * 5000 + "@" + "b" * 500, "a" * 5000 + "@" + "b" * 500 + ".c", "@@@a@b.c", "++1 23456789", "12 34-5678901234567890 1",
       "0" * 16, "0 0 " * 3000, "1.1.1.1" * 20, "+1+2345678+9", "a%b+c@d.e-f.g", "\n1.2.3.4\n"]


def test_base_spans_of_odd_texts(spark):
    check(spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, base_email string").repartition(3))


def test_base_spans_of_random_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("01256789..@@++-- ()aZ_%é") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_clean_documents_are_left_alone(documents):
    """Beside the base spans, prose gets next to none."""
    found = check(documents.select("doc_id", "text"))
    assert sum(map(len, found.values())) <= 2


def test_further_spans(spark):
    texts = ["please mail joe.17 [at] example [dot] com today", "call (555) 123-4567 now", "card 378282246310005 is mine", "we met at noon. dot on the i", "the 3 of us"]
    found = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kinds = [{s.split(":")[0] for s in found[i]} for i in range(5)]
    assert kinds == [{"email"}, {"phone"}, {"card"}, set(), set()]


def test_held_out_precision_and_recall(spark):
    """On texts from another seed."""
    texts = pii.training_texts(seed=99, count=600)
    df = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    found = check(df)
    good = total = real = 0
    for i, t, spans in texts:
        values = {v for _, v in spans}
        base = {t[a:b] for x in brute(t).values() for a, b in x}
        got = {t[int(s.split(":")[1]) : int(s.split(":")[2])].strip() for s in found[i]}
        good += len(got & values)
        total += len(got)
        real += len(values - base)
    assert good / total > 0.93 and good / real > 0.6


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.cd, +1 555 123 4567."), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()} == {1: "é [EMAIL], [PHONE].", 2: ""}


def test_plan_is_native(documents):
    plan = pii.digest(pii.find_spans(documents.sparkSession.range(1).selectExpr("id as doc_id", "'x' as text")))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


def test_empty(empty):
    assert pii.digest(pii.find_spans(empty)).collect() == []


def test_boosting_learns_an_interaction():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:400], y[:400])
    assert (((model.margin(x[400:]) > 0) == y[400:]).mean()) > 0.9


@pytest.mark.parametrize(("margins", "labels", "cut"), [([3.0, 2.0, 1.0], [1, 1, 0], 2.0), ([3.0, 3.0], [1, 0], float("inf"))])
def test_threshold(margins, labels, cut):
    import numpy as np

    assert boosting.threshold(np.array(margins), np.array(labels), 0.6) == cut


#: Written by hand, not by the training generator: (text, personal data in it).
OWN = [
    ("Please send the signed form to maria.lopez [at] gmail [dot] com before Friday.", "maria.lopez [at] gmail [dot] com"),
    ("Contact: h.schmidt(at)firma.de for details", "h.schmidt(at)firma.de"),
    ("you can write to support AT example DOT org any time", "support AT example DOT org"),
    ("Mi correo es juan_perez arroba hotmail punto com, gracias", "juan_perez arroba hotmail punto com"),
    ("e-mail: sales{at}my-shop.co", "sales{at}my-shop.co"),
    ("reach me at bob77 (at) mail.example (dot) net", "bob77 (at) mail.example (dot) net"),
    ("her mail is anna＠uni-koeln.de.", "anna＠uni-koeln.de"),
    ("Kontakt: info[at]verein-nord.de", "info[at]verein-nord.de"),
    ("Call us on (212) 555-0147 between nine and five.", "(212) 555-0147"),
    ("My cell is 415.555.2671, text me", "415.555.2671"),
    ("phone 303 555 0199 and ask for Jim", "303 555 0199"),
    ("Tel. 030 12345678", "030 12345678"),
    ("Handy: 0171/9876543 oder abends zuhause", "0171/9876543"),
    ("fax 089-665544", "089-665544"),
    ("Appelez le 06 12 34 56 78 demain", "06 12 34 56 78"),
    ("llame al 612 345 678 por la tarde", "612 345 678"),
    ("tel: 0049 221 4455667", "0049 221 4455667"),
    ("ring me on 555-0123 tonight", "555-0123"),
    ("Telefon (040) 334455 ist besetzt", "(040) 334455"),
    ("my amex card 3782 822463 10005 expires soon", "3782 822463 10005"),
    ("charge visa 4222222222222 please", "4222222222222"),
    ("The credit card 4111.1111.1111.1111 was declined", "4111.1111.1111.1111"),
    ("Konto DE89 3704 0044 0532 0130 00 bei der Bank", "DE89 3704 0044 0532 0130 00"),
    ("IBAN GB29NWBK60161331926819", "GB29NWBK60161331926819"),
    ("pay to account FR14 2004 1010 0505 0001 3M02 606 by Monday", "FR14 2004 1010 0505 0001 3M02 606"),
    ("iban: NL91 ABNA 0417 1643 00", "NL91 ABNA 0417 1643 00"),
    ("connect to 2001:db8:85a3::8a2e:370:7334 now", "2001:db8:85a3::8a2e:370:7334"),
    ("host fe80::1ff:fe23:4567:890a is down", "fe80::1ff:fe23:4567:890a"),
    ("ping 2001:0db8:0000:0000:0000:ff00:0042:8329", "2001:0db8:0000:0000:0000:ff00:0042:8329"),
    ("The server 192[.]168[.]10[.]5 answered", "192[.]168[.]10[.]5"),
    ("malware called 203(dot)0(dot)113(dot)77 twice", "203(dot)0(dot)113(dot)77"),
]
CLEAN = [
    "We met at noon. Dot was late, as ever.", "The meeting is at 10:30:15 on 2024-05-06.", "Order 4006381333931 has shipped.", "isbn 978-3-16-148410-0 is out of print",
    "std::vector and face::bead are names", "It cost 1 200 300 crowns in 1999 2000 2001", "part 555-0123 fits model 77", "On 01.02.2024 and 03/04/2025 nothing happened",
    "MAC aa:bb:cc:dd:ee:ff belongs to nobody", "Version 10.4.2 of build 20240131", "He looked at the dot on the page", "pi is 3.14159265358979", "room 212.4455 is closed",
    "a ratio of 3:2 or 16:9", "looked at home. com is a word", "serial 123-456-7890 of the pump",
]


def test_recall_on_texts_written_by_hand(spark):
    rows = [(i, t) for i, (t, _) in enumerate(OWN)] + [(1000 + i, t) for i, t in enumerate(CLEAN)]
    spans = pii.digest(pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    texts, missed, wrong = dict(rows), [], []
    for r in spans:
        got = {texts[r["doc_id"]][int(s.split(":")[1]) : int(s.split(":")[2])] for s in r["spans"].split(",") if s}
        if r["doc_id"] < 1000 and OWN[r["doc_id"]][1] not in got:
            missed.append((OWN[r["doc_id"]][1], got))
        if r["doc_id"] >= 1000 and got:
            wrong.append(got)
    assert len(missed) <= 0.1 * len(OWN), missed
    assert len(wrong) <= 2, wrong


@pytest.mark.parametrize("piece", ["+1 555 123 4567, ", "joe@a.bc ", "call 030 1234567, ", "x [at] y.com "])
def test_time_grows_with_the_text(spark, piece):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, piece * n)], "doc_id long, text string")
        began = time.time()
        pii.digest(pii.find_spans(df)).collect()
        return time.time() - began

    seconds(2000)
    small, large = seconds(16000), seconds(64000)
    assert large < max(4 * 2.3 * small, 8), (small, large)
