"""Personal data by candidate gradient boosting (native).

High-recall generators propose spans of four kinds (email, ip, card, phone), which may overlap.
The base patterns' valid matches always stay.  Further candidates (spelled-out addresses, national
and local numbers, other card layouts, IBANs, IPv6, defanged IPv4...) that are clear of base spans
are described by format features (digits, separators, check digits...) and context features
(neighbouring characters, telling words before them), scored by boosted trees, and selected by a
threshold for each kind that is calibrated for precision on training texts kept out of the fit.
Of a run of overlapping selected ones the best stays.

Training texts are generated from a seed (a few thousand, the documented bound) and go through
the same generators and features; the trees are fitted on the driver and scored as SQL.

Work grows as n log n with the length of a text and its matches: positions are running sums over
the pieces between matches, context comes from those pieces, and overlaps are found by running
maxima over sorted spans (each a scan that doubles its reach).  Patterns are possessive or bounded
and start only where a run starts.

Defined cases: null and empty texts have no spans; positions are code points, end exclusive;
repeated rows give repeated results; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, rewritten so that they find the same matches in linear time.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass before its pattern is tried.
HINT = {"email": "contains(text, '@')", "ip": "contains(text, '.')", "card": "true", "phone": "contains(text, '+')"}
AT = r"(?:\x20?(?:[\[({<](?i:at|a|arroba|arobase)[\])}>]|＠)\x20?|\x20(?i:at|arroba|arobase)\x20)"
DOT = r"(?:\x20?(?:[\[({<](?i:dot|punkt|punto|point)[\])}>]|[.．])\x20?|\x20(?i:dot|punkt|punto|point)\x20)"
HEX = "[0-9A-Fa-f]{1,4}"
#: Generators of further candidates; each match is one candidate.
MORE = {
    "email": rf"(?<!{LOCAL}){LOCAL}{{1,64}}+{AT}[A-Za-z0-9-]{{1,63}}+(?:{DOT}[A-Za-z0-9-]{{1,63}}+){{1,4}}+",
    "ip": (
        rf"(?<![0-9A-Za-z:.])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}}|::(?:{HEX}:){{0,6}}{HEX}"
        r"|[0-9]{1,3}(?:\x20?(?:[\[({](?:\.|dot)[\])}])\x20?[0-9]{1,3}){3})(?![0-9A-Za-z:])"
    ),
    "card": (
        r"(?<![0-9A-Za-z.])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
        r"|[0-9](?:[\x20./-]?[0-9]){12,18}+(?![0-9]))"
    ),
    "phone": (
        r"(?<![0-9A-Za-z+(.])(?:\(?[0-9]{3}\)?[\x20./-]{1,2}[0-9]{3}[\x20./-][0-9]{4}"
        r"|\(?(?:00|0)[1-9](?:[\x20./()-]{0,2}[0-9]){5,12}+|[6-9][0-9]{2}(?:[\x20.-][0-9]{3}){2}|[2-9][0-9]{2}[.-][0-9]{4})(?![0-9])"
    ),
}
MORE_HINT = {
    "email": r"rlike(text, '[\\[({<](?i:at|a|arroba|arobase)[\\])}>]|\\x20(?i:at|arroba|arobase)\\x20|\\uFF20')",
    "ip": r"contains(text, ':') or rlike(text, '[0-9]\\x20?[\\[({](\\.|dot)')",
    "card": "true",
    "phone": "true",
}
#: Words that tell of each kind when they stand shortly before it, and words that tell of something else.
TELLING = {
    "email": "mail|e-mail|email|contact|kontakt|contacto|write|reach|schreib|escrib|correo|courriel|adresse|address",
    "ip": "ip|ipv6|host|server|servidor|serveur|address|adresse|ping|ssh|node|gateway|connect",
    "card": "card|visa|master|amex|credit|account|konto|kreditkarte|karte|tarjeta|carte|cuenta|compte|iban|pay|zahl",
    "phone": "call|tel|phone|fon|cell|mobile|handy|fax|ruf|anruf|telefon|llam|appel|movil|móvil|text|dial|ring|sms|whatsapp",
}
OTHER = "part|order|item|version|date|isbn|page|room|serial|sku|invoice|ref|ticket|bestell|pedido|commande|seite|number of|between|lot|model|build|release"
BEFORE = 24
SEED = 20_240_101
TEXTS = 3000
PRECISION = 0.95
SPAN = "struct<s: int, e: int, b: int, z: int, m: string, before: string, after: string>"
NONE = f"cast(array() as array<{SPAN}>)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(array: str, join: str) -> str:
    """SQL: running combination of an array; join combines v with w, the one 2^k places before."""
    step = join.replace("{w}", "a[i - shiftleft(1, k)]")
    return (
        f"transform(array({array}), r -> aggregate(sequence(0, int(ceil(log2(greatest(size(r), 2)))) - 1), r, "
        f"(a, k) -> transform(a, (v, i) -> if(i >= shiftleft(1, k), {step}, v))))[0]"
    )


SUM, MOST, LEAST = "v + {w}", "greatest(v, {w})", "least(v, {w})"


def _located(pattern: str, hint: str) -> str:
    """SQL: array of matches of the pattern in text: start and end (code points), the same in bytes,
    the match, and what stands before and after it."""
    p = _quoted(pattern)

    def starts(length: str) -> str:
        return _running(f"transform(h, (m, i) -> {length}(x.cut[i]) + if(i = 0, 0, {length}(h[i - 1])))", SUM)

    each = (
        "transform(h, (m, i) -> struct(y.s[i] as s, y.s[i] + length(m) as e, y.b[i] as b, y.b[i] + octet_length(m) as z, m as m, "
        f"right(concat(if(i = 0, '', h[i - 1]), x.cut[i]), {BEFORE}) as before, "
        "left(if(x.cut[i + 1] = '' and i + 1 < size(h), h[i + 1], x.cut[i + 1]), 1) as after))"
    )
    return (
        f"if({hint}, transform(array(regexp_extract_all(text, {p}, 0)), h -> if(size(h) = 0, {NONE}, "
        f"transform(array(struct(split(text, {p}, -1) as cut)), x -> "
        f"transform(array(struct({starts('length')} as s, {starts('octet_length')} as b)), y -> {each})[0])[0]))[0], {NONE})"
    )


def _luhn(digits: str) -> str:
    """SQL: does the digit string pass the check?  Doubled digits: every second from the right."""
    return (
        f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + transform(array(int(substring({digits}, -i, 1)) * if(i % 2 = 0, 2, 1)), "
        "d -> if(d > 9, d - 9, d))[0]) % 10 = 0"
    )


def _mod97(code: str) -> str:
    """SQL: does a code of letters and digits pass an account number's check?"""
    digit = "ascii(substring(t, i, 1))"
    return (
        f"transform(array(concat(substring({code}, 5), left({code}, 4))), t -> aggregate(sequence(1, length(t)), 0, (a, i) -> "
        f"if({digit} >= 65, (a * 100 + {digit} - 55) % 97, (a * 10 + {digit} - 48) % 97)) = 1)[0]"
    )


DIGITS = "regexp_replace(c.m, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": (
        "forall(split(c.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(int(nullif(ltrim('0', p), '')), 0) <= 255)"
    ),
    "card": f"length({DIGITS}) between 16 and 19 and {_luhn(DIGITS)}",
    "phone": f"length({DIGITS}) between 8 and 15",
}

NAMES = [
    "kind", "size", "digits", "marks", "letters", "upper", "groups", "luhn", "mod97", "lead", "same", "told", "other",
    "glued_before", "glued_after", "bracketed", "ending", "dots", "colons", "paren",
]


def _told(words: str) -> str:
    return f"int(rlike(lower(c.before), '(?:^|[^a-zà-ÿ])(?:{words})'))"


def _features(kind: int) -> str:
    """SQL: named struct of a candidate c's features, all doubles."""
    code = "regexp_replace(c.m, '[^A-Z0-9]', '')"
    values = [
        f"{kind}",
        "length(c.m)",
        f"length({DIGITS})",
        "length(regexp_replace(c.m, '[^(){}. /:@\\\\[\\\\]-]', ''))",
        "length(regexp_replace(c.m, '[^A-Za-z]', ''))",
        "length(regexp_replace(c.m, '[^A-Z]', ''))",
        "size(split(c.m, '[^A-Za-z0-9]+'))",
        f"int(length({DIGITS}) > 0 and {_luhn(DIGITS)})" if kind == 2 else "0",
        f"int(rlike(c.m, '^[A-Z]') and {_mod97(code)})" if kind == 2 else "0",
        f"coalesce(int(nullif(left({DIGITS}, 1), '')), -1)",
        f"if(length({DIGITS}) = 0, 0, size(array_distinct(split({DIGITS}, ''))))",
        _told(TELLING[KINDS[kind]]),
        _told(OTHER),
        "int(rlike(right(c.before, 1), '[A-Za-z0-9.]'))",
        "int(rlike(c.after, '[A-Za-z0-9]'))",
        "int(rlike(c.m, '[\\\\[({<]|\\uFF20'))",
        "int(rlike(c.m, '(?i)[^a-z](?:com|org|net|de|fr|es|edu|gov|io|info|co|uk|eu|ch|it|us)$'))",
        "size(regexp_extract_all(c.m, '[.]', 0))",
        "size(regexp_extract_all(c.m, ':', 0))",
        "int(contains(c.m, '('))",
    ]
    return "struct(" + ", ".join(f"double({v}) as {n}" for v, n in zip(values, NAMES)) + ")"


def _free(spans: str, others: str) -> str:
    """SQL: the spans that overlap none of the others.  All are sorted by start; a span is free if those
    before it have ended and the next of the others starts behind its end."""
    merged = (
        f"array_sort(concat(transform({others}, c -> struct(c.s as s, c.e as e, -1 as k)), "
        f"transform({spans}, (c, k) -> struct(c.s as s, c.e as e, k as k))))"
    )
    ended = _running("transform(q, c -> if(c.k < 0, c.e, 0))", MOST)
    ahead = f"reverse({_running('reverse(transform(q, c -> if(c.k < 0, c.s, 2147483647)))', LEAST)})"
    return (
        f"if(size({spans}) = 0 or size({others}) = 0, {spans}, transform(array({merged}), q -> transform(array(struct({ended} as ended, {ahead} as ahead)), "
        f"y -> transform(filter(transform(q, (c, i) -> if(c.k >= 0 and y.ended[i] <= c.s and y.ahead[i] >= c.e, c.k, -1)), k -> k >= 0), k -> {spans}[k]))[0])[0])"
    )


def with_candidates(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with, for each kind, base_<kind> (valid base spans) and more_<kind>
    (further candidates clear of base spans of any kind, with features f)."""
    out = docs
    for kind in KINDS:
        out = out.withColumn(f"base_{kind}", F.expr(f"filter({_located(BASE[kind], HINT[kind])}, c -> {VALID[kind]})"))
        out = out.withColumn(f"raw_{kind}", F.expr(_located(MORE[kind], MORE_HINT[kind])))
    out = out.withColumn("base_any", F.expr("concat(" + ", ".join(f"base_{k}" for k in KINDS) + ")"))
    for i, kind in enumerate(KINDS):
        described = f"transform({_free(f'raw_{kind}', 'base_any')}, c -> struct(c.s as s, c.e as e, c.b as b, c.z as z, c.m as m, {_features(i)} as f))"
        out = out.withColumn(f"more_{kind}", F.expr(described))
    return out.drop(*[f"raw_{k}" for k in KINDS])


def _make(rng: random.Random):
    """Makers of personal data of each kind, and of look-alikes."""

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def name(least=3):
        return "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(least, 9)))

    def card(n, valid=True):
        body = rng.choice("3456") + digits(n - 2)
        total = sum(d if i % 2 else (2 * d - 9 if 2 * d > 9 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
        check = -total % 10
        return body + str(check if valid else (check + rng.randint(1, 9)) % 10)

    def grouped(s, sep, sizes=(4,) * 9):
        out, at = [], 0
        for n in sizes:
            out.append(s[at : at + n])
            at += n
        return sep.join(x for x in out if x)

    def iban(valid=True):
        country = rng.choice(["DE", "FR", "ES", "GB", "IT", "NL", "CH"])
        body = digits(rng.choice([14, 16, 18, 20, 23]))
        if country in ("GB", "NL", "FR") and rng.random() < 0.6:
            body = "".join(rng.choice("ABCDEFGHIJKLMNOPRSTUVW") for _ in range(4)) + body[4:]
        number = int("".join(str(int(x, 36)) for x in body + country + "00"))
        check = 98 - number % 97
        code = f"{country}{check if valid else (check + 13) % 90 + 5:02d}{body}"
        return grouped(code, " ") if rng.random() < 0.6 else code

    def email():
        at, dot = rng.choice(
            [("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" at ", " dot "), ("＠", "."), ("{at}", "."),
             (" AT ", " DOT "), (" (at) ", " (dot) "), ("<at>", "."), ("[at]", "."), (" at ", "."), (" arroba ", " punto "), ("(at)", " punkt ")]
        )
        user = rng.choice([f"{name()}.{name()}", f"{name()}{digits(2)}", name(), f"{name()}.{digits(2)}", f"{name()}_{name()}"])
        host = rng.choice([name(), f"{name()}-{name()}", f"mail{dot}{name()}"])
        return f"{user}{at}{host}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'edu', 'io', 'co', 'info'])}"

    def phone():
        a, b, c = rng.choice("23456789") + digits(2), digits(3), digits(4)
        city = rng.choice(["030", "089", "0171", "0221", "0151", "040", "020"])
        return rng.choice(
            [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}) {b} {c}", f"{city} {digits(7)}", f"{city}/{digits(7)}",
             f"{city}-{digits(6)}", f"({city}) {digits(6)}", f"{city} {digits(3)} {digits(4)}", " ".join(["0" + rng.choice("1234567")] + [digits(2) for _ in range(4)]),
             f"0049 {rng.choice('123456789')}{digits(1)} {digits(7)}", f"00{rng.choice('123456789')}{digits(10)}", f"6{digits(2)} {digits(3)} {digits(3)}", f"{a}-{c}"]
        )

    def six():
        parts = [f"{rng.randrange(1 << 16):x}" for _ in range(8)]
        if rng.random() < 0.4:
            return ":".join(parts)
        head, tail = rng.randint(1, 4), rng.randint(1, 3)
        return rng.choice([":".join(parts[:head]) + "::" + ":".join(parts[-tail:]), "2001:db8::" + ":".join(parts[-tail:]), "fe80::" + ":".join(parts[-4:])])

    def four():
        return rng.choice(["[.]", "(.)", "[dot]", "(dot)", " [.] "]).join(str(rng.randint(1, 255)) for _ in range(4))

    def other_card():
        amex = "37" + card(15)[2:]
        fifteen = card(15)
        return rng.choice(
            [fifteen, card(13), card(14), grouped(card(16), "."), grouped(card(16), "/"), grouped(fifteen, " ", (4, 6, 5)), grouped(fifteen, "-", (4, 6, 5)), iban(), iban(), iban()]
        ) if amex else ""

    real = {
        "email": (email, ["mail", "write to", "contact", "reach me at", "e-mail:", "kontakt", "correo", "email"]),
        "phone": (phone, ["call", "phone", "tel.", "tel:", "mobile", "fax", "handy", "ring", "telefon", "llame al", "appelez"]),
        "card": (other_card, ["card", "visa", "credit card", "konto", "iban", "pay to account", "tarjeta", "carte"]),
        "ip": (lambda: four() if rng.random() < 0.35 else six(), ["host", "server", "ip", "ping", "connect to", "address", "gateway"]),
    }
    plain = PLAIN
    fakes = [
        lambda: f"came at {rng.choice(plain)}. {rng.choice(plain)}",
        lambda: f"{rng.choice(plain)} at {rng.choice(plain)} dot {rng.choice(plain)}",
        lambda: f"{rng.choice(plain)} at {name()}. {name().title()}",
        lambda: f"{rng.choice(plain)} dot {rng.choice(plain)}",
        lambda: card(rng.choice([13, 14, 15, 16]), False),
        lambda: digits(rng.randint(13, 19)),
        lambda: grouped(digits(16), rng.choice("./")),
        lambda: f"isbn 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"{digits(3)}/{digits(3)}/{digits(4)}",
        lambda: f"{rng.randint(1, 9)}{digits(2)} {digits(3)} {digits(3)}",
        lambda: f"{rng.choice(['part', 'room', 'order', 'ref', 'lot', 'item'])} {rng.choice('23456789')}{digits(2)}-{digits(4)}",
        lambda: f"{rng.choice(['part', 'order', 'serial', 'model'])} {digits(3)}-{digits(3)}-{digits(4)}",
        lambda: f"{rng.choice(['order', 'invoice', 'ticket', 'bestellung'])} 0{rng.choice('123456789')}{digits(8)}",
        lambda: f"{digits(3)}.{digits(4)}",
        lambda: ":".join(f"{rng.randrange(60):02d}" for _ in range(8)),
        lambda: ":".join(f"{rng.randrange(256):02x}" for _ in range(6)),
        lambda: f"{rng.choice(['std', 'abc', 'fade', 'cab', 'dad', 'a', 'be'])}::{rng.choice(['bad', 'feed', 'add', 'face', 'decade', 'cafe'])}",
        lambda: f"{rng.randint(1900, 2030)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}",
        lambda: f"0{rng.randint(1, 9)}.0{rng.randint(1, 9)}.{rng.randint(1900, 2030)}",
        lambda: f"0{rng.randint(1, 9)}/{rng.randint(10, 28)}/{rng.randint(1900, 2030)}",
        lambda: f"{rng.randint(1900, 2030)} {rng.randint(1900, 2030)} {rng.randint(1900, 2030)}",
        lambda: iban(False),
        lambda: f"{rng.choice('ABXZ')}{rng.choice('ABXZ')}{digits(2)}{digits(8)}",
        lambda: "(".join(digits(1) for _ in range(3)),
    ]
    return real, fakes


PLAIN = "the of and there water report was in a very long list some items left over when they came to town at noon dot point und der nicht que los dans".split()


def training_texts(seed: int = SEED, count: int = TEXTS) -> list[tuple[int, str, list[tuple[str, str]]]]:
    """(number, text, [(kind, string)]): prose with personal data and with look-alikes."""
    rng = random.Random(seed)
    real, fakes = _make(rng)
    out = []
    for i in range(count):
        words, spans = [], []
        for _ in range(rng.randint(1, 4)):
            words += rng.choices(PLAIN, k=rng.randint(3, 14))
            if rng.random() < 0.55:
                kind = rng.choice(list(real))
                make, told = real[kind]
                value = make()
                if rng.random() < 0.8:
                    words += [rng.choice(told)] + ([rng.choice(["is", "no", "at:", "me", "us"])] if rng.random() < 0.3 else [])
                words.append(value)
                spans.append((kind, value))
            else:
                words.append(rng.choice(fakes)())
            if rng.random() < 0.3:
                words[-1] += rng.choice([".", ",", "!", ";"])
        out.append((i, " ".join(words + rng.choices(PLAIN, k=3)), spans))
    return out


@cache
def _fitted(seed: int) -> tuple[str, dict[str, float]]:
    """The trees as SQL over a candidate's features f, and the threshold of each kind."""
    spark = SparkSession.active()
    texts = training_texts(seed)
    truth = {i: {v: k for k, v in spans} for i, _, spans in texts}
    docs = spark.createDataFrame(pa.table({"number": [i for i, _, _ in texts], "text": [t for _, t, _ in texts]}))
    found = with_candidates(docs).select("number", F.explode(F.concat(*[f"more_{k}" for k in KINDS])).alias("c"))
    rows = found.select("number", "c.m", "c.f").orderBy("number", "c.s", "c.e").collect()
    x = np.array([list(r["f"]) for r in rows], np.float64).reshape(-1, len(NAMES))
    y = np.array([truth[r["number"]].get(r["m"].strip()) == KINDS[int(r["f"][0])] for r in rows], np.float64)
    held = np.array([r["number"] % 3 == 0 for r in rows])
    model = boosting.fit(x[~held], y[~held], trees=40, depth=4)
    margin = model.margin(x[held])
    cuts = {}
    for i, kind in enumerate(KINDS):
        own = x[held][:, 0] == i
        cuts[kind] = boosting.threshold(margin[own], y[held][own], PRECISION)
    return model.sql([f"c.f.{n}" for n in NAMES]), cuts


CHOSEN = "struct<s: int, e: int, b: int, z: int, kind: int, p: double>"


def _selected(kind: int, score: str, cut: float) -> str:
    """SQL: the kind's further candidates above the threshold."""
    if cut == float("inf"):
        return f"cast(array() as array<{CHOSEN}>)"
    scored = f"transform(more_{KINDS[kind]}, c -> struct(c.s as s, c.e as e, c.b as b, c.z as z, {kind} as kind, double({score}) as p))"
    return f"filter({scored}, c -> c.p >= {cut!r}D)"


def _best(spans: str) -> str:
    """SQL: of each run of overlapping spans the one with the best score (then the first)."""
    run = _running("transform(q, (c, i) -> if(i = 0 or ends[i - 1] <= c.s, 1, 0))", SUM)
    top = _running("transform(q, (c, i) -> struct(run[i] as run, c.p as p, -c.s as t, c.e as e, c.b as b, c.z as z, c.kind as kind))", MOST)
    return (
        f"if(size({spans}) < 2, transform({spans}, c -> struct(c.s as s, c.e as e, c.b as b, c.z as z, c.kind as kind)), "
        f"transform(array(array_sort({spans})), q -> transform(array({_running('transform(q, c -> c.e)', MOST)}), ends -> transform(array({run}), run -> "
        f"transform(filter(transform({top}, (c, i) -> struct(c as c, i = size(run) - 1 or run[i + 1] <> run[i] as last)), x -> x.last), "
        "x -> struct(-x.c.t as s, x.c.e as e, x.c.b as b, x.c.z as z, x.c.kind as kind)))[0])[0])[0])"
    )


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, text, and for each kind base_<kind> and found_<kind>: arrays of (s, e) in code points and
    (b, z) in bytes, found_ being the further ones."""
    score, cuts = _fitted(seed)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = with_candidates(rows)
    out = out.withColumn("chosen", F.expr("concat(" + ", ".join(_selected(i, score, cuts[k]) for i, k in enumerate(KINDS)) + ")"))
    out = out.withColumn("best", F.expr(_best("chosen")))
    shown = "struct(c.s as s, c.e as e, c.b as b, c.z as z)"
    base = [F.expr(f"transform(base_{k}, c -> {shown})").alias(f"base_{k}") for k in KINDS]
    more = [F.expr(f"transform(filter(best, c -> c.kind = {i}), c -> {shown})").alias(f"found_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", "text", *base, *more)


def _listed(kind: str, spans: str) -> str:
    return f"transform(array_sort({spans}), c -> concat('{kind}:', c.s, ':', c.e))"


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_<kind> (base spans), base_sha256, spans (all), from find_spans."""
    base = "concat(" + ", ".join(_listed(k, f"base_{k}") for k in KINDS) + ")"
    every = "concat(" + ", ".join(_listed(k, f"concat(base_{k}, found_{k})") for k in KINDS) + ")"
    return spans.select(
        "doc_id",
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.expr(f"lower(sha2(cast(array_join({base}, ',') as binary), 256))").alias("base_sha256"),
        F.expr(f"array_join({every}, ',')").alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets (overlaps: one mark each run)."""
    spans = find_spans(docs, id_col, text_col)
    listed = ", ".join(
        f"transform(concat(base_{k}, found_{k}), c -> struct(c.b as b, c.z as z, '[{k.upper()}]' as mark))" for k in KINDS
    )
    # cut by bytes, which needs no walk from the start of the text
    piece = "if(c.b >= at, concat(cast(substring(raw, at + 1, c.b - at) as string), c.mark), '')"
    pieces = f"transform(marks, (c, i) -> transform(array(if(i = 0, 0, ends[i - 1])), at -> {piece})[0])"
    out = spans.select("doc_id", "text", F.col("text").cast("binary").alias("raw"), F.expr(f"array_sort(concat({listed}))").alias("marks"))
    out = out.withColumn("ends", F.expr(_running("transform(marks, c -> c.z)", MOST)))
    cut = f"concat(array_join({pieces}, ''), cast(substring(raw, ends[size(ends) - 1] + 1) as string))"
    return out.select("doc_id", F.expr(f"if(size(marks) = 0, text, {cut})").alias("text"))
