import re

import pytest

from vectorvote.llm import pii

CASES = [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("mail john dot doe at mail dot example dot org now", "email", "john dot doe at mail dot example dot org"),
    ("write jo_5 at example.com please", "email", "jo_5 at example.com"),
    ("аdmin@example.com", "email", "аdmin@example.com"),
    ("x ｊｏｅ＠example．com y", "email", "ｊｏｅ＠example．com"),
    ("a b​ob@exa​mple.com", "email", "b​ob@exa​mple.com"),
    ("ip one nine two dot one six eight dot one dot seven end", "ip", "one nine two dot one six eight dot one dot seven"),
    ("call plus one five five five two three four five six seven eight ok", "phone", "plus one five five five two three four five six seven eight"),
    ("card four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
    ("call +1 (five five five) 123-4567 now", "phone", "+1 (five five five) 123-4567"),
    ("call +1 (555) one two three-four five six seven now", "phone", "+1 (555) one two three-four five six seven"),
    ("host 192.168.O.1 up", "ip", "192.168.O.1"),
    ("card 4lll 1111 1111 1111 x", "card", "4lll 1111 1111 1111"),
    ("card ４１１１１１１１１１１１１１１１ x", "card", "４１１１１１１１１１１１１１１１"),
]


@pytest.mark.parametrize("text,kind,want", CASES)
def test_disguised(text, kind, want):
    got = pii.hidden_spans(text, pii.base_spans(text))
    assert (kind, text.index(want), text.index(want) + len(want)) in got


def brute(text):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 13 <= len(d) <= 19 and pii._luhn(d) or k == "phone" and 9 <= len(d) <= 15:
                out.append((k, *m.span()))
    return out


def test_base_matches_the_patterns():
    import random

    r = random.Random(5)
    for _ in range(4000):
        text = "".join(r.choice(["@", ".", "a", "1", "25", "+", " ", "-", "(", ")", "4111111111111111", "x@y.z", "é", "_"]) for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text


def test_clean_text_stays():
    for text in ("We met at example.com", "one two three go", "three dots at noon dot", "", "um acht uhr", "look at this. One, two.", "Il 10 o 20", "llll oooo 1111", "I have 1 or 2 of 30"):
        assert pii.hidden_spans(text, pii.base_spans(text)) == []


BITS = [
    "@", ".", " ", "  ", "\n", "\x1c", "-", "(", ")", "[", "]", "{", "}", "<", "at", "AT", "dot", "Dot", "punkt", "punto", "arroba", "point", "a", "joe", "x_1", "j.d", "host", "com", "de", "+", "plus", ",",
    *"one two SIX un dos nine oh null fünf FÜNF zéro ZÉRO tres".split(), "1", "25", "192", "O", "o", "l", "I", "4111", "é", "×", "«", "\xa0", "\xad", "а", "４", "＠", "．", "ſ", "K", "_", "%",
]


def test_no_candidate_is_passed_over():
    """What the filter passes over, no transducer would change."""
    import random

    import numpy as np

    r = random.Random(11)
    texts = [t for t, _, _ in CASES] + ["info@firma{punkt}de", "info@firma( punkt )de", "j.doe" + "x" * 80 + " at host.com", "ZÉRO FÜNF", "1 .(O"]
    texts += ["".join(r.choice(BITS) for _ in range(r.randint(1, 14))) for _ in range(12_000)]
    texts += [" ".join(r.choice(BITS) for _ in range(r.randint(1, 9))) for _ in range(8_000)]
    raw = [t.encode() for t in texts]
    plain, odd = pii._candidates(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    changed = 0
    for text, p, o in zip(texts, plain, odd):
        m = pii.signs(pii.spelled(pii.look_alike_digits(pii.glyphs(pii.Mapped(text)))))
        assert len(m.text) == len(m.start) == len(m.end) and (m.start < m.end).all()
        changed += m.text != text
        assert o or m.text == text, text
        assert p or not pii.base_spans(text), text
    assert changed > 3000 and not odd.all()


def test_find_against_brute_force(spark):
    """The whole operator, without its filter, on disguised and plain pieces between clean words."""
    import hashlib
    import random

    r = random.Random(12)
    parts = [w for _, _, w in CASES] + ["a.b@c.de", "10.0.0.1", "4111 1111 1111 1111", "+49 30 1234567", "the", "house,", "of 12", "é", "at noon.", "dot"]
    rows = [(k, " ".join(r.choice(parts) for _ in range(r.randint(0, 8)))) for k in range(400)]
    got = {x.doc_id: x for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for i, text in rows:
        base = brute(text)
        m = pii.signs(pii.spelled(pii.look_alike_digits(pii.glyphs(pii.Mapped(text)))))
        more = {(k, int(m.start[a]), int(m.end[b - 1])) for k, a, b in brute(m.text) if text[m.start[a] : m.end[b - 1]] != m.text[a:b]} - set(base)
        more = [(k, a, b) for k, a, b in more if all(b <= x or y <= a or a <= x and y <= b and (a, b) != (x, y) for _, x, y in base)]
        every = sorted([*base, *more], key=lambda v: (pii.KINDS.index(v[0]), v[1], v[2]))
        assert got[i].spans == line(every) and got[i].base_sha256 == hashlib.sha256(line(base).encode()).hexdigest() and got[i].n_added == len(more)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(v[0] == k for v in every) for k in pii.KINDS]


@pytest.mark.parametrize(
    "text",
    [
        " " * 1_000_000 + "x [at] y", "a dot " * 160_000, "a at " * 200_000, "[ " * 500_000, "(" + " " * 1_000_000 + "at", "one " * 250_000, "one" + " " * 999_000 + "two", "@ " * 500_000, "a." * 500_000 + " at b", "x at " + "a." * 500_000,
        "0 " * 500_000 + "x", "0O" * 500_000 + "x", "+1" + "." * 999_000, "1." * 500_000, "a@" * 500_000, "а" * 500_000, "one.two " * 120_000, "dot at " * 140_000, "plus " * 200_000, "a@b.c " * 160_000,
        "a [at] b [dot] de " * 55_000,
    ],
)
def test_a_long_text_takes_linear_time(text):
    import time

    def took(t):
        began = time.process_time()
        pii.hidden_spans(t, pii.base_spans(t))
        return time.process_time() - began

    half, whole = took(text[len(text) // 2 :]), took(text)
    assert whole < 12 and whole < 3.5 * half + 1


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "a@b.c"), (3, "a@b.c"), (None, "x" * 200_000 + " j [at] k [dot] de"), (5, "9" * 100_000 + ".1")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, spans int")
    got = {(r.doc_id, r.spans) for r in pii.find(df).collect()}
    assert got == {(1, ""), (2, ""), (3, "email:0:5"), (None, "email:200001:200018"), (5, "")}
    assert pii.find(df.limit(0)).count() == 0
