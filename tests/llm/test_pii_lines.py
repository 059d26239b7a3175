"""The field finds entities wherever they stand in a line."""

import random

from folioframe.llm import pii_crf

IBAN = "DE12 3456 7890 1234 5678 90"


def found(text):
    return {(pii_crf.KINDS[k], text[s:e]) for k, s, e in pii_crf.spans(text, pii_crf.fitted())[1]}


def test_host_after_a_spaced_at():
    for at in ("@", "(@)", "[@]"):
        mail = f"bob {at} example.com"
        assert ("email", mail) in found(f"write to {mail} and wait for that"), mail
        assert "example" not in pii_crf.masked(mail, pii_crf.spans(mail, pii_crf.fitted())[1])


def test_dense_line_has_no_border():
    r = random.Random(3)
    for fill in range(3900, 4100, 7):
        text = ""
        while len(text) < fill:
            text += f"{r.randrange(100, 999)} "
        text = f"{text[:fill].rstrip()} iban {IBAN} and {text}"
        assert ("account", IBAN) in found(text), fill


def test_each_line_is_segmented_as_if_alone():
    r = random.Random(9)
    weights = pii_crf.fitted()
    lines = "\n".join(pii_crf._made(r)[0] for _ in range(60)).split("\n")
    want, at = [], 0
    for line in lines:
        want += [(k, s + at, e + at) for k, s, e in pii_crf.segment(line, weights)]
        at += len(line) + 1
    assert pii_crf.field_spans("\n".join(lines), weights) == want
