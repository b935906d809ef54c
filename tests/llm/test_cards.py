import pytest

from lodestrata.llm import pii

KEY = pii.derive_key("test")
CARDS = ["4532015112830366", "4532 0151 1283 0366", "4532-0151-1283-0366"]


@pytest.mark.parametrize("card", CARDS)
@pytest.mark.parametrize("after", [" 12/27", " 123", " 99 x", "-123", "-12/27", " 1", " 1227", "-1227", " 12 345", " 12/2027 123", "-", ""])
def test_card_before_other_digits(card, after):
    text = f"card {card}{after}"
    new, found = pii.pseudonymise(text, KEY)
    assert [(k, a, b) for k, a, b, _ in found][:1] == [("card", 5, 5 + len(card))]
    assert card not in new and new.startswith("card 4") and new[5 + len(card) :].startswith(after[:1])
    assert found[0][3] == pii.pseudonymise(card, KEY)[0] and pii.luhn("".join(c for c in found[0][3] if c.isdigit())) == 0


@pytest.mark.parametrize("text", ["4532015112830367 12/27", "4532 0151 1283 0367 123", "1111111111111111 123", "4532015112830366123"])
def test_no_card(text):
    assert "card" not in [k for k, *_ in pii.pseudonymise(text, KEY)[1]]


@pytest.mark.parametrize("text", ["a%" * 60000, "a@" * 60000, "1 " * 20000, "1.2." * 40000, "AKIA" * 40000, "password=" * 20000, "4532 0151 " * 5000, "x" * 5_000_000, "sk-" * 50000, "a.b-" * 50000 + "@x.com"])
def test_long_lines_take_linear_time(text):
    import time

    began = time.process_time()
    pii.pseudonymise(text, KEY)
    assert time.process_time() - began < 8


def test_tokens_of_letters():
    token = "ghp_" + "abcdefghij" * 4
    for text in (token, f"see {token} there", f"{token} 1"):
        new, found = pii.pseudonymise(text, KEY)
        assert [k for k, *_ in found] == ["token"] and token not in new and "ghp_" in new


def test_long_values_are_permuted_in_parts():
    s = "abcXYZ019" * 200
    new = pii.permute_chars(KEY, "k", s)
    assert len(new) == len(s) and new != s and pii.permute_chars(KEY, "k", new, back=True) == s


def brute_spans(text):
    """What is found where, each kind's pattern tried at each place in turn, without hints, lines or skips."""
    import re

    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        for kind, (pattern, make) in pii.KINDS.items():
            m = re.compile(pattern).match(text, at, end)
            tries = [m] if m else []
            if m and kind == "card":
                tries += [x for cut in range(m.end() - 1, m.start(), -1) if text[cut] in " -" and (x := re.compile(pattern).match(text, at, cut)) and x.end() == cut]
            good = next(((x, new) for x in tries if (new := make(KEY, x)) is not None), None)
            if good:
                out.append((kind.partition("_")[0], at, good[0].end(), good[1]))
                at = good[0].end()
                break
        else:
            at += 1
    return out


def test_detection_against_brute_force(sf, spark):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text and len(r.text) < 3000]
    some = [t for t in texts if pii.pseudonymise(t, KEY)[1]]
    assert len(some) > 5
    for t in texts[:60] + some[:60]:
        assert pii.pseudonymise(t, KEY)[1] == brute_spans(t)
