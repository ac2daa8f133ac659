import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest_llm import sentence
from fieldaudit.llm import pii


def plain(text):
    """The four patterns as the contract gives them."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]}


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1290@.+-() %_é\n5", max_size=60))
def test_base_equals_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a@b.c_d@e.f", "x@y@z.com", "1.2.3.4.5.6.7.8", "0255.1.1.1 256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713",
                                  "+1 555", "++49 30 123456 7", "a" * 50_000 + "@", "9" * 20_000, "1." * 20_000, "+1" + "(" * 20_000])
def test_base_on_edges(text):
    assert pii.base_spans(text) == plain(text)


def test_method_adds_spans_and_keeps_the_base(docs_of):
    rng = random.Random(3)
    rows, secrets, decoys = [], {}, []
    for k in range(120):
        token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        text = f"{sentence(rng, 8)} token = \"{token}\" {sentence(rng, 5)} mail{k}@host{k}.example.com and +1 (212) 555-{k:04d} end"
        rows.append((k, text, "a"))
        secrets[k] = f"secret:{text.index(token)}:{text.index(token) + 40}"
    for k in range(200, 320):
        rows.append((k, f"{sentence(rng, 8)} the-quick-brown-fox-number-{k} {sentence(rng, 8)}", "a"))
        decoys.append(k)
    got = {r.key: r for r in pii.personal_data(docs_of(rows, clash=True)).select("key", pii.joined("base").alias("base"), pii.joined("added").alias("added")).collect()}
    assert {k: got[k].added for k in secrets} == secrets
    assert all(got[k].added == "" and got[k].base == "" for k in decoys)
    assert all(got[k].base.startswith("email:") and ",phone:" in got[k].base for k in secrets)


def test_awkward_rows(docs_of, awkward):
    rows = awkward + [(70, "é\U0001f600 a@b.co", "a"), (71, "a@b.co " * 2000, "hot")]
    got = {r.key: r for r in pii.personal_data(docs_of(rows, clash=True)).collect()}
    assert [(s.start, s.end) for s in got[70].base] == [(3, 9)] and len(got[71].base) == 2000 and got[1].base == []
    assert pii.personal_data(docs_of([])).count() == 0
    assert {r.added for r in pii.personal_data(docs_of([(1, "nothing here", "a")])).select(pii.joined("added").alias("added")).collect()} == {""}
    out = {r.doc_id: r for r in pii.redacted(docs_of(rows, clash=True)).collect()}
    assert out[70].text == "é\U0001f600 [email]" and out[70].rank == "x" and out[1].text is None


def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 4000)
    votes = np.stack([np.where(rng.random(4000) < a, truth, 1 - truth) for a in (0.95, 0.9, 0.9, 0.6)], 1)
    votes[rng.random(votes.shape) < 0.2] = -1
    good, accuracy = pii.reliabilities(votes, np.ones(4000))
    assert ((good > 0.5) == truth).mean() > 0.95
    assert np.allclose(accuracy, (0.95, 0.9, 0.9, 0.6), atol=0.04)
