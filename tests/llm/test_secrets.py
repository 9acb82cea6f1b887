"""What the Markov models add to the base patterns: recall by form of key, and ordinary names that stay."""

import random
import string

import pytest

from lexloom.llm import secrets
from lexloom.llm.common import table

MIXED, LOW = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
KEYS = {
    "prefixed": lambda r: "ghp_" + "".join(r.choices(MIXED, k=36)),
    "dashed": lambda r: "sk-" + "".join(r.choices(MIXED, k=40)),
    "base64": lambda r: "".join(r.choices(MIXED + "+/", k=43)) + "=",
    "short": lambda r: "".join(r.choices(MIXED, k=16)),
    "lower": lambda r: "".join(r.choices(LOW, k=24)),
    "upper hex": lambda r: "".join(r.choices("0123456789ABCDEF", k=32)),
    "letters": lambda r: "".join(r.choices(string.ascii_letters, k=24)),
    "uuid": lambda r: "-".join("".join(r.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12)),
}
ORDINARY = "understandable-identifier_names getElementsByClassName org_apache_functions_window internationalization TransactionManagerFactoryBean 2021-05-17T10:20:30 max_records_per_batch_2024 Donaudampfschifffahrtsgesellschaft test_case_number_12345678 AbstractSingletonProxyFactoryBean image/png/large/thumbnail_0012 en-US-windows-1252-default com/github/user/repo-name utf-8-sig-encoding-with-bom version-1-2-3-rc4-build567 /usr/local/lib/python3/site-packages MAXIMUM_NUMBER_OF_ROWS documentation/en/index_of_pages".split()


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(table(spark, "/root/testdata/sf0.01", "documents"))


@pytest.mark.parametrize("form", list(KEYS))
def test_random_keys_are_found(model, form):
    r, found = random.Random(11), 0
    for _ in range(200):
        key = KEYS[form](r)
        text = f"with {key} in it"
        base = secrets.base_spans(text)
        found += any(a <= 5 and b >= 5 + len(key) for _, a, b in base + model.added(text, base))
    assert found >= 190, found


def test_ordinary_names_stay(model):
    """But for one of 18: the given texts have no English words, so that some in capitals look random."""
    wrong = [x for x in ORDINARY if model.added(f"with {x} in it", [])]
    assert len(wrong) <= 1, wrong


def test_no_word_of_the_documents_is_added(spark, model):
    for r in table(spark, "/root/testdata/sf0.01", "documents").filter("text is not null").collect():
        assert not model.added(r["text"], secrets.base_spans(r["text"]))


def test_names_of_too_few_words():
    assert secrets.identifiers([]) == secrets.identifiers(["a", "b", "12"]) == []
    assert secrets.Model([], ["word"]).added("Zq8fK2pLX9Rt5Vw1bN7c", []) == []
