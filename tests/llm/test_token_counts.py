"""Token attribution against a slow walk over every token."""

import pytest
from tokenizers import Tokenizer

from gaugewatch.llm import token_counts
from gaugewatch.llm.tokens import default_file

TEXTS = [(1, "one two\nthree\n\n four é漢🙂\nend"), (2, None), (3, ""), (None, "\n\n\n\n"), (4, "a  \n  b"), (4, "a  \n  b"), (5, "lang " * 3000)]


def walk(text, sections, rule):
    """(tokens, shared tokens) of every section; -1 holds what lies in none."""
    counts = {k: [0, 0] for k in [-1, *range(len(sections))]}
    found = Tokenizer.from_file(default_file()[0]).encode(text, add_special_tokens=False)
    raw = text.encode()
    chars = [i for i, c in enumerate(text) for _ in c.encode()]
    at = 0
    for token in found.tokens:
        first, last = chars[at], chars[at + len(token) - 1]
        at += len(token)
        held = [max(0, min(last + 1, b) - max(first, a)) for a, b in sections]
        hit = [k for k, h in enumerate(held) if h]
        to = -1 if not hit else hit[0] if rule == "first" else hit[-1] if rule == "last" else held.index(max(held))
        counts[to][0] += 1
        counts[to][1] += not hit or held[hit[0]] < last + 1 - first
    assert at == len(raw)
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
@pytest.mark.parametrize("split", [token_counts.line_sections, lambda t: [(1, 3), (5, 6)] if len(t) > 6 else [(0, 0)]])
def test_against_walk(spark, rule, split):
    docs = spark.createDataFrame([(i, t, 1) for i, t in TEXTS], "doc_id long, text string, section int")
    rows = token_counts.attribute(docs, split, rule).collect()
    got = sorted((r.doc_id or -1, r.section, r.n_tokens, r.n_shared) for r in rows)
    want = []
    for doc_id, text in TEXTS:
        for k, (n, shared) in walk(text or "", split(text or ""), rule).items():
            if k >= 0 or n:
                want.append((doc_id or -1, k, n, shared))
    assert got == sorted(want)


def test_rule_is_checked(spark):
    with pytest.raises(ValueError):
        token_counts.attribute(spark.createDataFrame([], "doc_id long, text string"), rule="none")


def test_empty_table(spark):
    assert token_counts.attribute(spark.createDataFrame([], "doc_id long, text string")).count() == 0
