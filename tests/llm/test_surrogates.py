"""Surrogates that the shape of a mention can't give."""

import re

from helix.llm.pii import replace_pii


def test_draws_end_when_a_shape_is_exhausted(spark):
    """A secret of only punctuation, and all addresses of one letter at one ending."""
    abc = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{x}@{y}.com" for x in abc for y in abc]
    rows = [(1, 'password = "******"'), (2, 'password = "••••••"'), *[(10 + i, f"to {m} now") for i, m in enumerate(mails)]]
    r = {x["doc_id"]: x["text"] for x in replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert "*" not in r[1] and "•" not in r[2] and r[1] != r[2] and all(re.fullmatch(r'password = "[a-z]+"', r[i]) for i in (1, 2))
    new = [re.fullmatch(r"to ([a-z]+@[a-z]\.com) now", r[10 + i])[1] for i in range(len(mails))]
    assert len(set(new)) == len(mails) and not set(new) & set(mails)


def test_mentions_without_title_parentheses_or_quotes(spark):
    t = "John Smith wrote. Mr. John Smith met Smith's friend; SMITH said smith and Johnson. Call 555-123-4567 or 030 1234 5678. password: hunter22. token=letmein on 01-02-2023, password: required"
    r = replace_pii(spark.createDataFrame([(1, t), (2, "Smith stays here")], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    new = r[0]["text"]
    for gone in ("John ", "Smith", "SMITH", "555-123", "1234 5678", "hunter22", "letmein"):
        assert gone not in new, (gone, new)
    first, last = re.match(r"(\S+) (\S+) wrote", new).groups()
    assert f"Mr. {first} {last} met {last}'s friend; {last.upper()} said smith and Johnson." in new
    assert re.search(r"Call \d{3}-\d{3}-\d{4} or 0\d\d \d{4} \d{4}\. password: [a-z0-9]{8}\. token=[a-z]{7} on 01-02-2023, password: required$", new), new
    assert r[0]["n_entities"] == 9 and r[1]["text"] == "Smith stays here" and r[1]["n_entities"] == 0
