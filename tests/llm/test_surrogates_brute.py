"""Surrogates over a whole table against a plain reading of the same patterns, and texts made to break the patterns."""

import collections

import regex
from pyspark.sql import functions as F

from helix.llm import pii as P
from helix.llm import queries as Q

SF = "/root/testdata/sf0.001"
ANY = regex.compile(P.ANY.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"))


def kind(mention):
    return next(k for k, p in P.PATTERNS.items() if regex.fullmatch(p, mention))


def canon(k, mention):
    if k == "secret":
        return regex.match(r"[^=:]*[=:]\s*[\"']?(.+)$", mention)[1]
    return regex.sub(r"\D", "", mention) if k in P.DIGITS else mention.lower() if k == "email" else mention


def test_every_mention_has_its_own_surrogate_everywhere(spark):
    """Read by hand: texts outside of mentions stay, one form has one surrogate and two forms have two, and no surrogate is a form of the table."""
    old = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    new = {r["doc_id"]: (r["text"], r["n_entities"]) for r in Q.QUERIES["op1_pii_surrogates"](spark, SF).collect()}
    assert old.keys() == new.keys()
    to, forms, seen = collections.defaultdict(set), collections.defaultdict(set), 0
    for d, text in old.items():
        found = list(ANY.finditer(text or ""))
        if not found:
            assert new[d] == (text, 0)
            continue
        kinds = [kind(m[0]) for m in found]
        if "name" in kinds:
            continue  # their words are replaced elsewhere too: test_surrogates.py
        seen += len(found)
        assert new[d][1] == len(found)
        # what stands between mentions stays, in order
        between, at, pieces = [text[a:b] for a, b in zip([0, *(m.end() for m in found)], [*(m.start() for m in found), len(text)], strict=True)], 0, []
        for i, part in enumerate(between):
            here = new[d][0].index(part, at) if i < len(between) - 1 else len(new[d][0]) - len(part)
            assert new[d][0][here : here + len(part)] == part
            pieces.append(new[d][0][at:here])
            at = here + len(part)
        for k, m, piece in zip(kinds, found, pieces[1:], strict=True):
            forms[k].add(canon(k, m[0]))
            if len(piece) == len(m[0]):
                to[k, canon(k, m[0])].add(canon(k, piece))
    assert seen > 20 and to and all(len(s) == 1 for s in to.values())
    for k in forms:
        subs = [s for (kk, _), ss in to.items() if kk == k for s in ss]
        assert len(set(subs)) == len(subs) and not set(subs) & forms[k]


def test_texts_made_to_break_the_patterns(spark):
    """Long runs of each pattern's parts, secrets without any letter or digit, and shapes with few forms; each ends, and nothing real stays."""
    rows = [
        "x@" + "a." * 5000 + "com", "x@" + "a." * 100 + "com", "Mr. " + "A-" * 20000 + "b", "Mr. " + "A" * 50000, "Mr. Smith and " + "S’a" * 20000, "1" * 100000, "(01) " + "2-" * 30000, "+1" + " 22" * 30000, "1.2.3." * 20000, "token=" + "!" * 50000,
        'password = "********"', 'password = "••••••"', "-@-.com", *[f"{i}@2.co" for i in range(10)],
    ]
    d = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    got = [r["text"] for r in P.replace_pii(d, "k").orderBy("id").collect()]
    assert len(got) == len(rows) and all(a != b for a, b in zip(got[10:], rows[10:], strict=True)) and len(set(got[13:])) == 10
    assert "x@" not in got[1] and "Smith" not in got[4] and "********" not in got[10]


def test_names_are_single_words_of_their_script_and_gender(spark):
    rows = [f"Mr. Xa{a}{b} Yo{a}{b}" for a in "bcdfghklmn" for b in "aeiouy"] + [f"Mrs Qi{a}{b} Yo{a}{b}" for a in "bcdfghklmn" for b in "aeiouy"] + [f"господин Ж{a}{b}" for a in "бвгдж" for b in "аеиоу"] + ["κύριος Αλεξίου", "κυρία Μαρία Αλεξίου"]
    d = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    got = [r["text"] for r in P.replace_pii(d, "k").orderBy("id").collect()]
    for new, old in zip(got, rows, strict=True):
        assert len(new.split()) == len(old.split()) and "-" not in new and new.split()[0] == old.split()[0]
        script = r"\p{Cyrillic}+" if "господин" in old else r"\p{Greek}+" if "κυρ" in old or "κύρ" in old else r"\p{Latin}+"
        assert all(regex.fullmatch(script, w) and w[0].isupper() for w in new.split()[1:])
    first = [new.split()[1] for new in got[:120]]
    assert len(set(first)) == 120 and len({new.split()[2] for new in got[:60]}) == 60
    assert all(a.split()[2] == b.split()[2] for a, b in zip(got[:60], got[60:120], strict=True))


def test_columns_may_have_any_name(spark):
    d = spark.createDataFrame([(1, "mail a@b.com"), (2, None)], "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("_subs", "_names", "_pieces", "_file", "_row", "row", "new", "_metadata")})
    got = P.replace_pii(d, "k").orderBy("doc_id").collect()
    assert got[0]["_subs"] == got[0]["row"] == got[0]["_metadata"] == "mine" and "a@b.com" not in got[0]["text"]
