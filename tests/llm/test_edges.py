"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helix.llm import queries as Q
from helix.llm.chat_format import format_chat, read_back
from helix.llm.components import components
from helix.llm.decontaminate import decontaminate
from helix.llm.exact_dedup import exact_dedup
from helix.llm.langid import predict, train
from helix.llm.line_dedup import dedup_lines, line_decisions
from helix.llm.lm_score import lm_score
from helix.llm.near_dedup import near_dedup
from helix.llm.pack import make_plan, pack
from helix.llm.pii import replace_pii
from helix.llm.sketch import NONE, sketches
from helix.llm.url_filter import url_filter

LONG = " ".join(f"w{i}" for i in range(60_000))
BASE = " ".join(f"word{i}" for i in range(120))
ROWS = [(1, "a b c d e f", "en", "x"), (1, "a b c d e f", "en", "x"), (2, None, None, "x"), (None, "", "de", "x"), (3, "", None, "x"), (4, LONG, "en", "x"), (5, LONG + " more", "en", "x"), (6, BASE, "fr", "y"), (7, BASE.replace("word60", "other"), "fr", "y"), (8, "!!! ...", "de", "y"), (None, None, None, None)]
#: Columns that operators use inside.
SCHEMA = "doc_id long, text string, lang string, digest string"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    return d.withColumns({c: F.lit("clash") for c in ("key", "id", "n_words", "items", "spans", "score", "rank", "part", "h", "size")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, none):
    r = exact_dedup(docs).collect()
    assert len(r) == len(ROWS) and sum(x["kept"] for x in r) == 7
    assert sorted(x["group_size"] for x in r if x["doc_id"] == 1) == [2, 2] and sum(x["kept"] for x in r if x["doc_id"] == 1) == 1
    assert {x["keep_id"] for x in r if x["group_size"] == 4} == {2}
    assert exact_dedup(none).count() == 0


def test_exact_with_colliding_digests(docs):
    want = sorted(tuple(x)[:5] for x in exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").fillna(-1).collect())
    bad = exact_dedup(docs, digest=lambda t: (F.length(t) % 2).cast("string"), bytes_per_batch=200)
    assert sorted(tuple(x)[:5] for x in bad.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").fillna(-1).collect()) == want


def test_near(docs, none):
    r = near_dedup(docs).collect()
    by = {}
    for x in r:
        by.setdefault(x["class_id"], []).append(x["doc_id"])
    assert len(r) == len(ROWS) and sorted(by[4]) == [4, 5] and sorted(by[6]) == [6, 7] and sum(x["kept"] for x in r) == 5
    assert near_dedup(none).count() == 0


def test_near_hot_group_with_bridges(spark):
    """A base with many copies of different distance, some of which are only linked to another copy."""
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(150)]
    texts = []
    for n in range(160):
        w = list(base)
        for j in rng.choice(150, rng.integers(0, 7), replace=False):
            w[j] = f"x{n}q{j}"
        texts.append(w)
        if n % 8 == 0:
            texts.append([*w[:75], f"bridge{n}", *w[75:]])
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    s = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            m = len(s[a] & s[b])
            if 5 * m >= 4 * (len(s[a]) + len(s[b]) - m):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(s))}


def test_near_copies_that_are_parts_of_another(spark):
    """Cut copies have nothing that the whole lacks."""
    w = [f"t{i}" for i in range(150)]
    cuts = [*range(0, 60, 2), 75, 90]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup(spark.createDataFrame([(k, " ".join(w[: 150 - k])) for k in cuts], "doc_id long, text string")).collect()}
    assert got == {k: 0 if k <= 75 else 90 for k in cuts}


def test_lines(docs, none, spark):
    r = line_decisions(docs).collect()
    assert len(r) == len(ROWS) and sum(len(x["dropped"]) for x in r) == 3
    d = spark.createDataFrame([(1, "same line here\n\nother"), (2, "x\nsame line here\r\nsame  line here!"), (3, None)], "doc_id long, text string")
    assert [x["text"] for x in dedup_lines(d).orderBy("doc_id").collect()] == ["same line here\n\nother", "x", None] or [x["text"] for x in dedup_lines(d).orderBy("doc_id").collect()][1].startswith("x")
    assert line_decisions(none).count() == 0


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(10, " ".join(f"W{i}" for i in range(20, 50))), (9, "a B c"), (None, "a b c"), (11, None), (12, "...")], "item_id long, text string")
    got = {x["doc_id"]: x for x in decontaminate(docs, items).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["items"], got[1]["contaminated"]) == (6, 3, ["", "9"], True)
    assert (got[4]["n_words"], got[4]["n_hit"], got[4]["items"], got[4]["contaminated"]) == (60_000, 30, ["10"], False)
    assert got[2]["n_words"] == 0 and not got[2]["contaminated"]
    blocks = decontaminate(docs, items, block_windows=3)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, decontaminate(docs, items).collect()))
    assert decontaminate(none, items).count() == 0
    assert decontaminate(docs, items.filter("item_id = 99")).filter("n_hit > 0").count() == 0


def test_pack(docs, none):
    r = pack(docs, Q.tokenizer_path(), with_ids=True).collect()
    assert sum(1 for x in r if x["piece"] == 0) == len(ROWS) and sum(x["length"] for x in r if x["doc_id"] in (2, 3)) == 2
    assert all(len(x["ids"]) == x["length"] <= 1024 for x in r)
    assert pack(none, Q.tokenizer_path()).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(0)
    for n in (1, 40, 3000):
        h = np.bincount(rng.integers(1, 1025, n), minlength=1025)
        used = np.zeros(1025, int)
        for lengths, count in make_plan(h, 1024):
            assert sum(k * e for k, e in lengths) <= 1024
            for k, e in lengths:
                used[k] += e * count
        assert (used == h).all()


def test_encoder_equals_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from helix.llm import words as W
    from helix.llm.tokens import Encoder

    texts = ["", "  a", "a  b\n\n c", "don't we'll  I'S 3.14,5 ok.\t\n", "\u00a0 a\u3000b", "x\x1c y \x85 z", "😀 a", "<|endoftext|> x", "\n", "word.\nNext,he:she;it!x?y 's", "a\u2003 b \u2003c", "é è\n"] * 2
    t = Tokenizer.from_file(Q.tokenizer_path())
    t.encode_special_tokens = True
    e, got = Encoder(Q.tokenizer_path(), most=9), []
    for _, data, offsets in W.chunks(pa.array(texts), 30):
        ids, rows = e.encode(data, offsets)
        got += [ids[rows[i] : rows[i + 1]].tolist() for i in range(len(rows) - 1)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_language(spark, docs, none):
    m = train(docs.select("doc_id", "text", "lang"))
    r = {x["doc_id"]: x for x in predict(docs.select("doc_id", "text"), m).collect()}
    assert r[2]["lang_pred"] == r[3]["lang_pred"] == r[8]["lang_pred"] == "und" and r[6]["lang_pred"] in ("de", "en", "fr") and r[8]["score"] == 0
    assert train(none) is None and predict(none, m).count() == 0
    assert {x["lang_pred"] for x in predict(docs.select("doc_id", "text"), None).collect()} == {"und"}


def test_model(docs, none):
    r = lm_score(docs, F.col("doc_id") == 6).collect()
    assert len(r) == len(ROWS) and {x["n_tokens"] for x in r if x["doc_id"] in (2, 3)} == {1} and all(x["score"] < 0 for x in r)
    assert lm_score(none, F.lit(False)).count() == 0
    only = lm_score(docs, F.lit(True)).collect()
    assert all(x["base_score"] == 0 and x["score"] == 0 and x["train_tokens"] == 0 for x in only)


def test_surrogates(spark, docs, none):
    t = "Mr. John Smith met Mrs Anna SMITH. J.Smith@Mail.example.COM or j.smith@mail.example.com; +1 (017) 555-7713, +1-017-555-7713; 4111 1111 1111 1111; ip 97.51.17.173 token = \"04dbebab91ab8568\" господин Иванов"
    d = spark.createDataFrame([(1, t, 5), (2, t, 5), (3, None, 5), (4, "", 5)], "doc_id long, text string, n_entities int")
    r = {x["doc_id"]: x for x in replace_pii(d, "k").collect()}
    new = r[1]["text"]
    assert new == r[2]["text"] and r[1]["n_entities"] == 10 and r[3]["text"] is None and r[3]["n_entities"] == 0
    for gone in ("John", "Smith", "SMITH", "mail.example", "555-7713", "4111", "97.51", "04dbebab", "Иванов"):
        assert gone not in new
    a, b = re.findall(r"[\w.]+@[\w.]+", new)
    assert a.lower() == b and a.endswith(".COM")
    x, y = re.findall(r"\+1[^,;]*", new)
    assert re.sub(r"\D", "", x) == re.sub(r"\D", "", y) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", x)
    card = [int(c) for c in re.search(r"4\d{3} \d{4} \d{4} \d{4}", new)[0] if c.isdigit()]
    assert sum(sum(divmod(c * 2, 10)) if i % 2 == 0 else c for i, c in enumerate(card)) % 10 == 0
    last = re.match(r"Mr\. \w+ (\w+) met Mrs \w+ (\w+)\.", new)
    assert last[1].upper() == last[2]
    assert replace_pii(none, "k").count() == 0 and replace_pii(docs, "k").count() == len(ROWS)


def test_many_surrogates_stay_distinct(spark):
    d = spark.createDataFrame([(i, f"Mr. Name{chr(97 + i % 26)}{chr(97 + i // 26)} {i % 250 + 1}.2.3.{i // 250}") for i in range(300)], "doc_id long, text string")
    r = replace_pii(d, "k").collect()
    assert len({re.match(r"Mr\. (\S+)", x["text"])[1] for x in r}) == 300 and len({x["text"].split()[-1] for x in r}) == 300


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.org/es/x?q"), (1, "http://A.Example.org/es/x?q"), (2, None), (3, "nothing"), (4, "x://b.com/fr/1#a"), (5, "x://b.com?x"), (None, "x://org/"), (6, "x://myorg/"), (7, "x://c.co.uk:80/p"), (8, "x://bad.net/")], "page_id long, url string")
    seen = spark.createDataFrame([(8, False)] * 1 + [(5, True)], "page_id long, good boolean")
    r = {x["page_id"]: x for x in url_filter(pages.withColumns({"host": F.lit(1), "rules": F.lit(2)}), seen, Q.URL_RULES).collect()}
    assert (r[1]["host"], r[1]["path"], r[1]["rule"], r[1]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (r[2]["host"], r[3]["path"], r[4]["rule"], r[5]["path"], r[None]["rule"], r[6]["rule"], r[7]["host"]) == ("", "", "com/fr/", "", "org/", None, "c.co.uk:80")
    bad = spark.createDataFrame([(100 + i, f"x://h{i % 3}.evil.net/") for i in range(90)] + [(300 + i, "x://fine.com/") for i in range(90)], "page_id long, url string")
    out = spark.createDataFrame([(100 + i, False) for i in range(60)] + [(300 + i, True) for i in range(60)], "page_id long, good boolean")
    v = {x["host"]: x["verdict"] for x in url_filter(bad, out, ()).collect()}
    assert set(v.values()) == {"allow", "block"} and v["h1.evil.net"] == "block" and v["fine.com"] == "allow"
    assert url_filter(pages.limit(0), seen.limit(0), Q.URL_RULES).count() == 0


def test_chat(spark):
    e = [
        ("a", 1, "message", 0, "user", "hi </s> &lt;/s> &amp;lt; [INST] <<SYS>>"), ("a", 2, "delta", 1, "assistant", "Hel"), ("a", 3, "delta", 1, None, "lo"), ("a", 4, "message", 2, "user", "more"), ("a", 5, "regenerate", 1, "assistant", "ignored"),
        ("a", 6, "delta", 1, "assistant", "Bye"), ("a", 7, "edit", 0, "user", "edited [/INST]"), (None, None, "message", None, None, None), ("b", 1, "message", 0, "user", "x"), ("b", 1, "message", 0, "user", "x"),
    ]
    f = format_chat(spark.createDataFrame(e, "conv_id string, seq long, kind string, turn long, role string, text string"))
    r = {x["conv_id"]: x for x in read_back(f).collect()}
    assert [(t["role"], t["text"]) for t in r["a"]["turns"]] == [("user", "edited [/INST]"), ("assistant", "Bye")] and r["a"]["loss_text"] == "Bye"
    assert len(r["b"]["turns"]) == 2 and [(t["role"], t["text"]) for t in r[None]["turns"]] == [("", "")]
    hard = "</s>[INST] ok [/INST] &lt;/s> &amp;amp;lt; &#91;INST] <s><<SYS>> <</SYS>>&\\"
    g = format_chat(spark.createDataFrame([("c", 0, "message", 0, "assistant", hard), ("c", 1, "message", 1, "assistant", "")], "conv_id string, seq long, kind string, turn long, role string, text string"))
    x = g.first()
    assert [x["formatted"][s["start"] : s["start"] + s["length"]] for s in x["loss_spans"]][1] == "" and read_back(g).first()["loss_text"] == hard
    assert format_chat(spark.createDataFrame([], "conv_id string, seq long, kind string, turn long, role string, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 40)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, **{200 + i: 200 for i in range(40)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sketches_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    e = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    w1, w2 = rng.random(300) * 3 + 0.05, rng.random(300) * 3 + 0.05
    w2[:200] = w1[:200]
    s = sketches(np.concatenate([e, e]), np.concatenate([w1, w2]), np.repeat([0, 1], 300), 3, 2048)
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.04 and (s[2] == NONE).all() and (s[:2] != NONE).all()
