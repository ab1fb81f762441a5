"""Added tokens in a text, by the tokenizer's own defaults."""

from tokenizers import Tokenizer

from helix.llm import queries as Q
from helix.llm.pack import pack


def test_packed_ids_are_those_of_a_plain_call(spark):
    texts = ["<|endoftext|>", "a<|endoftext|> b", "x  <|endoftext|>  y.", "word<|endoftext|>.Next,<|endoftext|>\n\n<|endoftext|>it", "<|endoftext", "no such token, here"]
    t = Tokenizer.from_file(Q.tokenizer_path())
    got = {r["doc_id"]: list(r["ids"]) for r in pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Q.tokenizer_path(), with_ids=True).collect()}
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert {i: x[:-1] for i, x in got.items()} == want and len(want[0]) == 1
