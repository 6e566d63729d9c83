"""Texts that hold the string of an added token against tokenizers itself."""

from pagemill.llm import packing


def test_ids_equal_tokenizers(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["<|endoftext|>", "a<|endoftext|>b", "one <|endoftext|> two  <|endoftext|>\n\n<|endoftext|><|endoftext|> x", "<|endoftext|", "<<|endoftext|>>", "é <|ENDOFTEXT|> <|endoftext|>é", " <|endoftext|> " * 700]
    expected = {i: [*own.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    found = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).orderBy("piece").collect()
    assert {i: [x for r in found if r.doc_id == i for x in r.ids] for i in expected} == expected


def test_a_million_blanks():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    text = "word" + " " * 1_000_000 + "end"
    assert packing.token_ids(text, path, 2).tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2]
