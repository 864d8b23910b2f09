from tessellary.llm import bpe, queries


def test_fewer_remembered_words_change_no_tokens():
    texts = ["alpha beta gamma delta " * 3, "beta épsilon  zeta\n eta", "", "x y z " * 20, "alpha gamma"]
    few = bpe.Tokenizer(queries.VOCABULARY, 3)
    assert [few.encode_batch([t])[0] for t in texts] == bpe.Tokenizer(queries.VOCABULARY).encode_batch(texts)
    few.encode_batch(["one", "two three"])
    assert len(few.known) <= 3 and len(few.stretches) <= 3
