"""Words that are learned together: the library's own ids, in few calls."""

from strandline.llm.tokenize import TextEncoder, tokenizer_path


def test_words_without_a_space_are_learned_in_one_call():
    encode = TextEncoder(tokenizer_path("byte_bpe_50k.json"), True)
    texts = [f"Wort{a}chen\n({a}bel), 'seit 12.{i}\n\n  --- {a}\u00df's  don't\n ,x" for i, a in enumerate("abcdefghij")] + ["\n", " \n x", "a\n"]
    whole = encode._library(texts)
    calls, library = [], encode._library
    encode._library = lambda some: calls.extend(some) or library(some)
    assert encode.encode(texts) == whole and encode.encode(texts) == whole
    assert all(w.isspace() for w in calls)
