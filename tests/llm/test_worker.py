"""A Python worker that turns to another kind of work lets the tables of the last one go."""

from snapplan.llm import tokenize, words


def test_tables_of_the_last_operator_alone_are_kept():
    want = tokenize.byte_level_ids("some words, and more", "byte_bpe_50k.json")
    assert tokenize._IDS
    hashes = words.words(["some words"]).hashes
    assert not tokenize._IDS and words._POWERS
    assert tokenize.byte_level_ids("some words, and more", "byte_bpe_50k.json") == want
    assert tokenize._IDS and not words._POWERS
    assert (words.words(["some words"]).hashes == hashes).all()
