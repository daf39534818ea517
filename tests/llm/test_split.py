import public_tokenizers

from eventsift.llm import bpe


def test_every_character_below_0250_splits_as_in_the_library():
    splitter = bpe.Splitter(public_tokenizers.path("word_bpe_49k.json"))
    wrong = []
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b", f"{c}li", f"x {c}{c} 1{c}2"):
            if splitter(text) != [w for w, _ in splitter.split(splitter.normalise(text))]:
                wrong.append(text)
    assert wrong == []
