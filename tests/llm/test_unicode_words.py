"""The words of the byte-level tokenizer are the library's for every code point, alone and beside what words begin and end with."""

import pytest
from tokenizers import Tokenizer

from tessellary.llm import bpe
from tessellary.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def both():
    return bpe.Tokenizer(VOCABULARY), Tokenizer.from_file(VOCABULARY)


@pytest.mark.parametrize("plane", [range(0, 0x3100), range(0xA000, 0x18000), range(0x1B000, 0x20000), range(0x3100, 0x110000, 97)])
def test_every_code_point(both, plane):
    ours, library = both
    texts = [f"{c}'s{c}a{c}1{c} {c}!{c}{c} 'll{c}\n{c}" for c in map(chr, plane) if not 0xD800 <= ord(c) < 0xE000]
    for low in range(0, len(texts), 5000):
        part = texts[low : low + 5000]
        assert [list(x) for x in ours.encode_batch(part)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_letters_of_later_versions_are_none(both):
    text = "\U00010940's"  # a letter to newer libraries
    assert list(both[0].encode_batch([text])[0]) == both[1].encode(text, add_special_tokens=False).ids
