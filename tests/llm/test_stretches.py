"""Token files look each different stretch of a slice up once, and what is remembered is not gone through for that."""

import public_tokenizers

from glosswork.llm import token_files
from glosswork.llm.common import Remembered


class Counted(Remembered):
    looked_up = 0

    def __getitem__(self, key):
        self.looked_up += 1
        return super().__getitem__(key)

    def keys(self):
        raise AssertionError("all that is held was asked for")


def test_each_stretch_once():
    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.known = known = Counted()
    texts = ["the cat, the dog. " * 50, "", "Ñandú the  cat", " ", "<|endoftext|> a|b\nthe"]
    for _ in range(2):
        known.looked_up = 0
        got = encoder.encode(texts)
        assert known.looked_up <= len({s for x in texts for s in encoder._cut(x.lower())}) + 2
        assert got == [b"".join(i.to_bytes(4, "little") for i in encoder.tokenizer.encode(x, add_special_tokens=False).ids) for x in texts]
    assert encoder.encode([]) == []
