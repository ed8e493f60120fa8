"""What a worker keeps after it has encoded."""

import numpy as np

from catalens.llm import cross_tokenizer


def test_vocabularies_are_given_back(monkeypatch):
    dropped = []

    class Loaded:
        def __init__(self, name):
            self.name = name

        def cache_clear(self):
            dropped.append(self.name)

    monkeypatch.setattr(cross_tokenizer, "_byte_bpe", Loaded("a"))
    monkeypatch.setattr(cross_tokenizer, "_pieces", Loaded("b"))
    assert list(cross_tokenizer._asked((np.uint16, np.uint16))(iter([]))) == []
    assert dropped == ["a", "b"]
