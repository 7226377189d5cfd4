"""Blocks are split at once: as each text alone, in few calls."""

import random

import public_tokenizers
import regex

from gradelake.llm.bpe import number_words, split_words


class Counting:
    def __init__(self, pattern):
        self.pattern, self.calls = pattern, 0

    def findall(self, text):
        self.calls += 1
        return self.pattern.findall(text)

    def finditer(self, text):
        return self.pattern.finditer(text)


def test_distinct_pieces_in_one_call():
    counted = Counting(regex.compile(public_tokenizers.PATTERN))
    texts = [" ".join(f"w{i * 100 + j}" for j in range(100)) for i in range(20)]
    words, numbers = number_words(texts, counted)
    assert counted.calls <= 1 + len(texts)
    assert [[words[n] for n in own] for own in numbers] == [counted.pattern.findall(t) for t in texts]


def test_random_blocks():
    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(3)
    signs = ["a", "b", "'s", " ", "  ", "\n", " \n", "1", "é", "日", "\x1c", "　", ".", "\t", "'"]
    for _ in range(500):
        texts = ["".join(rng.choices(signs, k=rng.randrange(14))) for _ in range(rng.randrange(1, 9))]
        words, numbers = number_words(texts, pattern)
        assert [[words[n] for n in own] for own in numbers] == [pattern.findall(t) for t in texts]
        assert split_words(texts, pattern)[0] == words
