"""The tokenizer keeps words that come up again when its memory is full."""

from tidemark.llm import bpe
from tidemark.llm.queries import tokenizer


def test_recurring_words_are_learned_once(monkeypatch):
    path, pattern = tokenizer()
    raw = open(path, "rb").read()
    letters = "bcdfghjklm"
    common = [f" zqx{letters[i // 10]}{letters[i % 10]}vk" for i in range(40)]
    parts = [["".join(common), "".join(f" jw{letters[k]}p{letters[i // 10]}{letters[i % 10]}x" for i in range(30))] for k in range(6)]
    assert len(bpe.Codec(raw, pattern).words.findall("".join(parts[0]))) == 70
    want = [bpe.Codec(raw, pattern).encode(p) for p in parts]
    monkeypatch.setattr(bpe, "REMEMBERED", 60)
    codec = bpe.Codec(raw, pattern)
    learned, learn = [], codec.learn
    monkeypatch.setattr(codec, "learn", lambda words: (learned.extend(words), learn(words)))
    assert [codec.encode(p) for p in parts] == want
    # All memory was given up with each part before, so each word of ``common`` was learned six times.
    assert len(learned) == len(set(learned))
    assert len(codec.known) + len(codec.aside) < 2 * (60 + max(len(codec.words.findall("".join(p))) for p in parts))
    assert codec.decode(want[0]) == [t.encode() for t in parts[0]]
