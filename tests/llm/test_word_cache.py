"""What the word cache keeps."""

from changeflow.llm import packing


def test_long_words_arent_kept():
    asked = []
    cache = packing.Recent(2, lambda k: asked.append(k) or k.encode())
    long = "x" * (packing.LONG + 1)
    assert cache[long] == cache[long] == long.encode() and asked == [long, long] and not cache
    for k in ("a", "b", "c", "a"):
        assert cache[k] == k.encode()
    assert len(cache) <= 2 and asked.count("a") == 1


def test_words_are_encoded_as_the_tokenizer_does():
    import random

    import public_tokenizers

    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    some = random.Random(3)
    letters = "abcXYZéßàñĳªºﬀ0123'’.,-_!$%^~`\"\\[]()  \t\n'sst'reſlvmd·¼²×÷"
    texts = ["dogs'", "it's", "'s", "''s", "don't.", "a's.", "café's", "7's", "a.b", "..a", "ab'll'", "ª.", "_'s_"]
    texts += ["".join(some.choices(letters, k=some.randint(0, 25))) for _ in range(5000)]
    assert all(encoder.encode(t) == encoder.whole(t) for t in texts)
