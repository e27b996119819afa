import random

from tokenizers import Tokenizer

from textloom.llm import token_counts as T

from .helpers import awkward

PIECES = [*"aZ'é́ s t\x1c\x85 İΣς힣ᄀ가각👍🏽<|>_1２½ǅ\n\t ", "<|endoftext|>", "<|startoftext|>", "'s", "'RE", "it's", "hello", "ﬁ", "Å", "ẛ̣", "straße", "ẞ", "world ", "\u208f", "\u209d", "\u209f", "\ua7cb", "\ua7dc"]


def library():
    t = Tokenizer.from_file(T.default_file())
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_like_the_library():
    rng, count, want = random.Random(2), T.counter(open(T.default_file()).read(), T.whole_tokens(T.default_file())), library()
    for _ in range(4000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 25)))
        assert count(text) == want(text), ascii(text)


def test_whole_tokens_are_proven():
    want, whole = Tokenizer.from_file(T.default_file()).model, T.whole_tokens(T.default_file())
    assert all(len(want.tokenize(w)) == 1 for w in sorted(whole)[::37])


def test_awkward_rows(spark):
    docs, want = awkward(spark), library()
    got = sorted((r["id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in T.count_tokens(docs).collect())
    texts = [(r["doc_id"] or 0, r["text"] or "") for r in docs.collect()]
    assert got == sorted((i, len(t.encode()), want(t), want(t) > 2048) for i, t in texts)
    assert T.count_tokens(docs.limit(0)).collect() == []
