"""Texts that are spared the normaliser are counted like by the library alone."""

import random

from quarry.llm import queries, tokens


def test_spared_texts_count_alike():
    codec = tokens.JsonCodec(queries.tokenizer_path("word_bpe_49k.json"))
    assert codec.spared is not None and not codec.spared[1].search("Été, 'plain' – straße\n") and codec.spared[1].search("é")
    rng, signs = random.Random(1), "aAZzéÉß İÅÿŉ'’ѣЖ7½² \u0085\x0b\x1c\x00.-_<|>́ 語ΣςNﬁ\n\t"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 20))) for _ in range(2000)]
    texts += ["<|ENDOFTEXT|> a", "a<|endoftext|>B", "", " ", "I'LL 'T", "É É"]
    said = codec.library.encode_batch(texts, add_special_tokens=False)
    assert codec.counts(texts) == [len(e) for e in said]
    assert [p.e.ids for p in codec.encode(texts)] == [e.ids for e in said] and [p.e.offsets for p in codec.encode(texts)] == [e.offsets for e in said]
