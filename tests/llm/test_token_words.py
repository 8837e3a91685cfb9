"""Words of ASCII letters are encoded by the tokenizer's model itself, to the same ids."""

import random

from nameloom.llm import token_records
from nameloom.llm.queries import tokenizer_file


def test_ascii_words_need_the_model_only():
    from tokenizers import Tokenizer

    path, rng = tokenizer_file("word_bpe_49k.json"), random.Random(5)
    t, e = Tokenizer.from_file(path), token_records.Encoder(path)
    texts = [" ".join("".join(rng.choices("etaoinshrdlucmfwypvbgkjqxzEZ", k=rng.randint(1, 14))) + rng.choice(["", "", " 7", " 42"]) for _ in range(50)) for _ in range(40)]
    e.tokenizer = None
    assert e.encode(texts) == [token_records.np.array(t.encode(x, add_special_tokens=False).ids, dtype=e.kind).tobytes() for x in texts]
