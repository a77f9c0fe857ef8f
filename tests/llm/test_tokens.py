"""Token ids against those of ``tokenizers``."""

import public_tokenizers
from tokenizers import Tokenizer

from episodium.llm import tokens

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "a <|endoftext|> b",
    "<|endoftext|><|endoftext|>x",
    "one  <|endoftext|>  two\n<|endoftext|>\n",
    "<|endoftext and <|ENDOFTEXT|> are plain",
    "İstanbul ÉTÉ 日本語 текст العربية हिन्दी 🙂👩‍👩‍👧 é 12³ ½",
    "a\x00b\x85c\u200bd\ufeff \u3000 \xa0\r\n\r\n  x",
    "don't we'LL they've",
    " " * 5000 + "x",
    "\n" * 5000 + "<|endoftext|>" + "\t " * 3000,
    "a" * 3000,
    " " * 1_000_000 + "x",
    "",
]


def test_ids_are_those_of_tokenizers():
    right = Tokenizer.from_file(TOKENIZER)
    for text, found in zip(TEXTS, tokens.encode(TEXTS, TOKENIZER, None)):
        assert found.tolist() == right.encode(text, add_special_tokens=False).ids, text[:40]
    assert tokens.encode(["a <|endoftext|> b"], TOKENIZER, 1)[0].tolist() == [64, 220, 50256, 275, 1]
    assert tokens.encode([None], TOKENIZER, 1)[0].tolist() == [1]
