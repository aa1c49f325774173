"""The split of plain words against the tokenizer itself."""

import itertools

from faultline.llm.packing import WordIds


def test_words_get_the_tokenizers_own_ids():
    words = WordIds("word_bpe_49k.json")
    chars = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))]
    texts = ["".join(t) for t in itertools.product(chars, "a'2²_É", "sX¼")]
    texts += ["", "  a  b\x1cc \x1f ", "<|endoftext|> İx don't WE'LL 12²³", " x­y"]
    for part in (texts, texts):  # the second time all words are known
        got = list(words.ids(part))
        want = words.whole.encode_batch(part, add_special_tokens=False)
        for text, ids, e in zip(part, got, want):
            assert ids == b"".join(i.to_bytes(4, "little") for i in e.ids), text
