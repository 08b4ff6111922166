"""Sentence ends of texts with any white space."""
import numpy as np
import public_tokenizers
import pytest
from test_dealt import ODD, fuzz

from tidemark.llm import packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PROSE = "The first one here. And a second: it goes on! Não é? Für dich; 你好. 🎉🎉. done"


def by_prefixes(tok, text):
    """Token offsets at which an end mark is followed by white space, as far as the tokens before are those of the prefix."""
    ids, out = tok.encode(text, add_special_tokens=False).ids, []
    for q in range(1, len(text)):
        if text[q - 1] in ".!?:;" and text[q].isspace():
            head = tok.encode(text[:q], add_special_tokens=False).ids
            if ids[: len(head)] == head:
                out.append(len(head))
    return sorted(set(out))


@pytest.mark.parametrize("gap", ["\n\n", "  ", "\t", "\r\n", "\xa0", " \n ", "　", "\0 "])
def test_sentence_ends_of_odd_white_space(gap):
    ids = packing.load(BYTE)
    text = PROSE.replace(" ", gap, 12) + " And so on. End."
    got = ids.encode(text)[1].tolist()
    assert got == by_prefixes(ids.tok, text) and got


def test_both_libraries_give_the_same_ids():
    ids, slow = packing.load(BYTE), packing.Ids(BYTE)
    assert ids.fast is not None
    slow.fast = None
    texts = [PROSE, PROSE.replace(". ", ".\n"), "a. b! c? d: e; f", "x.y. 1.5 z.", " " * 1000 + "a. b", "\n \t" * 400 + "x", "x" * 3000, "don't I'LL we've <|endoftext|> it.\x1c a.\x85b"]
    for t in texts + [t or "" for t in ODD] + fuzz(400, 9):
        (a, b), (c, d) = ids.encode(t), slow.encode(t)
        assert a == c and b.tolist() == d.tolist(), t
        assert np.all((b > 0) & (b <= len(a) // 4)) and np.all(np.diff(b) > 0)


def test_both_libraries_agree_on_all_code_points():
    ids = packing.load(BYTE)
    points = [c for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}.{chr(c)}{chr(c)} x" for c in points]
    for k in range(0, len(texts), 20_000):
        want = ids.tok.encode_batch_fast(texts[k : k + 20_000], add_special_tokens=False)
        assert all(ids.fast(t) == e.ids for t, e in zip(texts[k : k + 20_000], want))


def test_blank_lines_are_not_padded(spark):
    text = "\n\n".join("One more short sentence of the text stands here." for _ in range(100))
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    got = packing.pack(docs, BYTE, 1, partitions=1).toPandas()
    sizes = got.groupby("sequence_id").length.sum()
    assert sizes.iloc[:20].min() > 1900
