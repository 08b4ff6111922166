"""Pieces of text in the trie tokenizer: each distinct one is looked up once for all its uses."""
import hashlib

import pyarrow as pa
import public_tokenizers
import tokenizers

from tidemark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


class Counted(dict):
    asked = 0

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_a_piece_is_looked_up_once_for_all_its_uses():
    coder = bpe.TrieBPE(PATH)
    coder.known_pieces = Counted()
    ids, decoded, n = coder.encode_array(pa.array(["one two\n" * 5_000, "", " two  one "]))
    assert coder.known_pieces.asked <= 3  # one, two and the empty piece
    whole = tokenizers.Tokenizer.from_file(PATH)
    want = [whole.encode(t, add_special_tokens=False).ids for t in ("one two\n" * 5_000, "", " two  one ")]
    assert ids.to_pylist() == [" ".join(map(str, w)) for w in want] and n.tolist() == [len(w) for w in want]
    assert decoded.to_pylist() == [whole.decode(w, skip_special_tokens=False) for w in want]


def test_digests_of_odd_texts_are_those_of_the_library():
    texts = ["", " ", "\n\n a", "\x85 x", " ", "Σας ΣΣ, é", "<|endoftext|> a<|endoftext|>b", "\x00 a", None, "ab" * 300]
    whole = tokenizers.Tokenizer.from_file(PATH)
    whole.no_truncation()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    (got,) = bpe._digests(PATH)(iter([batch.slice(0, 0), batch]))
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got.column("n_tokens").to_pylist() == [len(w) for w in want]
    assert got.column("ids_sha256").to_pylist() == [sha(" ".join(map(str, w))) for w in want]
    assert got.column("decoded_sha256").to_pylist() == [sha(whole.decode(w, skip_special_tokens=False)) for w in want]
