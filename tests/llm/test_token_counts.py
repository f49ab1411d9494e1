import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from wirelore.llm import token_counts as tc


def reference(vocabulary, fallback=True):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tc.MARK, prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_tokenizer(spark, words, odd_docs, odd_rows):
    vocabulary = tc.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    t = reference(vocabulary)
    texts = [words(200), "  a  b ", "▁x", "\n\n", "aaab " * 20, "日本語 テスト😀", "<s> hi", "...."]
    counter = tc.PieceCounter(vocabulary)
    assert [counter.text(x) for x in texts] == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    rows = tc.count_tokens(odd_docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    want = sorted(((i if i is not None else -1), len(t.encode(x or "", add_special_tokens=False).ids), len(x or "")) for i, x in odd_rows)
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens, r.n_chars) for r in rows) == want


def test_ties_go_to_the_earliest_start():
    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁", -1.0), ("▁a", -2.0)]
    t, counter = reference(vocabulary, False), tc.PieceCounter(vocabulary, False)
    for n in range(1, 12):
        assert counter.text("a" * n) == len(t.encode("a" * n, add_special_tokens=False).ids)
    for text in ("xay", "xx", "xxaxx", "x a xx"):
        assert counter.text(text) == len(t.encode(text, add_special_tokens=False).ids), text
