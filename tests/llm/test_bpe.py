import hashlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from strataq.llm import bpe

WORD, BYTE = bpe.path("word_bpe_49k.json"), bpe.path("byte_bpe_50k.json")
TOKS = {f: bpe.load(f) for f in (WORD, BYTE)}
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def check(text, leaf=bpe.PART):
    for f, keeps in ((WORD, False), (BYTE, True)):
        encoder, want = bpe.worker_encoder(f, "ids", keeps), TOKS[f].encode(text, add_special_tokens=False).ids
        assert [i for p in encoder(text) for i in p] == want
        assert [[i for p in x for i in p] for x in encoder.batch([text, "", text], leaf)] == [want, [], want]


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("abABst1²¼ª'!.,é×ß日ss  \n\n\t\x85\xa0\x1c\x0b́<|endoftext|>"), max_size=60))
def test_pieces_give_the_whole_texts_tokens(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=255), max_size=40))
def test_latin_texts(text):
    check(text)


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("abK1'!,   \n\xa0\x85\u3000\u2009\x1c日яá\u0301"), max_size=40))
def test_mixed_white_space(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abstAB12'!,.    \n\xa0é日"), min_size=20, max_size=400), st.sampled_from([8, 30, 100]))
def test_trees_of_whole_texts_are_exact(text, leaf):
    check(text, leaf)


def test_long_texts_take_the_tree(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text and len(r.text) > bpe.PART]
    joins = []
    spliced = bpe._spliced
    monkeypatch.setattr(bpe, "_spliced", lambda *a: joins.append(1) or spliced(*a))
    for f, keeps in ((WORD, False), (BYTE, True)):
        got = bpe.worker_encoder(f, "ids", keeps).batch(texts)
        assert [[i for p in x for i in p] for x in got] == [e.ids for e in TOKS[f].encode_batch(texts, add_special_tokens=False)]
    assert len(joins) >= 2 * len(texts) > 0


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abcdeAB12'!é日"), min_size=20, max_size=500), st.sampled_from([16, 50]), st.sampled_from([4, 32]))
def test_tree_concatenation_is_exact(text, leaf, window):
    for t in TOKS.values():
        assert bpe.tree_encode(t, text, leaf, window) == t.encode(text, add_special_tokens=False).ids


def test_long_unsplit_text():
    text = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(900))
    for t in TOKS.values():
        assert bpe.tree_encode(t, text) == t.encode(text, add_special_tokens=False).ids


def test_operator_equals_library(docs_of, odd_rows):
    t = TOKS[WORD]
    want = Counter()
    for d, x, _ in odd_rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[d, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    got = bpe.encode_decode(docs_of(odd_rows), WORD, ids=False)
    assert Counter(map(tuple, got.collect())) == want
    full = bpe.encode_decode(docs_of(odd_rows), WORD).collect()
    assert Counter((r.doc_id, len(r.ids), sha(" ".join(map(str, r.ids))), sha(r.decoded)) for r in full) == want
    assert bpe.encode_decode(docs_of(odd_rows).limit(0), WORD).count() == 0
