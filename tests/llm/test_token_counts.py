import random

from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.llm import token_counts as C
from tests.llm import brute


def greedy(vocabulary, word):
    at = count = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return 1
        at, count = end, count + 1
    return count


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=5), min_size=1, max_size=12), st.text(alphabet="abcd", min_size=1, max_size=14))
def test_counts_like_greedy_matching(vocabulary, word):
    pieces = {v.encode() for v in vocabulary}
    assert C.Automaton(pieces).count(word.encode()) == greedy(pieces, word.encode())


def test_counts_like_a_word_piece_model():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = C.read_ranks(C.public_vocabulary())
    matcher = C.automaton(C.public_vocabulary())
    model = models.WordPiece({p.decode("latin-1"): i for i, p in enumerate(pieces)} | {"[UNK]": len(pieces)}, unk_token="[UNK]", continuing_subword_prefix="", max_input_chars_per_word=10_000)
    plain = Tokenizer(model)
    plain.pre_tokenizer = pre_tokenizers.Split("\x00", "removed")
    for word in ("international", "ThSt", "été", "x" * 400, "don't", "###", "日本語テキスト"):
        text = (" " + word).encode()
        assert matcher.count(text) == len(plain.encode(text.decode("latin-1"), add_special_tokens=False).ids)


def test_documents(spark, documents):
    vocabulary = set(C.read_ranks(C.public_vocabulary()))
    rng = random.Random(0)
    rows = [(d, rng.choice([" ", "\n", "\t "]).join(rng.choice(["the", "Ofthat", "zzzqx", "été", "a" * 50, "it's"]) for _ in range(rng.randrange(60)))) for d in range(30)] + [(40, None), (41, ""), (42, "same"), (42, "same"), (None, "x y")]
    out = sorted((str(r["doc_id"]), r["n_words"], r["n_tokens"]) for r in C.count_tokens(documents(*rows)).collect())
    assert out == sorted((str(d), len(brute.spaced(t)), sum(greedy(vocabulary, b" " + w.encode()) for w in brute.spaced(t))) for d, t in rows)
    assert C.count_tokens(documents()).count() == 0


def test_forgotten_words_are_counted_again(spark, documents, monkeypatch):
    monkeypatch.setattr(C, "REMEMBERED", 2)
    rows = [(d, " ".join(f"w{i}" for i in range(d))) for d in range(12)]
    out = {r["doc_id"]: r["n_words"] for r in C.count_tokens(documents(*rows)).collect()}
    assert out == {d: d for d in range(12)}


def test_columns_of_any_name_and_long_texts(spark, documents):
    rows = [(1, "some words"), (None, None), (2, "w" * 300_000 + " " + "v " * 200_000)]
    plain = C.count_tokens(documents(*rows)).collect()
    extra = ["n_words", "N_TOKENS", "a.b", "`x`"]
    out = C.count_tokens(brute.with_extra_columns(documents(*rows), extra))
    assert out.columns == ["doc_id", "n_words", "n_tokens"] and out.collect() == plain and plain[2]["n_words"] == 200_001
