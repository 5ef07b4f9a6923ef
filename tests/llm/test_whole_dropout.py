import numpy as np
import public_tokenizers

from logquarry.llm import merge_dropout

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_every_occurrence_draws_its_own_skips():
    code = merge_dropout.PieceCodec(PIECES, 0.3)
    n = 400
    ids = code.encode(["\n".join(["internationalization"] * n)], [5])[0]
    found = ids.split(code.newline)
    assert len(found) == n
    # With few segmentations a word, however often it stands, there were no more than four.
    assert len(set(found)) > 40
    # Neighbours draw for themselves, and another document draws anew.
    assert sum(a == b for a, b in zip(found[1:], found[2:])) < n / 4
    assert code.encode(["\n".join(["internationalization"] * n)], [6])[0] != ids


def test_the_memo_leaves_the_draws_as_they_are():
    """What is kept by word agrees with merging each occurrence by its own key."""
    code = merge_dropout.PieceCodec(PIECES, 0.1)
    words = [" internationalization", " the", " responsibilities", "x" * 80, " of", "日本語x", " "] * 60
    draws = np.arange(len(words), dtype=np.uint64)
    distinct = list(dict.fromkeys(words))
    kind, ids = code._occurrences(distinct, np.array([distinct.index(w) for w in words]), code._keys(draws))
    assert [ids[k] for k in kind] == code.segment(words, draws)
