"""Local search over all underfull bins, whatever their number."""

from collections import Counter

import numpy as np
import public_tokenizers
from graphmill.llm import packing


def test_search_goes_past_the_first_bins():
    lengths = {1034: 3000, 522: 3000, 532: 3000, 492: 6000}
    bins = packing.pack_histogram(lengths, 2048)
    assert sum(bins.values()) == 4500  # best fit alone: 5500
    held = Counter()
    for contents, n in bins.items():
        assert sum(contents) <= 2048
        for x in contents:
            held[x] += n
    assert held == lengths


def test_search_never_loses_pieces_and_never_needs_more_bins():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = Counter({int(x): int(n) for x, n in zip(rng.integers(20, 60, 12), rng.integers(1, 900, 12), strict=True)})
        first, bins = packing.best_fit(lengths, 100), packing.pack_histogram(lengths, 100)
        held = Counter()
        for contents, n in bins.items():
            assert n > 0 and sum(contents) <= 100
            for x in contents:
                held[x] += n
        assert held == lengths and sum(bins.values()) <= sum(first.values())


def test_a_chunk_is_looked_up_once_for_all_texts():
    """Texts are tokenised together: one lookup for each distinct chunk, not for each word; the same ids as the file's own."""

    class Counting(packing.WordTokenizer):
        asked = 0

        def __getitem__(self, chunk):
            self.asked += 1
            return super().__getitem__(chunk)

    tok = Counting(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["the Été, of the end. " * 50, "", "<pad> The. <b> a,b\x0bc", "of.\nthe", " \t", "a."] * 20
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]])
    tok.asked = 0
    got = tok.encode_all(data, offsets)
    assert tok.asked < 30
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
