"""How much work the agendas of repeated words take."""

from querywright.llm import pieces


def test_equal_draws_of_a_word_are_worked_off_once():
    coder = pieces.Coder(*pieces.vocabulary(pieces.default_model()), 0.1, 11)
    looked, pairs = [], coder.pairs

    def counting(a, b):
        looked.append(len(a))
        return pairs(a, b)

    coder.pairs = counting
    text = "segmentation " * 5000
    ids, _ = coder.encode_all([text], [7])
    assert coder.decode(ids) == text
    assert 0 < sum(looked) < 15_000  # three neighbours looked up for each of 5000 words would be more
