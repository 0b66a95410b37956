"""What the driver holds of a language model."""

import pickle

import numpy as np

from cutline.llm import langid


def test_driver_ships_counts_and_workers_make_the_tables():
    model = langid.train([("en", "one text of words " * 40), ("de", "ein text aus wörtern " * 40)])
    assert "bits" not in vars(model) and len(pickle.dumps(model)) < 100_000
    bits = model.bits
    assert bits.shape == (langid.SYMBOLS ** (langid.ORDER + 1), 2) and np.isfinite(bits).all()
    assert len(pickle.dumps(model)) < 100_000
    assert np.array_equal(pickle.loads(pickle.dumps(model)).bits, bits)
