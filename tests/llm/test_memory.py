"""What a worker takes for texts: the table of languages holds the contexts that were seen, and slices are small."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cutline.llm import langid, neardup, toxicity, wordhash

MODEL = langid.train([("de", "ein text aus wörtern, der lang ist " * 9), ("en", "one text of words that is long " * 9)])


def plain(rows, counts, context):
    """Probabilities after a context by the recursion itself."""
    if context is None:
        return np.full(langid.SYMBOLS, 1 / langid.SYMBOLS)
    lower = plain(rows, counts, context[1:] if context else None)
    c = np.zeros(langid.SYMBOLS)
    size = langid.SYMBOLS ** (len(context) + 1)
    first = sum(s * langid.SYMBOLS ** (len(context) - i) for i, s in enumerate(context))
    for row, n in zip(rows % size, counts, strict=True):
        if first <= row < first + langid.SYMBOLS:
            c[row - first] += n
    seen, total = c > 0, c.sum()
    if not total or seen.all():
        return c / total if total else lower
    return np.where(seen, c, seen.sum() * lower / lower[~seen].sum()) / (total + seen.sum())


def test_table_equals_the_recursion():
    data, _ = wordhash.text_bytes(pa.array(["wörtern, the words zzz"]))
    symbols = [int(s) for s in MODEL.classes[data]]
    for i in range(langid.ORDER, len(symbols)):
        context = tuple(symbols[i - langid.ORDER : i])
        row = sum(s * langid.SYMBOLS ** (langid.ORDER - k) for k, s in enumerate(context))
        for lang, (rows, counts) in enumerate(MODEL.seen):
            got = np.exp2(-MODEL.bits[row : row + langid.SYMBOLS, lang].astype(float))
            assert np.allclose(got, plain(rows, counts, context), rtol=1e-4), (i, lang)
    first, bits = MODEL.table
    assert first.nbytes + bits.nbytes < MODEL.bits.nbytes / 8


@pytest.mark.parametrize(
    "work",
    [
        lambda texts: langid.code_lengths(langid.PpmModel(MODEL.classes, MODEL.languages, MODEL.seen), texts),
        lambda texts: toxicity.features(texts, ["wort", "words"]),
        lambda texts: neardup.band_hashes(wordhash.shingles(*wordhash.words(texts), 5)),
    ],
    ids=["language_id", "toxicity", "near_dedup"],
)
def test_memory_of_a_batch(work, monkeypatch):
    """A worker keeps what its largest slice took, so the peak over a batch of 3 MB is what stays beside the executor's heap."""
    monkeypatch.setattr(wordhash, "_powers", {})
    rng = np.random.default_rng(1)
    words = np.array([f"word{i}" for i in range(5000)])
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(rng.choice(words, 400)) for _ in range(900)]})
    tracemalloc.start()
    for part in wordhash.slices(batch, "text"):
        work(part.column(0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6, peak
